"""Queries over the test tables, an operator or two each, with the same in DuckDB's SQL.

The meeting tables aren't among the test tables, so operators run on columns
that play the same parts: orders are meetings and line items their items, events
are a transcript, pages are agenda pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folkmoot import case_queries
from folkmoot.functions import classify, match
from folkmoot.functions import text as tx
from folkmoot.operators import diff, graph, intervals, rank, store
from folkmoot.sources import parse

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("""
SELECT l_orderkey, l_linenumber, l_quantity, nth FROM (
  SELECT l_orderkey, l_linenumber, l_quantity, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS nth
  FROM lineitem WHERE l_returnflag <> 'N') WHERE nth <= 3""")
def top_items_per_group(spark, d):
    """The three longest items of each meeting."""
    items = table(spark, d, "lineitem").where("l_returnflag <> 'N'")
    return rank.top_per_group(items, ["l_orderkey"], F.col("l_quantity"), ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], 3).select("l_orderkey", "l_linenumber", "l_quantity", "nth")


@query("""
WITH s AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
    round((CASE WHEN l_returnflag = 'R' THEN 0.5 ELSE 0 END + CASE WHEN l_extendedprice > 50000 THEN 0.3 ELSE 0 END
     + CASE WHEN o_orderstatus = 'F' THEN 0.2 ELSE 0 END + 0.45 * least(1.0, ln(1 + CAST(l_quantity AS DOUBLE)) / ln(121))), 6) AS score
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM s)
SELECT l_orderkey, l_linenumber, score, CAST(n - 1 AS INT) AS rank FROM r WHERE n <= 8""")
def interest_score_topk(spark, d):
    """Weighted score, the eight best, ranked from 0."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    add = lambda c, a: F.when(c, a).otherwise(0.0)
    score = add(F.col("l_returnflag") == "R", 0.5) + add(F.col("l_extendedprice") > 50000, 0.3) + add(F.col("o_orderstatus") == "F", 0.2) + 0.45 * F.least(F.lit(1.0), F.log1p(F.col("l_quantity").cast("double")) / F.log1p(F.lit(120.0)))
    top = rank.top_per_group(rows.withColumn("score", F.round(score, 6)), ["l_orderkey"], F.col("score"), ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], 8)
    return top.select("l_orderkey", "l_linenumber", "score", (F.col("nth") - 1).alias("rank"))


_VOTE = """CASE o_orderstatus WHEN 'F' THEN 'CARRIED (' || (o_orderkey % 9 + 2) || ' to ' || (o_orderkey % 3) || ')' WHEN 'O' THEN 'CARRIED UNANIMOUSLY'
  WHEN 'P' THEN 'DEFEATED (5 to ' || (o_orderkey % 4 + 6) || ')' ELSE '' END"""
_REC = """CASE o_custkey % 6 WHEN 0 THEN 'That the report be received as information' WHEN 1 THEN 'That the item be deferred' WHEN 2 THEN 'recommend to City Council that it pass'
  WHEN 3 THEN 'That City Council consider Bylaw No. ' || o_custkey WHEN 4 THEN '' ELSE 'That ' || o_orderpriority || ' be approved' END"""


@query(f"""
WITH v AS (SELECT o_orderkey, {_VOTE} AS v, {_REC} AS r FROM orders),
t AS (SELECT *, CASE WHEN regexp_matches(v, '\\((\\d+)\\s+to\\s+(\\d+)\\)')
        THEN ' (' || regexp_extract(v, '\\((\\d+)\\s+to\\s+(\\d+)\\)', 1) || '-' || regexp_extract(v, '\\((\\d+)\\s+to\\s+(\\d+)\\)', 2) || ')' ELSE '' END AS t FROM v)
SELECT o_orderkey, CASE WHEN v = '' AND r = '' THEN 'Discussed' WHEN v = '' THEN 'Recommended' WHEN v LIKE '%DEFEATED%' THEN 'Defeated' || t
  WHEN regexp_matches(upper(r), '\\bDEFER(RED)?\\b') THEN 'Deferred' WHEN regexp_matches(upper(r), 'RECOMMEND\\s+TO\\s+CITY\\s+COUNCIL') THEN 'Recommended to Council' || t
  WHEN regexp_matches(upper(r), 'BE\\s+RECEIVED') THEN 'Received as information' WHEN regexp_matches(upper(r), 'CONSIDER\\s+BYLAW') THEN 'First reading passed' || t
  WHEN v LIKE '%UNANIMOUSLY%' THEN 'Approved' ELSE 'Approved' || t END AS outcome FROM t""")
def outcome_label(spark, d):
    """C1."""
    return table(spark, d, "orders").selectExpr("o_orderkey", f"{_VOTE} AS v", f"{_REC} AS r").select("o_orderkey", classify.format_outcome("v", "r").alias("outcome"))


_RULES = {"Metal": "steel|copper|brass|nickel|tin", "Finish": "polished|burnished|anodized|plated|brushed", "Size": r"\b(small|medium|large|economy)\b", "Name": "part", "Standard": "standard|promo"}


@query(f"""
WITH f AS (SELECT p_partkey, list_filter([{", ".join(f"CASE WHEN regexp_matches(p_name || ' ' || p_type || ' ', '(?i){p}') THEN '{c}' END" for c, p in _RULES.items())}], lambda x: x IS NOT NULL) AS f FROM part)
SELECT p_partkey, array_to_string(f[1:2], ',') AS categories FROM f""")
def category_first_two(spark, d):
    """The first two categories that match, in their order."""
    return table(spark, d, "part").select("p_partkey", F.array_join(classify.categorize("p_name", "p_type", F.lit(""), rules=_RULES), ",").alias("categories"))


_HIER = """SELECT o_orderkey AS m, 0 AS pos, o_orderkey || '.' AS section, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey * 1000 END AS s, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey * 1000 + 500 END AS e FROM orders
  UNION ALL SELECT l_orderkey, l_linenumber, l_orderkey || '.' || l_linenumber || '.', CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_orderkey * 1000 + l_linenumber AS BIGINT) END, CASE WHEN l_linenumber % 3 = 0 THEN CAST(l_orderkey * 1000 + l_linenumber + 9 AS BIGINT) END
  FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)"""


@query(f"""
WITH i AS ({_HIER}), p AS (SELECT o_orderkey AS m, o_orderkey * 1000 AS s, o_orderkey * 1000 + 500 AS e FROM orders WHERE o_orderkey % 5 <> 0)
SELECT i.m AS meeting_id, i.pos, coalesce(i.s, p.s) AS time_start_ms, CASE WHEN i.s IS NOT NULL THEN i.e ELSE p.e END AS time_end_ms, i.s IS NULL AND p.s IS NOT NULL AS timestamp_inherited
FROM i LEFT JOIN p ON i.m = p.m AND i.pos <> 0""")
def hierarchy_inherit(spark, d):
    """Items without a span take their section's."""
    named = _HIER.replace("FROM orders", f"FROM parquet.`{d}/orders.parquet`").replace("FROM lineitem", f"FROM parquet.`{d}/lineitem.parquet`")
    items = spark.sql(named).select(F.col("m").alias("meeting_id"), "pos", F.col("section").alias("section_number"), F.col("s").alias("time_start_ms"), F.col("e").alias("time_end_ms"), F.lit(False).alias("timestamp_inherited"))
    return intervals.inherit_spans(items).select("meeting_id", "pos", "time_start_ms", "time_end_ms", "timestamp_inherited")


def _events(spark, d) -> DataFrame:
    """Events as segments: an event lasts to ten minutes after its time."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("meeting_id"), F.row_number().over(order).alias("seq"), ms.alias("start_ms"), (ms + 600_000).alias("end_ms"), F.col("event_type").alias("text"), "event_id", "value", "props", "ts"
    )


_SEG = """seg AS (SELECT CAST(user_id AS VARCHAR) AS meeting_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS seq, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + 600000 AS end_ms, event_type AS text, event_id FROM events)"""
_ITEM = """item AS (SELECT meeting_id, seq AS pos, start_ms AS s, start_ms + 86400000 AS e FROM seg WHERE seq % 10 = 1)"""


def _windows(segments: DataFrame) -> DataFrame:
    """Every tenth event opens an item of a day."""
    return segments.where("seq % 10 = 1").select("meeting_id", F.col("seq").alias("pos"), F.col("start_ms").alias("time_start_ms"), (F.col("start_ms") + 86_400_000).alias("time_end_ms"), F.lit(False).alias("timestamp_inherited"))


@query(f"WITH {_SEG}, {_ITEM} SELECT item.meeting_id, pos, seq FROM item JOIN seg ON item.meeting_id = seg.meeting_id AND start_ms < e AND end_ms > s")
def interval_slice_strict(spark, d):
    """J2."""
    seg = _events(spark, d).select("meeting_id", "seq", "start_ms", "end_ms", "text")
    return intervals.slice_strict(_windows(seg), seg).select("meeting_id", "pos", "seq")


@query(f"""WITH {_SEG}, {_ITEM}
SELECT item.meeting_id, item.pos, coalesce(string_agg(text, ' ' ORDER BY seq) FILTER (text <> ''), '') AS heard
FROM item LEFT JOIN seg ON item.meeting_id = seg.meeting_id AND start_ms <= e AND end_ms >= s GROUP BY ALL""")
def interval_slice_inclusive(spark, d):
    """The words of each item's segments."""
    seg = _events(spark, d).select("meeting_id", "seq", "start_ms", "end_ms", "text")
    return intervals.item_text(_windows(seg), seg).select("meeting_id", "pos", "heard")


@query(f"""WITH {_SEG}, t AS (SELECT *, lag(end_ms) OVER (PARTITION BY meeting_id ORDER BY start_ms, seq) AS p FROM seg),
g AS (SELECT meeting_id, p AS f, start_ms AS t FROM t WHERE start_ms - p >= 36000000),
h AS (SELECT g.meeting_id, f, t, coalesce(min(seq) FILTER (end_ms <= f), 1073741824) AS host FROM g JOIN seg ON g.meeting_id = seg.meeting_id GROUP BY ALL),
c AS (SELECT meeting_id, f, t, max(host) OVER (PARTITION BY meeting_id ORDER BY f, t) AS host, row_number() OVER (PARTITION BY meeting_id ORDER BY f, t) AS nth FROM h),
u AS (SELECT meeting_id, seq AS host, 0 AS nth, start_ms AS time_start_ms, end_ms AS time_end_ms, false AS is_recess FROM seg UNION ALL SELECT meeting_id, host, nth, f, t, true FROM c)
SELECT meeting_id, CAST(row_number() OVER (PARTITION BY meeting_id ORDER BY host, nth) - 1 AS INT) AS pos, time_start_ms, time_end_ms, is_recess FROM u""")
def gap_rows(spark, d):
    """A recess for each gap of ten hours."""
    items = _events(spark, d).select("meeting_id", F.col("seq").alias("pos"), F.lit(0).cast("long").alias("item_id"), F.col("start_ms").alias("time_start_ms"), F.col("end_ms").alias("time_end_ms"), F.lit(False).alias("timestamp_inherited"), F.lit(False).alias("is_recess"))
    return intervals.insert_recesses(items, 36_000_000).select("meeting_id", "pos", "time_start_ms", "time_end_ms", "is_recess")


@query("""SELECT event_id, coalesce(epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) // 1000 - epoch_us(ts) // 1000 <= 60000, false) AS timestamp_inherited FROM events""")
def brief_flag(spark, d):
    """Spans of a minute or less."""
    rows = _events(spark, d)
    end = F.lead("start_ms").over(Window.partitionBy("meeting_id").orderBy("ts", "event_id"))
    items = rows.select("event_id", F.col("start_ms").alias("time_start_ms"), end.alias("time_end_ms"), F.lit(False).alias("timestamp_inherited"))
    return intervals.mark_brief(items).select("event_id", "timestamp_inherited")


_JOINT = """SELECT CAST(o_custkey AS VARCHAR) AS meeting_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS pos, o_orderkey AS item_id,
  date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS s, o_orderkey % 7 AS who FROM orders"""


@query(f"""
WITH RECURSIVE i AS ({_JOINT}),
e AS (SELECT a.meeting_id, a.pos AS a, b.pos AS b FROM i a JOIN i b ON a.meeting_id = b.meeting_id AND a.pos < b.pos AND a.who = b.who
      WHERE least(a.s + 200, b.s + 200) - greatest(a.s, b.s) > 0 AND (least(a.s + 200, b.s + 200) - greatest(a.s, b.s)) / 200.0 >= 0.5),
x AS (SELECT meeting_id, a, b FROM e UNION SELECT meeting_id, b, a FROM e),
r AS (SELECT DISTINCT meeting_id, a AS pos, a AS n FROM x UNION SELECT r.meeting_id, r.pos, x.b FROM r JOIN x ON r.meeting_id = x.meeting_id AND r.n = x.a),
g AS (SELECT meeting_id, pos, min(n) AS grp FROM r GROUP BY ALL)
SELECT g.meeting_id, g.pos, g.grp, CAST(min(s) OVER w AS BIGINT) AS win_start, CAST(max(s) OVER w + 200 AS BIGINT) AS win_end
FROM g JOIN i ON g.meeting_id = i.meeting_id AND g.pos = i.pos WINDOW w AS (PARTITION BY g.meeting_id, g.grp)""")
def joint_groups(spark, d):
    """Orders of a customer that overlap in time and share a part: components, and their joint window."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    start = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    items = table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("meeting_id"), F.row_number().over(order).alias("pos"), F.col("o_orderkey").alias("item_id"), F.col("o_orderkey").cast("string").alias("section_number"),
        start.alias("time_start_ms"), (start + 200).alias("time_end_ms"), F.array(F.struct((F.col("o_orderkey") % 7).cast("string").alias("name"))).alias("speakers"),
    )
    items = graph.settle(items)
    groups = graph.settle(intervals.joint_groups(items))
    marked = intervals.mark_jointly_heard(items, groups)
    return groups.join(intervals.group_window(marked), ["meeting_id", "pos"])


@query(f"""
WITH {_SEG}, {_ITEM},
c AS (SELECT item.meeting_id, pos, seq, start_ms, CASE text WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 END AS p, abs(start_ms - e) AS far FROM item JOIN seg ON item.meeting_id = seg.meeting_id)
SELECT meeting_id, pos, CAST(start_ms AS BIGINT) AS found_ms FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id, pos ORDER BY p DESC, far, start_ms) AS n FROM c WHERE p IS NOT NULL) WHERE n = 1""")
def nearest_match(spark, d):
    """The best segment by priority, then by distance from a hint, then the first."""
    seg = _events(spark, d).select("meeting_id", "seq", "start_ms", "text")
    both = _windows(_events(spark, d)).join(seg, "meeting_id")
    p = F.when(F.col("text") == "error", 3).when(F.col("text") == "purchase", 2).when(F.col("text") == "click", 1)
    best = both.withColumn("p", p).where("p IS NOT NULL").groupBy("meeting_id", "pos").agg(F.min(F.struct(-F.col("p"), F.abs(F.col("start_ms") - F.col("time_end_ms")), F.col("start_ms").alias("at"))).alias("b"))
    return best.select("meeting_id", "pos", F.col("b.at").alias("found_ms"))


@query(f"""
WITH {_SEG}, i AS (SELECT meeting_id, seq AS pos, start_ms AS s FROM seg WHERE text <> 'view'),
n AS (SELECT i.*, seg.seq, seg.start_ms, seg.end_ms, seg.text FROM i JOIN seg ON i.meeting_id = seg.meeting_id AND end_ms > s AND start_ms <= s + 1200000),
a AS (SELECT *, min(CASE WHEN text = 'error' THEN seq END) OVER (PARTITION BY meeting_id, pos) AS r FROM n),
b AS (SELECT *, lag(CASE WHEN seq = r THEN end_ms ELSE least(end_ms, start_ms + 30000) END) OVER (PARTITION BY meeting_id, pos ORDER BY seq) AS p FROM a WHERE seq >= r),
f AS (SELECT meeting_id, pos, s, arg_min(start_ms, seq) AS back FROM b WHERE seq > r AND (text = 'view' OR start_ms - p >= 60000) GROUP BY ALL)
SELECT i.meeting_id, i.pos, CASE WHEN f.back - i.s BETWEEN 60000 AND 1200000 THEN f.back ELSE i.s END AS time_start_ms, coalesce(f.back - i.s BETWEEN 60000 AND 1200000, false) AS time_start_adjusted
FROM i LEFT JOIN f ON i.meeting_id = f.meeting_id AND i.pos = f.pos""")
def forward_shift(spark, d):
    """Items move past a recess (an error) to where the meeting resumes (a view)."""
    said = F.when(F.col("text") == "error", "we recess").when(F.col("text") == "view", "back to order").otherwise("")
    seg = _events(spark, d)
    items = seg.where("text <> 'view'").select("meeting_id", F.col("seq").alias("pos"), F.col("start_ms").alias("time_start_ms"), F.lit(False).alias("timestamp_inherited"))
    got = intervals.shift_past_recesses(items, seg.select("meeting_id", "seq", "start_ms", "end_ms", said.alias("text")))
    return got.select("meeting_id", "pos", "time_start_ms", "time_start_adjusted")


@query("""
WITH a AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]{3,}'), lambda w: NOT list_contains(['and','are','for','from','that','the','this','was','with'], w))) AS w FROM benchmark),
t AS (SELECT doc_id, w FROM (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]{3,}'),
        lambda w: NOT list_contains(['and','are','for','from','that','the','this','was','with','city','committee','council','policy','report','standing'], w))) AS w FROM documents) WHERE len(w) > 0),
s AS (SELECT item_id, doc_id, len(list_intersect(a.w, t.w))::DOUBLE / len(a.w) AS score FROM a, t WHERE len(a.w) > 0)
SELECT item_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS n FROM s WHERE score >= 0.3) WHERE n = 1""")
def token_overlap_match(spark, d):
    """The text that holds most of an item's words. Words meet in an equi join, so nothing is crossed."""
    words = F.array_except(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))), F.array(*map(F.lit, match.PLAIN_STOPS)))
    a = table(spark, d, "benchmark").select("item_id", words.alias("w"))
    t = table(spark, d, "documents").select("doc_id", F.explode(match.title_words("text")).alias("word"))
    shared = a.select("item_id", F.size("w").alias("n"), F.explode("w").alias("word")).join(t, "word").groupBy("item_id", "doc_id", "n").count()
    scored = shared.withColumn("score", F.col("count").cast("double") / F.col("n")).where("score >= 0.3")
    return rank.top_per_group(scored, ["item_id"], F.col("score"), ["doc_id"], 1).select("item_id", "doc_id", F.round("score", 6).alias("score"))


@query("""
SELECT c_custkey, coalesce(o.n, 0) AS n_orders, coalesce(nullif(o.status, ''), 'none') AS last_status
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1) o ON c_custkey = o_custkey""")
def left_merge_coalesce(spark, d):
    """A roster with what is cached for it, the last of a name counting."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max_by("o_orderstatus", "o_orderkey").alias("status"))
    rows = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce(F.nullif("status", F.lit("")), F.lit("none")).alias("last_status"))


@query(r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?i)</(?:br|div|li|p|t[drh])[^>]*>', ' ', 'g'), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS plain FROM pages""")
def html_strip(spark, d):
    """T1."""
    return table(spark, d, "pages").select("page_id", tx.clean_html("html").alias("plain"))


@query(r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS title FROM pages""")
def html_title(spark, d):
    """P7, S16."""
    return table(spark, d, "pages").select("page_id", parse.page_title(F.col("html")).alias("title"))


@query(r"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1)) AS url, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2)) AS name,
           generate_subscripts(regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1), 1) - 1 AS pos FROM pages)
SELECT page_id, url, CAST(min(pos) AS INT) AS pos, arg_min(name, pos) AS name FROM l GROUP BY page_id, url""")
def html_links(spark, d):
    """Links as rows, the first of each target."""
    p = r'(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
    pair = F.arrays_zip(*[F.regexp_extract_all("html", F.lit(p), F.lit(i)).alias(n) for i, n in ((1, "u"), (2, "t"))])
    rows = table(spark, d, "pages").select("page_id", F.posexplode(pair).alias("pos", "l"))
    return rows.groupBy("page_id", F.col("l.u").alias("url")).agg(F.min("pos").alias("pos"), F.min_by("l.t", "pos").alias("name"))


@query("""SELECT event_type, count(*) AS n, CAST(min(try_cast(regexp_extract(props, '"k":\\s*(\\d+)', 1) AS BIGINT)) AS BIGINT) AS lo, CAST(max(try_cast(regexp_extract(props, '"k":\\s*(\\d+)', 1) AS BIGINT)) AS BIGINT) AS hi FROM events GROUP BY 1""")
def json_extract_minmax(spark, d):
    """The least and greatest of a number in JSON."""
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min(k).alias("lo"), F.max(k).alias("hi"))


_SPLIT = r"""list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace({t}, '\s+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"""


@query(f"WITH s AS (SELECT doc_id, {_SPLIT.format(t='text')} AS s FROM documents) SELECT doc_id, CAST(len(s) AS INT) AS n, coalesce(s[1], '') AS first, CAST(list_max(list_transform(s, lambda x: length(x))) AS INT) AS longest FROM s")
def sentence_split(spark, d):
    """T10."""
    rows = table(spark, d, "documents").select("doc_id", tx.split_sentences("text").alias("s"))
    return rows.select("doc_id", F.size("s").alias("n"), F.coalesce(F.try_element_at("s", F.lit(1)), F.lit("")).alias("first"), F.array_max(F.transform("s", F.length)).alias("longest"))


_STOP = ", ".join(f"'{w}'" for w in tx.SHORT_STOPS)


@query(f"SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents) WHERE length(word) > 2 AND word NOT IN ({_STOP}) GROUP BY 1 HAVING count(*) >= 5")
def token_freq(spark, d):
    """T11."""
    rows = table(spark, d, "documents").select("doc_id", F.explode(tx.tokens("text")).alias("word"))
    # Counted by text first, so that a frequent word's distinct texts are a count and not a set.
    per = rows.groupBy("word", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("word").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs")).where("n >= 5")


@query(f"""
WITH b AS (SELECT doc_id, regexp_replace(text, '\\s+', ' ', 'g') AS t, array_to_string(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')[1:6], ' ') AS title FROM documents WHERE lang = 'en'),
s AS (SELECT doc_id, title, list_filter({_SPLIT.format(t='t')}, lambda x: length(x) >= 11) AS s FROM b),
w AS (SELECT doc_id, unnest(regexp_extract_all(lower(t), '[a-z]+')) AS w FROM b),
c AS (SELECT doc_id, w, count(*) AS n FROM w WHERE length(w) > 2 AND w NOT IN ({_STOP}) GROUP BY ALL),
mx AS (SELECT doc_id, max(n) AS m FROM c GROUP BY 1),
e AS (SELECT doc_id, unnest(s) AS sent, generate_subscripts(s, 1) - 1 AS i FROM s),
ew AS (SELECT doc_id, i, unnest(regexp_extract_all(lower(sent), '[a-z]+')) AS w FROM e),
ef AS (SELECT * FROM ew WHERE length(w) > 2 AND w NOT IN ({_STOP})),
tw AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(regexp_extract_all(lower(title), '[a-z]+')) AS w FROM b) WHERE length(w) > 2 AND w NOT IN ({_STOP})),
tn AS (SELECT doc_id, count(*) AS n FROM tw GROUP BY 1),
sh AS (SELECT doc_id, i, count(*) AS n FROM (SELECT DISTINCT ef.doc_id, ef.i, ef.w FROM ef JOIN tw ON ef.doc_id = tw.doc_id AND ef.w = tw.w) GROUP BY ALL),
sc AS (SELECT ef.doc_id, ef.i, sum(c.n / mx.m::DOUBLE) / count(*) AS freq, count(*) AS len FROM ef JOIN c ON ef.doc_id = c.doc_id AND ef.w = c.w JOIN mx ON ef.doc_id = mx.doc_id GROUP BY ALL),
f AS (SELECT sc.doc_id, sc.i, round(freq * 0.3 + 0.3 / (1.0 + ln(1 + sc.i::DOUBLE)) + coalesce(coalesce(sh.n, 0)::DOUBLE / tn.n, 0) * 0.25 + (CASE WHEN len BETWEEN 8 AND 30 THEN 1.0 ELSE 0.5 END) * 0.15, 12) AS score
      FROM sc LEFT JOIN sh ON sc.doc_id = sh.doc_id AND sc.i = sh.i LEFT JOIN tn ON sc.doc_id = tn.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS n FROM f),
g AS (SELECT r.doc_id, string_agg(e.sent, ' ' ORDER BY e.i) AS summary FROM r JOIN e ON r.doc_id = e.doc_id AND r.i = e.i WHERE r.n <= 2 GROUP BY 1)
SELECT s.doc_id, CASE WHEN len(s.s) <= 2 THEN array_to_string(s.s, ' ') ELSE coalesce(g.summary, '') END AS summary FROM s LEFT JOIN g ON s.doc_id = g.doc_id""")
def extractive_summary(spark, d):
    """Two sentences that say most of each English text."""
    flat = F.regexp_replace("text", r"\s+", " ")
    title = F.array_join(F.slice(F.split(F.trim(flat), " "), 1, 6), " ")
    rows = table(spark, d, "documents").where("lang = 'en'").select("doc_id", flat.alias("t"), title.alias("title"))
    return rank.extractive_summary(rows, ["doc_id"], "t", "title")


@query(r"""
WITH n AS (SELECT n_nationkey, n_name || ' OF THE ' || r_name || ' COMMITTEE' AS s FROM nation JOIN region ON n_regionkey = r_regionkey),
w AS (SELECT n_nationkey, unnest(string_split(s, ' ')) AS w, generate_subscripts(string_split(s, ' '), 1) AS i FROM n)
SELECT n_nationkey, string_agg(CASE WHEN i > 1 AND lower(w) IN ('a','an','and','at','for','in','of','on','the','to') THEN lower(w) ELSE upper(w[1]) || lower(w[2:]) END, ' ' ORDER BY i) AS body FROM w GROUP BY 1""")
def titleize(spark, d):
    """T2."""
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("n_nationkey", tx.titleize(F.concat("n_name", F.lit(" OF THE "), "r_name", F.lit(" COMMITTEE"))).alias("body"))


_TITLE = "CASE p_partkey % 5 WHEN 0 THEN 'Bylaw No. ' || p_partkey || ' - The ' || p_name || ' Bylaw, 2025' WHEN 1 THEN 'Award of Contract - ' || p_name || ' (Contract No. 25-0456)' WHEN 2 THEN 'Appointments - ' || p_name || ' [CC2025-0402]' WHEN 3 THEN 'Enquiry - ' || p_name || ' - ' ELSE 'The ' || p_name END"


@query("SELECT p_partkey, upper(p_name[1]) || p_name[2:] AS plain FROM part")
def plainify(spark, d):
    """T4: names dressed up as titles come back plain."""
    return table(spark, d, "part").selectExpr("p_partkey", f"{_TITLE} AS t").select("p_partkey", tx.plainify("t").alias("plain"))


@query("""
WITH v AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice * 37) AS BIGINT) AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN v >= 1000000 THEN '$' || replace(printf('%.1f', v / 1000000.0) || 'M', '.0M', 'M') WHEN v >= 100000 THEN '$' || printf('%.0f', v / 1000.0) || 'K'
  ELSE '$' || format('{:,}', v) END AS money FROM v""")
def money(spark, d):
    """T5."""
    v = F.floor(F.col("l_extendedprice") * 37).cast("bigint")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", tx.format_money(F.concat(F.lit("$"), F.format_number(v, 0))).alias("money"))


@query(r"""
WITH t AS (SELECT doc_id, trim(trim(regexp_replace(text, '\s+', ' ', 'g')), ',;:') AS t FROM documents),
c AS (SELECT *, list_transform(['. ', '! ', '? ', '; ', ', '], lambda x: CASE WHEN strpos(reverse(substr(t, 1, 100)), reverse(x)) > 0 THEN length(substr(t, 1, 100)) - strpos(reverse(substr(t, 1, 100)), reverse(x)) - 1 ELSE -1 END) AS cuts FROM t)
SELECT doc_id, CASE WHEN length(t) <= 100 THEN t ELSE coalesce(rtrim(substr(t, 1, CAST(list_filter(cuts, lambda i: i > 20)[1] AS BIGINT)), ',;:'), '') END AS chip FROM c""")
def trim_chip(spark, d):
    """T6."""
    return table(spark, d, "documents").select("doc_id", tx.trim_to_chip(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("chip"))


@query("SELECT o_orderkey, CAST(date_trunc('week', CAST(o_orderdate AS DATE)) AS DATE) AS deadline, strftime(CAST(o_orderdate AS DATE), '%B %-d, %Y') AS readable, strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') || 'T12:00:00-06:00' AS updated FROM orders")
def week_deadline(spark, d):
    """T7, T13, T14."""
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select("o_orderkey", tx.week_deadline(day).alias("deadline"), tx.readable_date(day.cast("string")).alias("readable"), tx.noon(day.cast("string")).alias("updated"))


@query("""
SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1
HAVING bool_and(o_orderstatus = 'F') OR date_diff('day', max(CAST(o_orderdate AS DATE)), DATE '1998-01-15') >= 7""")
def settled_days(spark, d):
    """A3, A4: days all done, or a week old."""
    day = F.col("o_orderdate").cast("date")
    rows = table(spark, d, "orders").select(day.alias("day"), (F.col("o_orderstatus") == "F").alias("done"))
    return rows.groupBy("day").agg(F.count(F.lit(1)).alias("n"), rank.is_settled(F.col("done"), F.col("day"), F.lit("1998-01-15").cast("date")).alias("s")).where("s").select("day", "n")


@query("""
SELECT conv_id, role, CAST(min(turn) AS BIGINT) AS first_turn, arg_min(length(text), turn) AS first_length, count(*) AS turns FROM conversations GROUP BY ALL""")
def roster_first_seen(spark, d):
    """A2: who takes part, as first met."""
    return table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first_turn"), F.min_by(F.length("text").cast("bigint"), "turn").alias("first_length"), F.count(F.lit(1)).alias("turns"))


@query("""
SELECT l_returnflag, count(*) AS agenda_items, count(*) FILTER (l_linestatus = 'O') AS consent_items, count(*) FILTER (l_linestatus <> 'O' AND l_quantity > 10) AS discussed_items FROM lineitem GROUP BY 1""")
def conditional_counts(spark, d):
    """A1."""
    consent = F.col("l_linestatus") == "O"
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("agenda_items"), F.count_if(consent).alias("consent_items"), F.count_if(~consent & (F.col("l_quantity") > 10)).alias("discussed_items"))


@query("""
WITH d AS (SELECT DISTINCT event_type AS category FROM events WHERE event_type <> 'error' UNION ALL SELECT 'never seen'),
u AS (SELECT event_type AS category, count(*) AS chips, count(DISTINCT user_id) AS meetings, count(DISTINCT event_id) AS items FROM events GROUP BY 1)
SELECT coalesce(d.category, u.category) AS category, coalesce(chips, 0) AS chips, coalesce(meetings, 0) AS meetings, round(coalesce(items, 0) / (SELECT count(*) FROM events)::DOUBLE, 9) AS share,
  coalesce(chips, 0) = 0 AS never, coalesce(items, 0) / (SELECT count(*) FROM events)::DOUBLE > 0.3 AS noise, d.category IS NOT NULL AS known FROM d FULL JOIN u ON d.category = u.category""")
def taxonomy_audit(spark, d):
    """Categories never used, noisy or unknown."""
    events = table(spark, d, "events").select(F.col("event_type").alias("category"), F.col("user_id").alias("meeting_id"), F.col("event_id").alias("item_id"))
    known = events.where("category <> 'error'").select("category").distinct().unionByName(spark.range(1).select(F.lit("never seen").alias("category")))
    got = diff.category_audit(events, known, events.count(), 0.3)
    return got.withColumn("share", F.round("share", 9))


@query("""
WITH n AS (SELECT doc_id + (CASE WHEN doc_id % 11 = 0 THEN 1000000 ELSE 0 END) AS doc_id, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS quality FROM labels)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'NEW' WHEN n.doc_id IS NULL THEN 'GONE' WHEN o.quality IS NOT DISTINCT FROM n.quality THEN 'unchanged' ELSE 'changed' END AS change, o.quality AS old, n.quality AS new
FROM labels o FULL JOIN n ON o.doc_id = n.doc_id""")
def snapshot_diff(spark, d):
    """X1."""
    old = table(spark, d, "labels").select("doc_id", "quality")
    new = old.selectExpr("doc_id + CASE WHEN doc_id % 11 = 0 THEN 1000000 ELSE 0 END AS doc_id", "CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS quality")
    return diff.snapshot_diff(old, new, "doc_id", "quality")


@query("""
WITH v AS (SELECT 1 + doc_id % 5 AS f, 1 + doc_id % 4 AS s, toxic FROM labels), a AS (SELECT count(*) FILTER (toxic = 0) AS n, count(*) FILTER (toxic <> 0) AS u, avg(f) FILTER (toxic = 0) AS f, avg(s) FILTER (toxic = 0) AS s, count(*) FILTER (toxic = 0 AND f <= 2) AS low FROM v)
SELECT 'unscored' AS gate, n > 0 AND u > 0 AS failed, u::DOUBLE AS value FROM a UNION ALL SELECT 'mean_faithfulness', n > 0 AND f < 4, round(f, 9) FROM a UNION ALL
SELECT 'mean_specificity', n > 0 AND s < 3, round(s, 9) FROM a UNION ALL SELECT 'faithfulness_floor', n > 0 AND low > 0, low FROM a""")
def gate_report(spark, d):
    """Means, floor and what couldn't be scored."""
    f = F.when(F.col("toxic") == 0, 1 + F.col("doc_id") % 5)
    rows = table(spark, d, "labels").select(f.cast("int").alias("faithfulness"), (1 + F.col("doc_id") % 4).cast("int").alias("specificity"))
    return diff.gates(rows).withColumn("value", F.round("value", 9))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_latest(spark, d):
    """The latest row of each key."""
    return store.latest(table(spark, d, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def missing_work(spark, d):
    """What has no current result."""
    done = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return table(spark, d, "documents").select("doc_id", "source").join(done, "doc_id", "left_anti")


@query("""
SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN event_type = 'error' THEN 0.0 WHEN value IS NULL OR value <= 0 OR value > 180 THEN 0.0 ELSE round(value, 0) END) AS DOUBLE) AS minutes FROM events GROUP BY 1""")
def discussion_time(spark, d):
    """Spans that are broken, inherited or empty count nothing."""
    end = (F.round("value", 0) * 60_000).cast("bigint")
    m = tx.discussion_minutes(F.lit(0).cast("bigint"), F.when(F.col("value") <= 180, end), F.lit(False), F.col("event_type") == "error")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(m).alias("minutes"))


@query("""
SELECT event_id, CASE WHEN s >= 3600 THEN s // 3600 || ':' || lpad(CAST(s % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') ELSE s // 60 || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') END AS clock
FROM (SELECT event_id, event_id * 977 % 20000 AS s FROM events)""")
def clock_format(spark, d):
    """T12."""
    return table(spark, d, "events").select("event_id", tx.clock(F.col("event_id") * 977 % 20000 * 1000).alias("clock"))


@query("""
WITH c AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Director, ' || c_mktsegment WHEN 1 THEN c_mktsegment ELSE ' ' END AS org FROM customer)
SELECT c_custkey, CASE WHEN trim(org) = '' THEN 'Resident' ELSE replace(org, 'Director, ', '') END AS label FROM c""")
def organization_labels(spark, d):
    """M5."""
    org = "CASE c_custkey % 3 WHEN 0 THEN 'Director, ' || c_mktsegment WHEN 1 THEN c_mktsegment ELSE ' ' END AS org"
    return table(spark, d, "customer").selectExpr("c_custkey", org).select("c_custkey", match.organization_label("org").alias("label"))


@query()
def org_colour(spark, d):
    """M4; DuckDB has no crc32."""
    return table(spark, d, "customer").select("c_custkey", match.organization_color("c_mktsegment").alias("colour"))


@query()
def name_phonetic(spark, d):
    """M2."""
    word = F.regexp_extract(F.lower("text"), r"[^\W\d_]{4,}", 0)
    return table(spark, d, "benchmark").select("item_id", word.alias("word"), match.phonetic(word).alias("key"))


@query()
def fuzzy_ratio(spark, d):
    """M1, M3: an item's first words looked for in texts that share one of them."""
    a = table(spark, d, "benchmark").select("item_id", F.slice(F.split(F.lower("text"), r"[^a-z]+"), 1, 2).alias("w"))
    pairs = a.where("size(w) = 2 AND w[0] <> ''").select("item_id", F.array_join("w", " ").alias("name"), F.col("w")[1].alias("word"))
    t = table(spark, d, "documents").select("doc_id", F.lower(F.substring("text", 1, 300)).alias("heard"))
    t = t.withColumn("word", F.explode(F.array_distinct(F.split("heard", "[^a-z]+"))))
    return pairs.join(t, "word").withColumn("m", match.name_tier("name", "heard")).where("m.tier IS NOT NULL").select("item_id", "doc_id", "m.tier", F.round("m.at", 6).alias("at"))


@query("""
WITH i AS (SELECT l_orderkey AS m, l_linenumber AS pos, CASE l_linenumber % 4 WHEN 0 THEN 'Adjournment' WHEN 1 THEN 'Reports' ELSE 'Bridge' END AS title, CASE WHEN l_linenumber % 4 = 2 THEN 'That it be approved' WHEN l_linenumber % 4 = 3 THEN 'That the report be received' ELSE '' END AS rec,
   l_returnflag = 'N' AS inherited, CAST(l_quantity * 4000 AS BIGINT) AS span FROM lineitem)
SELECT m AS meeting_id, count(*) AS items, count(*) FILTER (title = 'Adjournment') AS procedural, count(*) FILTER (rec = '' AND inherited) AS headers,
  count(*) FILTER (inherited AND rec = 'That it be approved') AS consent, count(*) FILTER (title <> 'Adjournment' AND ((inherited AND rec = 'That it be approved') OR (NOT inherited AND span >= 60000))) AS eligible FROM i GROUP BY 1""")
def item_predicates(spark, d):
    """F1, F2, F3, F4, F5."""
    n = F.col("l_linenumber") % 4
    items = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("meeting_id"), F.when(n == 0, "Adjournment").when(n == 1, "Reports").otherwise("Bridge").alias("title"), F.when(n == 2, "That it be approved").when(n == 3, "That the report be received").otherwise("").alias("recommendation"),
        F.lit("").alias("content"), F.lit(0).cast("bigint").alias("time_start_ms"), (F.col("l_quantity") * 4000).cast("bigint").alias("time_end_ms"), (F.col("l_returnflag") == "N").alias("timestamp_inherited"), F.lit(False).alias("is_recess"), F.lit(False).alias("scheduled"),
    )
    return items.groupBy("meeting_id").agg(F.count(F.lit(1)).alias("items"), F.count_if(classify.is_procedural("title")).alias("procedural"), F.count_if(classify.is_section_header()).alias("headers"), F.count_if(classify.is_consent()).alias("consent"), F.count_if(classify.is_eligible()).alias("eligible"))


@query("""
WITH c AS (SELECT l_orderkey AS k, list({'n': l_linenumber, 'c': CASE l_partkey % 5 WHEN 0 THEN 'Outcome' WHEN 1 THEN 'Public Sentiment' WHEN 2 THEN 'Debate Highlight' WHEN 3 THEN 'Dissenting View' ELSE 'Promise Made' END} ORDER BY l_linenumber, l_partkey, l_suppkey) AS x FROM lineitem GROUP BY 1),
u AS (SELECT k, list_filter(list_transform(x, lambda e: e.c), lambda s: s <> 'Outcome') AS s FROM c)
SELECT k, CASE WHEN list_contains(s, 'Dissenting View') THEN 'Dissenting View' WHEN list_contains(s, 'Debate Highlight') THEN 'Debate Highlight' WHEN list_contains(s, 'Promise Made') THEN 'Promise Made' WHEN list_contains(s, 'Public Sentiment') THEN 'Public Sentiment' ELSE '' END AS takeaway,
  CAST(len(list_distinct(s)) AS INT) AS topics, len(s) > 0 AS qualifies FROM u""")
def takeaways(spark, d):
    """The chip to show, by a fixed order of categories."""
    p = F.col("l_partkey") % 5
    cat = F.when(p == 0, "Outcome").when(p == 1, "Public Sentiment").when(p == 2, "Debate Highlight").when(p == 3, "Dissenting View").otherwise("Promise Made")
    chips = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", cat.alias("category"), F.lit("x").alias("text")))), lambda c: F.struct(c["category"].alias("category"), c["text"].alias("text")))
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(chips.alias("chips")).withColumn("description", F.array().cast("array<string>"))
    return rows.select("k", F.coalesce(classify.takeaway()["category"], F.lit("")).alias("takeaway"), F.size(classify.item_topics()).alias("topics"), classify.qualifies().alias("qualifies"))


@query("""
SELECT user_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def hourly_rollup(spark, d):
    """A5's grouping over time, in tumbling windows; the same plan runs as a stream."""
    rows = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("hour"), "n", "total")


def queries() -> dict[str, Query]:
    return _queries | case_queries.queries()


def oracle_sql() -> dict[str, str]:
    return _sql | case_queries.oracle_sql()
