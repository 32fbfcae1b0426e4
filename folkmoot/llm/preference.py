"""Preference formatting of chosen and rejected conversations.

The longest common prefix of turns is rendered once, as the prompt; what follows
on either side is a completion, with the character ranges that a loss counts:
the assistant's words and their end mark. All of it is array functions over one
row a pair, after one grouping by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folkmoot.llm.common import Intake

START, END = "<|im_start|>", "<|im_end|>"


def _turns(df: DataFrame, side: str, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    rows = Intake(df, id_col, turn_col, role_col, text_col).narrow(pair=id_col, turn=turn_col, role=role_col, text=text_col)
    rows = rows.where("pair IS NOT NULL AND turn IS NOT NULL").select("pair", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    turn = F.struct("turn", "role", "text")
    return rows.groupBy("pair").agg(F.array_sort(F.collect_list(turn)).alias("t")).select("pair", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias(side))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit("\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(END + "\n"))), "")


def _ranges(turns: Column) -> Column:
    """(start, stop) of what the assistant says, with its end mark, in the rendered turns."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("got"))

    def add(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(_head(t))
        stop = start + F.length(t["text"]) + len(END)
        more = F.array(F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop")))
        return F.struct((stop + 1).alias("at"), F.when(t["role"] == "assistant", F.concat(acc["got"], more)).otherwise(acc["got"]).alias("got"))

    return F.aggregate(turns, zero, add, lambda acc: acc["got"])


def preference_format(chosen: DataFrame, rejected: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(pair_id, n_prompt, prompt, chosen, chosen_mask, rejected, rejected_mask): a row for each id on both sides.

    Turns are ordered by turn, then role and text, so ties and repeated rows have
    one order; repeated turns stay. A turn's null role or text counts as empty;
    rows with a null id or turn belong nowhere and are left out, as are ids on
    one side only. Equal conversations give empty completions and masks, as
    nothing is left after the prompt. Other columns aren't read.
    """
    args = (id_col, turn_col, role_col, text_col)
    both = _turns(chosen, "a", *args).join(_turns(rejected, "b", *args), "pair")
    size = F.least(F.size("a"), F.size("b"))
    same = F.zip_with(F.slice("a", 1, size), F.slice("b", 1, size), lambda x, y: x == y)
    n = F.when(F.array_position(same, False) > 0, (F.array_position(same, False) - 1).cast("int")).otherwise(size)
    both = both.withColumn("n", n)
    rest = {c: F.slice(c, F.col("n") + 1, F.size(c)) for c in ("a", "b")}
    return both.select(
        F.col("pair").alias("pair_id"),
        F.col("n").alias("n_prompt"),
        _rendered(F.slice("a", 1, F.col("n"))).alias("prompt"),
        _rendered(rest["a"]).alias("chosen"),
        _ranges(rest["a"]).alias("chosen_mask"),
        _rendered(rest["b"]).alias("rejected"),
        _ranges(rest["b"]).alias("rejected_mask"),
    )


def rejected_sides(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", pool: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(chosen, rejected) of conversations of which only one side was recorded; both have all turns of all conversations.

    Chosen is the conversation; rejected is the same with the text of the
    assistant's last turn replaced. Where the assistant spoke before, its turn
    before the last stands there, a reply to something else. Where it spoke once,
    another conversation's last reply does: one of ``pool`` that are chosen by a
    hash of their conversation, picked by a hash of this one; the empty text, if
    there is no other conversation. Where it never spoke, both sides are equal.
    Rows with a null id or turn are left out, a null text counts as empty; of
    replies at one turn the greatest text is the last.
    """
    rows = Intake(conversations, id_col, turn_col, role_col, text_col).narrow(id=id_col, turn=turn_col, role=role_col, text=text_col).where("id IS NOT NULL AND turn IS NOT NULL")
    rows = rows.select("id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    said = F.when(F.col("role") == "assistant", F.struct("turn", "text"))
    ends = rows.groupBy(F.col("id").alias("of")).agg(F.slice(F.reverse(F.array_sort(F.collect_list(said))), 1, 2).alias("last"))
    key = F.col("of").cast("string")
    # At most ``pool`` rows pass through the one window without a key.
    donors = ends.where(F.size("last") > 0).select(F.md5(key).alias("h"), "of", F.get("last", F.lit(0))["text"].alias("given")).orderBy("h", "of").limit(pool)
    donors = donors.withColumn("k", F.row_number().over(Window.orderBy("h", "of")) - 1).drop("h")
    many = donors.agg(F.count(F.lit(1)).alias("many"))
    needy = ends.where(F.size("last") == 1).select("of", F.conv(F.substring(F.md5(F.concat(F.lit("reject|"), key)), 1, 8), 16, 10).cast("long").alias("n")).crossJoin(many)
    one, two = (donors.toDF(f"of{i}", f"given{i}", f"k{i}") for i in (1, 2))
    needy = needy.join(one, F.col("n") % F.col("many") == F.col("k1"), "left").join(two, (F.col("n") + 1) % F.col("many") == F.col("k2"), "left")
    lent = needy.select(F.col("of").alias("to"), F.when(F.col("of1") != F.col("of"), F.col("given1")).when(F.col("of2") != F.col("of"), F.col("given2")).otherwise("").alias("lent"))
    ends = ends.join(lent, F.col("of") == F.col("to"), "left").select("of", F.get("last", F.lit(0)).alias("end"), F.coalesce(F.get("last", F.lit(1))["text"], "lent").alias("other"))
    both = rows.join(ends, F.col("id") == F.col("of"))
    at = (F.col("role") == "assistant") & (F.col("turn") == F.col("end.turn")) & (F.col("text") == F.col("end.text"))
    names = (id_col, turn_col, role_col, text_col)
    return rows.toDF(*names), both.select("id", "turn", "role", F.when(at, F.col("other")).otherwise(F.col("text"))).toDF(*names)


def preference_sql(pool: int = 1024) -> str:
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS k
      FROM c WHERE role = 'assistant'),
d AS (SELECT conv_id AS whose, text AS given, row_number() OVER (ORDER BY md5(CAST(conv_id AS VARCHAR)), conv_id) - 1 AS k FROM r WHERE k = 1),
q AS (SELECT * FROM d WHERE k < {pool}),
e AS (SELECT a.conv_id, a.turn AS last, a.text AS said,
             coalesce(b.text, CASE WHEN x.whose <> a.conv_id THEN x.given WHEN y.whose <> a.conv_id THEN y.given ELSE '' END) AS other
      FROM (SELECT *, CAST('0x' || substr(md5('reject|' || CAST(conv_id AS VARCHAR)), 1, 8) AS BIGINT) AS n FROM r WHERE k = 1) a
      CROSS JOIN (SELECT count(*) AS many FROM q) m
      LEFT JOIN r b ON a.conv_id = b.conv_id AND b.k = 2
      LEFT JOIN q x ON x.k = a.n % m.many LEFT JOIN q y ON y.k = (a.n + 1) % m.many),
t AS (SELECT c.conv_id, c.turn, c.role, c.text AS ta,
             CASE WHEN c.role = 'assistant' AND c.turn = e.last AND c.text = e.said THEN e.other ELSE c.text END AS tb,
             row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn, c.role, c.text) AS i
      FROM c LEFT JOIN e ON c.conv_id = e.conv_id),
p AS (SELECT conv_id, coalesce(min(i) FILTER (ta <> tb) - 1, count(*)) AS n FROM t GROUP BY 1),
x AS (SELECT t.*, p.n, '{START}' || role || chr(10) || ta || '{END}' || chr(10) AS sa,
             '{START}' || role || chr(10) || tb || '{END}' || chr(10) AS sb,
             length('{START}' || role || chr(10)) AS head
      FROM t JOIN p USING (conv_id)),
y AS (SELECT *, coalesce(sum(length(sa)) FILTER (i > n) OVER w, 0) AS qa, coalesce(sum(length(sb)) FILTER (i > n) OVER w, 0) AS qb
      FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id AS pair_id, CAST(any_value(n) AS INT) AS n_prompt,
       coalesce(string_agg(sa, '' ORDER BY i) FILTER (i <= n), '') AS prompt,
       coalesce(string_agg(sa, '' ORDER BY i) FILTER (i > n), '') AS chosen,
       coalesce(string_agg((qa + head) || ':' || (qa + length(sa) - 1), ' ' ORDER BY i) FILTER (i > n AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(sb, '' ORDER BY i) FILTER (i > n), '') AS rejected,
       coalesce(string_agg((qb + head) || ':' || (qb + length(sb) - 1), ' ' ORDER BY i) FILTER (i > n AND role = 'assistant'), '') AS rejected_mask
FROM y GROUP BY conv_id"""
