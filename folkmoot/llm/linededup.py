"""Cross-site removal of boilerplate lines.

A line is boilerplate when it stands on at least ``min_sites`` distinct sites.
Per line hash a HyperLogLog sketch of its sites is built and merged by
aggregation, so what is shuffled per line is a sketch of bounded size however
often the line occurs. Lines whose estimate is clear of the threshold are
decided by it; lines within ``band`` of the threshold get exact distinct counts
from their own occurrences, which are the only ones joined back.

A document of which more than ``max_loss`` of the text would go is left whole
where its whole text stands on another document as well: it is a copied page, of
which the near-duplicate stage keeps one. All others lose their boilerplate,
however much of them it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folkmoot.llm.common import Intake, row_key

MIN_SITES = 10
MAX_LOSS = 0.8


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda x: F.trim(x))


def _hash(line: Column) -> Column:
    """96 bits, so that no two lines of a large corpus are likely to meet."""
    return F.struct(F.xxhash64(line).alias("a"), F.hash(line).alias("b"))


def spread(lines: DataFrame, min_sites: int, lg_k: int, band: float) -> DataFrame:
    """(h, sure): line hashes whose estimate reaches the band; sure: beyond it.

    ``lines`` has (h, site). Null sites don't count.
    """
    est = lines.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("est"))
    return est.where(F.col("est") >= min_sites * (1 - band)).select("h", (F.col("est") > min_sites * (1 + band)).alias("sure"))


def copied(rows: DataFrame, text: Column) -> DataFrame:
    """(j1, j2): keys of rows whose whole text stands on rows of other ids too. ``rows`` has k1 and k2."""
    keyed = rows.where(F.trim(text) != "").select("k1", F.col("k1").alias("j1"), F.col("k2").alias("j2"), F.xxhash64(F.lit(1), text).alias("t1"), F.xxhash64(F.lit(2), text).alias("t2"))
    several = keyed.groupBy("t1", "t2").agg(F.min("k1").alias("a"), F.max("k1").alias("b")).where("a <> b").select("t1", "t2")
    return keyed.join(several, ["t1", "t2"], "left_semi").select("j1", "j2").distinct()


def line_dedup(
    df: DataFrame,
    min_sites: int = MIN_SITES,
    max_loss: float = MAX_LOSS,
    lg_k: int = 12,
    band: float = 0.15,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    counts: bool = False,
    length_col: str | None = None,
) -> DataFrame:
    """The rows of ``df`` with boilerplate lines cut from the text.

    Lines are compared after trimming spaces; blank lines are never counted or
    cut. A null text stays null; an empty text stays empty; a null site counts
    for no line. Rows that repeat are cut alike, and a repeated row adds no site.
    All columns and all rows are kept, and ``length_col``, where one is named, is
    set to the length of texts that were cut; with ``counts`` the result is instead
    (doc_id, text, n_lines, n_removed). The band is about nine standard errors
    of a sketch with 2**12 registers, whose error is 1.04 / sqrt(2**lg_k).
    """
    took = Intake(df, id_col, text_col, site_col)
    text, keys = took[text_col].cast("string"), row_key(took[id_col], took[text_col])
    rows = took.rows.select("*", *keys)
    lines = (
        took.rows.where(text.isNotNull())
        .select(took[site_col].cast("string").alias("site"), *keys, F.explode(F.array_distinct(_lines(text))).alias("line"))
        .where(F.col("line") != "")
        .select("site", "k1", "k2", _hash(F.col("line")).alias("h"))
    )
    wide = spread(lines.select("h", "site"), min_sites, lg_k, band)
    found = lines.join(wide, "h")
    # Only the sites of lines within the band are counted exactly.
    exact = found.groupBy("h").agg(F.max("sure").alias("sure"), F.countDistinct(F.when(~F.col("sure"), F.col("site"))).alias("n"))
    cut = exact.where(F.col("sure") | (F.col("n") >= min_sites)).select("h")
    drops = found.join(cut, "h").groupBy(F.col("k1").alias("j1"), F.col("k2").alias("j2")).agg(F.collect_set("h").alias("cut"))
    drops = drops.join(copied(rows, text).withColumn("copy", F.lit(True)), ["j1", "j2"], "left")
    joined = rows.join(drops, (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2")), "left")

    def size(ls: Column) -> Column:
        return F.aggregate(ls, F.lit(0).cast("long"), lambda n, x: n + F.length(F.trim(x)))

    whole = F.split(text, "\n")
    kept = F.filter(whole, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("cut"), _hash(F.trim(x))))
    joined = joined.withColumn("kept", F.when(F.col("cut").isNotNull(), kept))
    over = (size(whole) - size(F.col("kept"))) > size(whole) * F.lit(float(max_loss))
    joined = joined.withColumn("kept", F.when(over & F.col("copy"), F.lit(None)).otherwise(F.col("kept")))
    clean = F.when(F.col("kept").isNull(), text).otherwise(F.array_join("kept", "\n"))
    if not counts:
        if length_col is None:
            return took.replace(joined, text_col, clean)
        joined = joined.withColumn("clean", clean)
        at = Intake(df, length_col)._at[length_col]
        kind = took.rows.schema[at].dataType
        joined = joined.withColumn(at, F.when(F.col("kept").isNull(), F.col(at)).otherwise(F.length("clean").cast(kind)))
        return took.replace(joined, text_col, F.col("clean"))
    n = F.size(whole)
    return joined.select(
        took[id_col].alias("doc_id"),
        clean.alias("text"),
        F.when(text.isNotNull(), n).alias("n_lines"),
        F.when(text.isNotNull(), n - F.size(F.coalesce(F.col("kept"), whole))).alias("n_removed"),
    )


def line_dedup_sql(min_sites: int = MIN_SITES, max_loss: float = MAX_LOSS, counts: bool = True, docs: str = "documents") -> str:
    """The same in SQL, with exact counts throughout."""
    out = "doc_id, text, n_lines, n_removed" if counts else "doc_id, text, lang, source, n_chars"
    return f"""
WITH d AS (SELECT *, row_number() OVER () AS rid FROM {docs}),
l AS (
  SELECT rid, source, unnest(string_split(text, chr(10))) AS raw,
         generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d WHERE text IS NOT NULL),
copied AS (SELECT text FROM {docs} WHERE trim(text, ' ') <> '' GROUP BY text HAVING count(DISTINCT doc_id) > 1),
w AS (SELECT trim(raw, ' ') AS line FROM l WHERE trim(raw, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {min_sites}),
m AS (SELECT l.*, w.line IS NOT NULL AS cut FROM l LEFT JOIN w ON trim(l.raw, ' ') = w.line),
s AS (
  SELECT rid, coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT cut), '') AS cleaned, count(*) AS n_lines,
         count(*) FILTER (cut) AS n_cut,
         coalesce(sum(length(trim(raw, ' '))) FILTER (cut), 0) > sum(length(trim(raw, ' '))) * {max_loss}::DOUBLE AS over
  FROM m GROUP BY rid),
r AS (
  SELECT d.* EXCLUDE (text, rid), CASE WHEN s.rid IS NULL OR (s.over AND c.text IS NOT NULL) THEN d.text ELSE s.cleaned END AS text,
         CAST(s.n_lines AS INT) AS n_lines, CAST(CASE WHEN s.over AND c.text IS NOT NULL THEN 0 ELSE s.n_cut END AS INT) AS n_removed
  FROM d LEFT JOIN s ON d.rid = s.rid LEFT JOIN copied c ON d.text = c.text)
SELECT {out} FROM r"""
