"""Lines that many sites share: cross-site boilerplate by distinct-site spread.

Lines are known by 128 bits of hash. For each, a HyperLogLog sketch of the
sites (the source column) that have it is built straight from the lines, on the
map side, and merged by aggregation. A line whose estimate is clearly above or
below the least number of sites is decided by its sketch; near the limit the
exact number of distinct sites is counted, for these lines alone. Lines above
it are taken out of every document. Only built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlattice.llm._common import attach_groups, cut, table

#: log2 of the sketch's registers: a relative error of about 1.04 / 2**6, so MARGIN is six of them.
REGISTERS = 12
MARGIN = 0.10
#: Up to so many lines (16 bytes of hash each) are broadcast; beyond, lines are shuffled to them.
BROADCAST_LINES = 400_000


def _keys(line: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1).cast("long"), line).alias("h1"), F.xxhash64(F.lit(2).cast("long"), line).alias("h2")


def lines_of(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """doc_id, text_key, site, line of each line with a word; lines end with line feeds."""
    line = F.explode(F.split(F.col(text_col), "\n", -1)).alias("line")
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), line).filter(F.length(F.trim(F.translate("line", "\t\x0b\x0c\r", "    "))) > 0)


def _of(lines: DataFrame, which: DataFrame, n: int, spread: str) -> DataFrame:
    """The lines (h1, h2, ...) that are in which (h1, h2, n: rows of each line); its number of rows is n."""
    if n <= BROADCAST_LINES:
        return lines.join(F.broadcast(which.select("h1", "h2")), ["h1", "h2"], "left_semi")
    return attach_groups(lines, which, ["h1", "h2"], "n", which.agg(F.sum("n")).first()[0], spread).filter("n IS NOT NULL").drop("n")


def spread_of_lines(docs: DataFrame, least_sites: int = 3, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Lines that sketches hold to be shared, and lines that are too near the limit for them: each h1, h2, n (how often it is met), sites (estimated)."""
    seen = lines_of(docs, id_col, text_col, site_col).select(*_keys(F.col("line")), "site")
    merged = seen.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(REGISTERS)).alias("sketch"), F.count("*").alias("n"))
    sites = F.hll_sketch_estimate("sketch").alias("sites")
    # what is clearly below the limit is not written; estimates are rounded to whole numbers
    met = cut(merged.select("h1", "h2", "n", sites).filter(F.col("sites") + 0.5 >= least_sites * (1 - MARGIN)))
    clear = F.col("sites") > least_sites * (1 + MARGIN)
    return met.filter(clear), met.filter(~clear)


def shared_lines(docs: DataFrame, least_sites: int = 3, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """h1, h2, n of the lines on `least_sites` distinct sites or more; n counts the documents' lines."""
    sure, near = spread_of_lines(docs, least_sites, id_col, text_col, site_col)
    n = near.count()
    if not n:
        return sure.select("h1", "h2", "n")
    seen = lines_of(docs, id_col, text_col, site_col).select(*_keys(F.col("line")), "site")
    pairs = _of(seen, near.select("h1", "h2", "n"), n, "site").groupBy("h1", "h2", "site").agg(F.count("*").alias("n"))
    exact = pairs.groupBy("h1", "h2").agg(F.count("*").alias("sites"), F.sum("n").alias("n")).filter(F.col("sites") >= least_sites)
    return sure.select("h1", "h2", "n").unionByName(exact.select("h1", "h2", "n"))


def without_shared_lines(docs: DataFrame, least_sites: int = 3, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """doc_id, n_lines, n_removed, clean_text for each row of docs.

    Removed lines go with their line feed; the others keep order and place. A
    line without a word is never removed; one on exactly `least_sites` sites is.
    A null text has no lines and stays null; a null site is a site of its own,
    the same as an empty one. Repeated rows are treated alike. Other columns are
    not read, so their names may clash. An empty table gives an empty table. A
    text is one value in memory with its lines, at most twice its size.
    """
    bad = cut(shared_lines(docs, least_sites, id_col, text_col, site_col))
    lines = lines_of(docs, id_col, text_col, site_col).select("doc_id", "text_key", *_keys(F.col("line")))
    hits = _of(lines, bad, bad.count(), "doc_id")
    per_doc = hits.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.collect_set(F.struct("h1", "h2")).alias("__bad"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # the key spreads rows without a doc_id
    rows = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key")), "left")
    split = F.split("text", "\n", -1)
    key = lambda x: F.struct(*_keys(x))
    kept = F.when(F.col("__bad").isNull(), split).otherwise(F.filter(split, lambda x: ~F.array_contains("__bad", key(x))))
    rows = rows.withColumn("__kept", kept)
    return rows.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"), F.when(F.col("text").isNull(), 0).otherwise(F.size(split) - F.size("__kept")).cast("long").alias("n_removed"), F.array_join("__kept", "\n").alias("clean_text"))


def op2(spark, sf_dir: str) -> DataFrame:
    return without_shared_lines(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents
), bad AS (
  SELECT line FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line HAVING count(DISTINCT coalesce(source, '')) >= 3
), m AS (
  SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (bad.line IS NOT NULL) AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY i) FILTER (bad.line IS NULL), '') AS clean_text
  FROM l LEFT JOIN bad ON bad.line = l.line GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, clean_text FROM documents d LEFT JOIN m USING (doc_id)
"""
