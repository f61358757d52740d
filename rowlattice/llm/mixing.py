"""Mixing sources to target weights by entropy balancing.

The rates r of the documents of a source minimise the Kullback-Leibler
divergence from one copy each, under the constraint that the taken words meet
the source's target and that no rate is above `cap`. The solution is an
exponential tilt, r = min(cap, exp(lambda * size / unit)), with one dual
variable for each source. Newton steps on the convex dual find it: each step is
one aggregation over the (source, size) histogram, and the dual variables are a
table themselves, so the driver holds single numbers however many sources there
are. Rates are fixed-point numbers, so that sums are exact and reruns agree.
They become copies by error diffusion, from long to short documents, in cells
of about `cell_docs` documents of one source.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from rowlattice.llm._common import WORD, attach_groups, cut, small_side, table

ONE = 1 << 20  # a rate of 1
#: Up to so many sources are broadcast.
BROADCAST_SOURCES = 100_000


def ranked(sources: DataFrame) -> DataFrame:
    """sources (source, ...) with rank: its place from 0 in code-point order, null last; no task has more than about BROADCAST_SOURCES of them."""
    order = F.col("source").asc_nulls_last()
    parts = max(1, -(-sources.count() // BROADCAST_SOURCES))
    placed = cut(sources.repartitionByRange(parts, order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each partition
    offsets = placed.groupBy(F.col("__part").alias("__p")).agg(F.count("*").alias("__n")).select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return placed.join(F.broadcast(offsets), F.col("__part") == F.col("__p")).withColumn("rank", F.col("__offset") + inside - 1).drop("__part", "__p", "__offset")


def with_targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """sources (source, words, ...) with target: the words to take.

    Sources in code-point order, null last, weigh `weights`, repeating, and
    share the sum of all words. A target stops at cap times its source's words;
    what is left over goes to the others by weight until none is above.
    """
    of = F.get(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights)).cast("int"))
    state = cut(ranked(sources).withColumn("weight", of).drop("rank").withColumn("full", F.lit(False)))
    most = (F.col("words") * cap).cast("decimal(38,0)")
    while True:
        total, gone, open_ = state.agg(F.sum(F.col("words").cast("decimal(38,0)")), F.sum(F.when(F.col("full"), most)), F.sum(F.when(~F.col("full"), F.col("weight")))).first()
        share = float((total or 0) - (gone or 0)) / open_ if open_ else 0.0
        above = ~F.col("full") & (F.lit(share) * F.col("weight") > cap * F.col("words"))
        if state.filter(above).isEmpty():
            return state.withColumn("target", F.when(F.col("full"), most.cast("double")).otherwise(F.lit(share) * F.col("weight"))).drop("full", "weight")
        state = cut(state.withColumn("full", F.col("full") | above))


def _rate(tilt, size, unit, cap: int):
    """Fixed-point rate of a document."""
    x = F.least(tilt * size / unit, F.lit(math.log(cap) + 1))
    return F.least(F.lit(cap * ONE).cast("long"), F.round(F.exp(x) * ONE).cast("long"))


def _beside(rows: DataFrame, sources: DataFrame, n: int, n_rows: int, spread: str) -> DataFrame:
    """rows with the columns of their source's row; sources has rows_of, how many of them a source has, and n rows."""
    if n <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(sources.withColumnRenamed("source", "__source")), F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "rows_of")
    return attach_groups(rows, cut(sources), ["source"], "rows_of", n_rows, spread).drop("rows_of")


def solve(hist: DataFrame, sources: DataFrame, cap: int = 3, steps: int = 200, near: float = 1e-5) -> DataFrame:
    """sources (source, words, unit, target, rows_of: rows of hist) with tilt: the dual variable, by safeguarded Newton steps (bisection where a step leaves its bracket).

    hist: source, size, n. A bracket has no end on a side until a measured tilt
    is past the target there; steps to an open side reach twice as far each
    time, as long documents make the unit large and the tilts that ordinary ones
    need with it. Where fixed-point rates can't meet a target to `near`, the
    nearest tilt is taken. RuntimeError if that is off by more than the rates'
    rounding.
    """
    n, n_rows = sources.count(), hist.count()
    col, inf = F.col, F.lit(math.inf)
    asked = (col("words") > 0) & (col("target") < cap * col("words") * (1 - 1e-9))
    # a source that isn't asked takes cap copies of everything
    start = F.when(asked, F.lit(0.0)).otherwise((math.log(cap) + 1) * col("unit"))
    state = cut(sources.withColumns({"asked": asked, "open": asked, "tilt": start, "best": start, "best_off": F.when(asked, inf).otherwise(F.lit(0.0)), "low": -inf, "high": inf, "reach": F.lit(60.0)}))
    left = state.filter("open").count()
    for _ in range(steps):
        if not left:
            break
        words = (col("n") * col("size")).cast("decimal(38,0)")
        tried = _beside(hist, state.filter("open").select("source", "tilt", "unit", "rows_of"), n, n_rows, "size").withColumn("r", _rate(col("tilt"), col("size"), col("unit"), cap))
        got = tried.groupBy(col("source").alias("__source")).agg(F.sum(words * col("r")).cast("double").alias("taken"), F.sum(F.when(col("r") < cap * ONE, words * col("r") * col("size"))).cast("double").alias("slope"))
        now = state.join(small_side(got, n, BROADCAST_SOURCES), col("source").eqNullSafe(col("__source")) & col("open"), "left").drop("__source")
        now = now.withColumns({"off": col("taken") / ONE - col("target"), "slope": F.coalesce(col("slope"), F.lit(0.0)) / ONE / col("unit")})
        better = F.abs("off") < col("best_off")
        now = now.withColumns({"best": F.when(better, col("tilt")).otherwise(col("best")), "best_off": F.when(better, F.abs("off")).otherwise(col("best_off")), "low": F.when(col("off") <= 0, col("tilt")).otherwise(col("low")), "high": F.when(col("off") > 0, col("tilt")).otherwise(col("high"))})
        now = now.withColumn("step", F.when(col("slope") > 0, col("tilt") - col("off") / col("slope")).otherwise(inf))
        within = (col("low") < col("step")) & (col("step") < col("high"))
        endless = (col("low") == -inf) | (col("high") == inf)
        far = endless & ~(within & (F.abs("step") < col("reach")))
        tilt = F.when(far, -F.signum("off") * col("reach")).when(within, col("step")).otherwise((col("low") + col("high")) / 2)
        more = (F.abs("off") > near * col("target")) & (endless | (col("high") - col("low") > 1e-10 * F.greatest(F.lit(10.0), F.abs(tilt))))
        seen = Observation()
        now = now.select(*[c for c in state.columns if c not in ("open", "tilt", "reach")], (col("open") & F.coalesce(more, F.lit(False))).alias("open"), F.when(col("open"), tilt).otherwise(col("tilt")).alias("tilt"), F.when(F.coalesce(far, F.lit(False)), col("reach") * 2).otherwise(col("reach")).alias("reach"))
        state = cut(now.observe(seen, F.count(F.when(col("open"), 1)).alias("n")))
        left = seen.get["n"]
    missed = state.filter(col("asked") & (col("best_off") > near * col("target") + col("words") / ONE)).first()
    if missed:
        raise RuntimeError(f"mixing: no rates found for source {missed['source']!r} in {steps} steps, {missed['best_off']:.0f} words from its target {missed['target']:.0f}")
    return state.select(*sources.columns, col("best").alias("tilt"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, cell_docs: int = 512, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, text_key, size, source_size, target, rate, copies, taken: a row for each row of docs.

    size counts the words of the text (a null text has none). A document
    without words has one copy, which adds nothing. Rows that repeat a doc_id,
    source and text have the same copies; of equally long documents the one with
    the larger doc_id is rounded first. A null source is a source of its own.
    An empty table gives an empty table. Other columns are not read, so their
    names may clash. A text and its words are in memory at once.
    """
    size = F.coalesce(F.size(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")
    size = F.when(F.col(text_col).isNull(), F.lit(0).cast("long")).otherwise(size)
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.xxhash64(text_col).alias("text_key"), size.alias("size")).groupBy("doc_id", "source", "text_key", "size").agg(F.count("*").alias("n")))
    hist = cut(rows.groupBy("source", "size").agg(F.sum("n").alias("n"), F.count("*").alias("items")))
    squares = F.sum((F.col("size") * F.col("size")).cast("decimal(38,0)") * F.col("n")).cast("double")
    stats = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), squares.alias("squares"), F.sum("items").alias("items"), F.count("*").alias("rows_of"))
    stats = stats.withColumn("unit", F.when(F.col("words") > 0, F.greatest(F.lit(1.0), F.col("squares") / F.col("words"))).otherwise(F.lit(1.0)))
    solved = cut(solve(hist.select("source", "size", "n"), cut(with_targets(stats, weights, cap)), cap))
    known = solved.select("source", "tilt", "unit", F.ceil(F.col("items") / cell_docs).cast("long").alias("cells"), F.col("words").alias("source_size"), "target", F.col("items").alias("rows_of"))
    items = _beside(rows, known, known.count(), rows.count(), "doc_id")
    items = items.select("doc_id", "source", "text_key", "size", "n", "source_size", "target", _rate(F.col("tilt"), F.col("size"), F.col("unit"), cap).alias("rate"), F.pmod(F.xxhash64("doc_id", "size", "text_key"), F.col("cells")).alias("cell"))
    cells = items.groupBy("source", "cell", "source_size", "target").agg(F.sort_array(F.collect_list(F.struct((F.col("size") * F.col("n")).alias("words"), "doc_id", "size", "n", "rate", "text_key")), asc=False).alias("items"))

    def place(state, item):
        whole = item["words"] * ONE
        want = state["carry"] + item["words"] * item["rate"]
        nearest = F.floor((want + whole / 2) / whole).cast("long")
        least = F.greatest(F.floor(item["rate"] / ONE).cast("long") - 1, F.lit(0).cast("long"))
        most = F.least(F.ceil(item["rate"] / ONE).cast("long") + 1, F.lit(cap).cast("long"))
        copies = F.when(item["words"] == 0, F.lit(1).cast("long")).otherwise(F.greatest(least, F.least(most, nearest)))
        return F.struct((want - copies * whole).alias("carry"), F.concat(state["copies"], F.array(copies)).alias("copies"))

    start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("copies"))
    placed = cells.withColumn("copies", F.aggregate("items", start, place, lambda s: s["copies"]))
    flat = placed.select("source", "source_size", "target", F.explode(F.arrays_zip("items", "copies")).alias("x"))
    out = flat.select(F.col("x.items.doc_id").alias("doc_id"), "source", F.col("x.items.text_key").alias("text_key"), F.col("x.items.size").alias("size"), "source_size", "target", (F.col("x.items.rate") / ONE).alias("rate"), F.col("x.copies").alias("copies"), (F.col("x.copies") * F.col("x.items.size")).alias("taken"), F.col("x.items.n").alias("n"))
    return out.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).drop("n")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns."""
    made = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    made = made.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("text_key").alias("__key"), F.col("copies").alias("__copies")).distinct()
    # the key of the text tells rows of one doc_id apart, and spreads those without one
    same = F.col(id_col).eqNullSafe(F.col("__id")) & F.col(source_col).cast("string").eqNullSafe(F.col("__source")) & (F.xxhash64(text_col) == F.col("__key"))
    joined = docs.join(made, same)
    return joined.filter("__copies > 0").withColumn("__copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)


def op7(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")
