"""Jaccard similarity join of documents on word shingles, and its components.

Adaptive multi-match prefixes. The shingles of all documents have one order:
rare ones by hash, then frequent ones by frequency. Two sets with Jaccard
similarity t share a shingle among the first |x| - ceil(t |x|) + 1 of each, and
l shingles among the first |x| - ceil(t |x|) + l. A document whose prefix
reaches frequent shingles is expected to meet many candidates; its prefix is
lengthened by 1 to 3, and with a partner whose prefix is as long it must share
as many more shingles before the pair is verified. Counts and places of the
shared shingles also bound the overlap from above.

Documents with equal sets are one node. Pairs that share a rare prefix shingle
come from a join on short lists; lists of more than LONG documents have a path
of their own. There, a list is compared with some of its documents at a time
(stars), and what is not in the largest component by then is compared with the
rest in blocks: by prefixes with as many matches as both ask for, then by whole
sets. A block emits only links that join components, and none twice, so groups
of thousands of near copies emit no lists of pairs and no component is lost.
Every pair that links two documents is verified on whole sets.

Shingles are known by 64-bit hashes, which are not compared with the words: of
n different shingles, two share a hash with a chance of about n * n / 2**65,
and it changes a result only if it tips a pair that is at the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlattice.llm._common import attach_groups, cut, one_row_each, small_batches, small_side, table, without
from rowlattice.llm._words import Block, blocks, mix
from rowlattice.llm.graph import components, labelled, merged

#: Frequent shingles are those of more than LONG documents, and of at least as many as leave no more than FREQUENT of them; they are broadcast.
FREQUENT = 1 << 22
LONG = 16
MOST_EXTRA = 3
STARS = 3
BROADCAST_IDS, BROADCAST_PAIRS = 1_000_000, 400_000
_SALT = np.uint64(0x5851F42D4C957F2D)


def shingle_sets(b: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each distinct shingle, by text, then hash. A text of fewer than `size` words is one shingle; one without words has none."""
    h, at = b.windows(size)
    d = b.doc[at]
    short = np.flatnonzero((b.n_words > 0) & (b.n_words < size))
    if len(short):
        first = np.searchsorted(b.doc, short)
        whole = b.n_words[short].astype(np.uint64)
        for j in range(size - 1):
            there = b.n_words[short] > j
            whole[there] = mix(whole[there] * _SALT + b.words[first[there] + j])
        h, d = np.concatenate([h, whole]), np.concatenate([d, short])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return d[new], h[new]


def _prints(d: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two order-free 64-bit fingerprints of each text's set."""
    sizes = np.bincount(d, minlength=n)
    out = []
    for salt in (np.uint64(0), _SALT):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ salt), dtype=np.uint64)])
        ends = np.cumsum(sizes)
        out.append((sums[ends] - sums[ends - sizes]).view(np.int64))
    return sizes, *out


def frequent_shingles(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """token, n: for the shingles that prefixes may hold, in how many documents they are met.

    Rare shingles are ordered by hash, so prefixes hold the smallest hashes; a
    third more than a prefix of them are counted, for the room that frequent
    ones leave. Documents whose sets are equal count once in a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for _, b in blocks(batches, 0, lower=True):
            d, h = shingle_sets(b, size)
            sizes, x, y = _prints(d, h, b.n)
            first = np.zeros(b.n, bool)
            for i, k in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
                if k not in seen:
                    seen.add(k)
                    first[i] = True
            pool = np.where(first, (sizes - sizes * percent // 100) * 4 // 3 + 2, 0)
            rank = np.arange(len(h)) - (np.cumsum(sizes) - sizes)[d]
            yield pa.RecordBatch.from_arrays([pa.array(h[rank < pool[d]].view(np.int64))], names=["token"])

    return docs.select("text").mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("n"))


def prefixes(docs: DataFrame, size: int, percent: int, frequent: tuple[np.ndarray, np.ndarray], least: int) -> DataFrame:
    """doc_id, n, fp1, fp2, ell, light, heavy, last_n, last_h of each row: set size, fingerprints, matches asked for, the prefix, rare and frequent shingles apart, and the place of its last shingle in the order."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times = shared.value
        for part, b in blocks(batches, 1, lower=True):
            d, h = shingle_sets(b, size)
            sizes, x, y = _prints(d, h, b.n)
            if len(often):
                k = np.minimum(np.searchsorted(often, h), len(often) - 1)
                heavy = often[k] == h
                df = np.where(heavy, times[k], 0)
            else:
                heavy, df = np.zeros(len(h), bool), np.zeros(len(h), np.int64)
            length = np.where(sizes > 0, sizes - -(-sizes * percent // 100) + 1, 0)
            before = np.concatenate([[0], np.cumsum(~heavy)])
            start = np.cumsum(sizes) - sizes
            rank = before[:-1] - before[start][d]  # among the rare shingles of the text
            rare = np.bincount(d, ~heavy, b.n).astype(np.int64)
            ell, extra_tokens = np.ones(b.n, np.int64), [[]] * b.n
            last_n, last_h = np.zeros(b.n, np.int64), np.zeros(b.n, np.uint64)
            for i in np.flatnonzero(rare < length):
                mine = slice(start[i], start[i] + sizes[i])
                hs, dfs = h[mine][heavy[mine]], df[mine][heavy[mine]]
                order = np.lexsort((hs, dfs))
                need = int(length[i] - rare[i])
                cost = dfs[order[:need]].mean() / least
                ell[i] = min(1 + min(MOST_EXTRA, int(np.log2(1 + cost))), -(-int(sizes[i]) * percent // 100))  # similar sets share so many
                order = order[: need + int(ell[i]) - 1]
                extra_tokens[i] = hs[order].view(np.int64).tolist()
                last_n[i], last_h[i] = dfs[order[-1]], hs[order[-1]]
            take = ~heavy & (rank < length[d])
            only = np.flatnonzero(take & (last_n[d] == 0))
            last_h[d[only]] = h[only]  # the last of each text is the greatest
            last_h ^= np.uint64(1 << 63)  # signed as unsigned
            offsets = np.concatenate([[0], np.cumsum(np.bincount(d[take], minlength=b.n))]).astype(np.int32)
            light = pa.ListArray.from_arrays(pa.array(offsets), pa.array(h[take].view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes.astype(np.int32)), pa.array(x), pa.array(y), pa.array(ell.astype(np.int32)), light, pa.array(extra_tokens, pa.list_(pa.int64())), pa.array(last_n), pa.array(last_h.view(np.int64))], names=["doc_id", "n", "fp1", "fp2", "ell", "light", "heavy", "last_n", "last_h"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n int, fp1 long, fp2 long, ell int, light array<long>, heavy array<long>, last_n long, last_h long")


def whole_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """id, hashes (sorted unsigned 64-bit numbers): the sets of the documents in ids, which are broadcast up to BROADCAST_IDS."""
    n = ids.count()
    wanted = ids.select(F.col("id").alias("__id"))
    chosen = docs.select("doc_id", "text").join(F.broadcast(wanted) if n <= BROADCAST_IDS else wanted, F.col("doc_id") == F.col("__id"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, b in blocks(batches, 1, lower=True):
            d, h = shingle_sets(b, size)
            ends = np.cumsum(np.bincount(d, minlength=b.n))
            raw = h.tobytes()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([raw[8 * s : 8 * e] for s, e in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True)], pa.binary())], names=["id", "hashes"])

    return chosen.mapInArrow(run, "id long, hashes binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int, chunk: int = 128) -> DataFrame:
    """Those of the pairs a, b whose whole sets are similar enough.

    The sets of b come to a, or to one of a's chunks of about `chunk` pairs, so
    that an id with many pairs is spread, and stream past its set.
    """
    n = pairs.count()
    near = lambda df: F.broadcast(df) if n <= BROADCAST_PAIRS else df  # noqa: E731  else the sets are shuffled
    degree = cut(pairs.groupBy("a").agg(F.count("*").alias("pairs_of_a")))
    chunks = degree.select(F.col("a").alias("ca"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("pairs_of_a") - 1) / chunk).cast("long"))).alias("c"))
    sized = pairs.join(near(degree), "a") if n <= BROADCAST_PAIRS else attach_groups(pairs.select("a", "b"), degree, ["a"], "pairs_of_a", n, "b")
    right = sets.join(near(sized), F.col("b") == F.col("id")).select("a", F.pmod(F.xxhash64("b"), F.floor((F.col("pairs_of_a") - 1) / chunk + 1).cast("long")).alias("c"), "b", "hashes")
    left = sets.join(near(chunks), F.col("ca") == F.col("id")).select(F.col("ca").alias("a"), "c", F.lit(None).cast("long").alias("b"), "hashes")
    dealt = left.unionByName(right).repartition("a", "c").sortWithinPartitions("a", "c", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.empty(0, np.uint64)
        for batch in batches:
            keep_a, keep_b = [], []
            for a, b, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                other = np.frombuffer(raw.as_buffer(), np.uint64)
                if b is None:
                    mine = np.array(other)
                    continue
                at = np.minimum(np.searchsorted(mine, other), len(mine) - 1)
                common = int((mine[at] == other).sum())
                if 100 * common >= percent * (len(mine) + len(other) - common):
                    keep_a.append(a)
                    keep_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(keep_a, pa.int64()), pa.array(keep_b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def _need(na: Column, nb: Column, percent: int) -> Column:
    """Least overlap of similar sets of these sizes."""
    return F.floor((percent * (na + nb) + 100 + percent - 1) / (100 + percent))


def _near_sizes(na: Column, nb: Column, percent: int) -> Column:
    return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)


def postings(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """token, id, n, n_t of the prefix shingles that two nodes or more have; and the nodes' id, n, np, ell, last, k_long.

    n_t is the length of a shingle's list, np that of a prefix, k_long its
    shingles in lists of more than LONG nodes. Lists are counted by partial
    sums and long ones are attached by broadcast, so none meets in one task.
    """
    every = nodes.select("id", "n", F.explode(F.concat("light", "heavy")).alias("token"))
    counts = cut(every.groupBy("token").agg(F.count("*").alias("n_t")).filter("n_t > 1"))
    total = nodes.agg(F.sum(F.size("light") + F.size("heavy"))).first()[0] or 0
    met = cut(attach_groups(every, counts, ["token"], "n_t", total, "id").filter("n_t IS NOT NULL").select("token", "id", "n", "n_t"))
    long = met.filter(F.col("n_t") > LONG).groupBy(F.col("id").alias("__id")).agg(F.count("*").alias("k"))
    facts = nodes.select("id", "n", (F.size("light") + F.size("heavy")).alias("np"), "ell", F.struct("last_n", "last_h").alias("last"))
    facts = facts.join(long, F.col("id") == F.col("__id"), "left").select("id", "n", "np", "ell", "last", F.coalesce("k", F.lit(0)).alias("k_long"))
    return met, cut(facts)


def _with_facts(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    for s in ("a", "b"):
        pairs = pairs.join(facts.select(F.col("id").alias("__id"), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "np", "ell", "last", "k_long")]), F.col(s) == F.col("__id")).drop("__id")
    return pairs


def _possible(percent: int) -> Column:
    """Whether prefixes with c shared shingles of short lists leave a pair enough.

    Of two prefixes the one that ends first can match nothing more of what it
    has not matched, so its unmatched shingles are missing in the other
    document; those in long lists may be shared.
    """
    slack = lambda s: F.col(f"n_{s}") - F.col(f"np_{s}") + F.col("c") + F.col(f"k_long_{s}")
    most = F.when(F.col("last_a") <= F.col("last_b"), slack("a")).otherwise(slack("b"))
    return (most >= _need(F.col("n_a"), F.col("n_b"), percent)) & (F.col("c") + F.least("k_long_a", "k_long_b") >= F.least("ell_a", "ell_b"))


def rare_candidates(met: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs that share a prefix shingle of a short list and that the prefixes don't rule out."""
    short = met.filter(F.col("n_t") <= LONG).select("token", "id", "n")
    x, y = short.alias("x"), short.alias("y")
    both = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.id") < F.col("y.id")) & _near_sizes(F.col("x.n"), F.col("y.n"), percent))
    pairs = both.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b")).agg(F.count("*").alias("c"))
    return _with_facts(pairs, facts).filter(_possible(percent)).select("a", "b")


def _heads(now: DataFrame, step: int, n_rows: int, heads: int = 1) -> DataFrame:
    """now with hid, hn, hc: `heads` documents of each list, chosen by hash, their sizes and components."""
    least = lambda j: F.min(F.struct(F.xxhash64(F.lit(step), F.lit(j), "id").alias("h"), F.col("id").alias("hid"), F.col("n").alias("hn"), F.col("component").alias("hc")))
    made = now.groupBy("token").agg(F.array(*[least(j) for j in range(heads)]).alias("heads"), F.count("*").alias("size"))
    return attach_groups(now, cut(made), ["token"], "size", n_rows, "id").withColumn("head", F.explode("heads")).select("token", "id", "n", "component", "head.hid", "head.hn", "head.hc")


def frequent_labels(lists: DataFrame, prefixed: DataFrame, sets: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """id, component by links and by what long lists (token, id, n) add; prefixed has id, ell and prefix.

    Stars come first, with new heads in each round, until a round joins less
    than a twentieth of the components. Documents that long lists connect are a
    cluster; those outside its largest component are then compared with all of
    it, in blocks.
    """
    n_rows = lists.count()
    labels, before, step = components(links), None, 0
    while True:
        now = cut(labelled(lists, labels, "id", "component"))
        left = now.select("component").distinct().count()
        if before is not None and (before - left) * 20 < before:
            break
        star = _heads(now, step, n_rows, STARS).filter((F.col("hc") != F.col("component")) & _near_sizes(F.col("n"), F.col("hn"), percent))
        found = cut(verified(cut(star.select(F.col("hid").alias("a"), F.col("id").alias("b")).distinct()), sets, percent))
        labels, before, step = merged(labels, found), left, step + 1
    near = _heads(now, 0, n_rows).filter("hc <> component").select(F.least("hc", "component").alias("a"), F.greatest("hc", "component").alias("b")).distinct()
    cluster = components(cut(near))
    placed = labelled(now.select("id", "n", "component").distinct(), cluster, "component", "cluster")
    placed = cut(placed.join(prefixed.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id")).drop("__id"))
    return merged(labels, cut(block_links(placed, sets, percent)))


def _dealt(rows: DataFrame, sets: DataFrame, columns: list[str], percent: int, left: int, right: int) -> DataFrame:
    """cluster, band, l, r, side, id, columns, hashes: each row once for every block that it meets, in order of block, then side.

    rows: id, n, cluster, banded, outside, columns. Side 0 has the rows outside,
    in blocks of about `left`; side 1 has all, in blocks of about `right`.
    """
    band = F.when(F.col("banded"), F.floor(F.log(F.col("n").cast("double")) / (1.0001 * math.log(100 / percent)))).otherwise(0).cast("int")
    role = lambda b, side: F.struct(b.cast("int").alias("band"), F.lit(side).alias("side"))
    none = F.array().cast("array<struct<band:int,side:int>>")
    roles = F.concat(F.when(F.col("outside"), F.array(role(band, 0))).otherwise(none), F.when(F.col("banded"), F.array(*[role(band + k, 1) for k in (-1, 0, 1)])).otherwise(F.array(role(band, 1))))
    dealt = cut(rows.select("id", "cluster", *columns, F.explode(roles).alias("role")).select("id", "cluster", *columns, "role.*"))
    facts = cut(dealt.groupBy(F.col("cluster").alias("__c"), F.col("band").alias("__b")).agg(F.ceil(F.sum(1 - F.col("side")) / left).cast("long").alias("nl"), F.ceil(F.sum("side") / right).cast("long").alias("nr")).filter("nl > 0"))
    dealt = dealt.join(small_side(facts, facts.count()), (F.col("cluster") == F.col("__c")) & (F.col("band") == F.col("__b")))
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    meets = F.when(F.col("side") == 0, F.transform(every("nr"), lambda r: F.struct(block("nl").alias("l"), r.alias("r")))).otherwise(F.transform(every("nl"), lambda l: F.struct(l.alias("l"), block("nr").alias("r"))))
    dealt = dealt.join(sets.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id")).withColumn("meet", F.explode(meets))
    keys = ["cluster", "band", "l", "r"]
    return dealt.select("cluster", "band", "meet.l", "meet.r", "side", "id", *columns, "hashes").repartition(*keys).sortWithinPartitions(*keys, "side")


def block_links(placed: DataFrame, sets: DataFrame, percent: int, left: int = 256, right: int = 1024, banded: int = 8192) -> DataFrame:
    """a, b: links that join the different components of each cluster (placed: id, n, component, cluster, ell, prefix).

    Documents outside the cluster's largest component, in blocks of about
    `left`, against all its documents, in blocks of about `right`. In a cluster
    of more than `banded` documents blocks hold one band of sizes, and meet the
    neighbouring bands alone. Two blocks meet in one task, which indexes the
    first and streams the second past it. Pairs whose prefixes share fewer
    shingles than both ask for are left out; so are pairs that links found
    there have joined already, so that a task emits less than one link for each
    component it has met, however many of its documents are alike.
    """
    parts = placed.groupBy("cluster", "component").agg(F.count("*").alias("k"))
    mains = cut(parts.groupBy("cluster").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.sum("k").alias("size"), F.max("k").alias("most")).filter("size > most").select(F.col("cluster").alias("__c"), "main", (F.col("size") > banded).alias("banded")))
    rows = placed.join(small_side(mains, mains.count()), F.col("cluster") == F.col("__c")).withColumn("main", F.col("component") == F.col("main"))
    dealt = _dealt(rows.withColumn("outside", ~F.col("main")), sets, ["component", "main", "ell", "prefix"], percent, left, right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, parts_, ells, pres, held, index = None, [], [], [], [], [], None
        up: dict[int, int] = {}  # of components, in all blocks of the task

        def root(c: int) -> int:
            while (p := up.get(c, c)) != c:
                up[c] = c = up.get(p, p)
            return c

        for batch in batches:
            out_a, out_b = [], []
            offsets, flat = batch.column(9).offsets.to_numpy(), batch.column(9).values.to_numpy()
            for row, (*where, side, i, part, main, ell) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(9)), strict=True)):
                if where != key:
                    key, ids, parts_, ells, pres, held, index = where, [], [], [], [], [], None
                pre = flat[offsets[row] : offsets[row + 1]]
                if side == 0:
                    ids.append(i)
                    parts_.append(part)
                    ells.append(ell)
                    pres.append(np.array(pre))
                    held.append(np.array(np.frombuffer(batch.column(10)[row].as_buffer(), np.uint64)))
                    continue
                if not ids:
                    continue
                if index is None:
                    index = _Lists(pres), _Lists(held), np.fromiter(map(len, held), np.int64, len(held)), np.asarray(ids), np.asarray(ells)
                short, whole, sizes, left_ids, left_ells = index
                maybe = (short.common(pre) >= np.minimum(left_ells, ell)) & ((left_ids < i) | main)
                mine = root(part)
                maybe[maybe] = [root(parts_[x]) != mine for x in np.flatnonzero(maybe)]
                if not maybe.any():
                    continue
                other = np.frombuffer(batch.column(10)[row].as_buffer(), np.uint64)
                common = whole.common(other)
                for x in np.flatnonzero(maybe & (100 * common >= percent * (sizes + len(other) - common))).tolist():
                    if (theirs := root(parts_[x])) != root(part):
                        up[theirs] = root(part)
                        out_a.append(min(ids[x], i))
                        out_b.append(max(ids[x], i))
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def block_counts(placed: DataFrame, sets: DataFrame, percent: int, left: int = 256, right: int = 1024, banded: int = 8192) -> DataFrame:
    """id, n: how many documents (column m of each node) link with each of a cluster's, by pairs that share no shingle of short lists.

    placed: id, n, cluster, ell, prefix, rare (its shingles of short lists), m.
    A task sums for each id before it gives anything out.
    """
    sizes = cut(placed.groupBy(F.col("cluster").alias("__c")).agg((F.count("*") > banded).alias("banded")))
    rows = placed.join(small_side(sizes, sizes.count()), F.col("cluster") == F.col("__c")).withColumn("outside", F.lit(True))
    dealt = _dealt(rows, sets, ["ell", "m", "prefix", "rare"], percent, left, right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, index, total = None, [], None, {}
        for batch in batches:
            lists = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in (batch.column(8), batch.column(9))]
            for row, (*where, side, i, ell, m) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True)):
                if where != key:
                    key, held, index = where, [], None
                pre, rare = (flat[at[row] : at[row + 1]] for at, flat in lists)
                whole = np.frombuffer(batch.column(10)[row].as_buffer(), np.uint64)
                if side == 0:
                    held.append((i, ell, m, np.array(pre), np.array(rare), np.array(whole)))
                    continue
                if not held:
                    continue
                if index is None:
                    ids, ells, ms, pres, rares, wholes = zip(*held, strict=True)
                    index = np.asarray(ids), np.asarray(ells), np.asarray(ms), _Lists(pres), _Lists(rares), _Lists(wholes), np.fromiter(map(len, wholes), np.int64, len(ids))
                ids, ells, ms, by_prefix, by_rare, by_whole, sizes_ = index
                maybe = (ids < i) & (by_prefix.common(pre) >= np.minimum(ells, ell))
                if not maybe.any():
                    continue
                common = by_whole.common(whole)
                hit = np.flatnonzero(maybe & (by_rare.common(rare) == 0) & (100 * common >= percent * (sizes_ + len(whole) - common)))
                if len(hit):
                    total[i] = total.get(i, 0) + int(ms[hit].sum())
                    for x in ids[hit].tolist():
                        total[x] = total.get(x, 0) + m
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["id", "n"])

    return dealt.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


class _Lists:
    """Inverted lists of some arrays of distinct numbers."""

    def __init__(self, arrays: list[np.ndarray]):
        self.n = len(arrays)
        tokens = np.concatenate(arrays)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.of = tokens[order], np.repeat(np.arange(self.n), [len(a) for a in arrays])[order]

    def common(self, other: np.ndarray) -> np.ndarray:
        """How many numbers each array shares with other, whose numbers are distinct."""
        lo, hi = np.searchsorted(self.tokens, other, "left"), np.searchsorted(self.tokens, other, "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.of[at], minlength=self.n)


def _verified_links(docs: DataFrame, size: int, percent: int):
    """For docs (doc_id, text): prefixes of its rows, its distinct sets (nodes), their long and short lists, the nodes in long lists (None if there are none), whole sets, and the links that short lists show."""
    small_batches(docs.sparkSession)
    counted = cut(frequent_shingles(docs, size, percent).filter(F.col("n") > LONG))
    least = LONG + 1
    while counted.filter(F.col("n") >= least).count() > FREQUENT:
        least *= 2
    often = counted.filter(F.col("n") >= least).toArrow()
    tokens, times = often["token"].to_numpy().view(np.uint64), often["n"].to_numpy()
    order = np.argsort(tokens)
    rows = cut(prefixes(docs, size, percent, (tokens[order], times[order]), least))
    keys = ["n", "fp1", "fp2"]
    filled = rows.filter("n > 0")
    nodes = filled.groupBy(*keys).agg(F.min("doc_id").alias("id"), *[F.first(c).alias(c) for c in ("ell", "light", "heavy", "last_n", "last_h")]).filter("id IS NOT NULL")
    met, facts = postings(nodes)
    pairs = cut(rare_candidates(met, facts, percent))
    often_met = facts.filter("k_long > 0").select("id")
    many = not often_met.isEmpty()
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    sets = whole_sets(docs, cut((ids.union(often_met) if many else ids).distinct()), size)
    repeated = not rows.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").isEmpty()
    sets = cut(sets.dropDuplicates(["id"]) if repeated else sets)
    links = cut(verified(pairs, sets, percent))
    return rows, nodes, met, often_met if many else None, sets, links


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each row of docs.

    A-Z are lower-cased; a document's set has its distinct shingles of `size`
    words, or its whole sequence if it has fewer. Documents link when 100 times
    the intersection is at least `percent` times the union. component_id is the
    smallest doc_id that links reach. A null text, an empty one, or one without
    words has no shingles and only itself. Rows that repeat a doc_id are each a
    row. Other columns are not read. An empty table gives an empty table.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows, nodes, met, often_met, sets, links = _verified_links(docs, size, percent)
    keys = ["n", "fp1", "fp2"]
    filled = rows.filter("n > 0")
    if often_met is not None:
        prefixed = nodes.join(often_met.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id"), "left_semi").select("id", "ell", F.concat("light", "heavy").alias("prefix"))
        label = frequent_labels(cut(met.filter(F.col("n_t") > LONG).select("id", "n", "token")), prefixed, sets, links, percent)
    else:
        label = components(links)
    label = label.select(F.col("id").alias("__id"), "component")
    groups = filled.groupBy(*keys).agg(F.min("doc_id").alias("id"), F.count("*").alias("size"))
    groups = groups.join(label, F.col("id") == F.col("__id"), "left").select(*keys, F.coalesce("component", "id").alias("component_id"), "size").filter("size > 1 OR component_id IS NOT NULL")
    out = attach_groups(rows.select("doc_id", *keys), cut(groups), keys, "size", rows.count(), "doc_id")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def link_counts(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_links: with how many other rows each row of docs links, as near_groups has it; rows with equal sets link too.

    Pairs of long lists are counted in blocks, whose work is the square of a
    cluster's size in a band of sizes; nothing but counts comes out.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows, nodes, met, often_met, sets, links = _verified_links(docs, size, percent)
    keys = ["n", "fp1", "fp2"]
    members = cut(rows.filter("n > 0").groupBy(*keys).agg(F.min("doc_id").alias("id"), F.count("*").alias("m")))
    m_of = members.filter("id IS NOT NULL").select(F.col("id").alias("__id"), "m")
    ends = links.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("other")))
    counted = ends.join(m_of, F.col("other") == F.col("__id")).groupBy("id").agg(F.sum("m").alias("k"))
    if often_met is not None:
        long = met.filter(F.col("n_t") > LONG)
        heads = _heads(long.withColumn("component", F.col("id")), 0, long.count()).filter("hid <> id")
        rare = met.filter(F.col("n_t") <= LONG).groupBy(F.col("id").alias("__r")).agg(F.collect_set("token").alias("rare"))
        placed = nodes.join(often_met.withColumnRenamed("id", "__o"), F.col("id") == F.col("__o"), "left_semi").select("id", "n", "ell", F.concat("light", "heavy").alias("prefix"))
        placed = placed.join(rare, F.col("id") == F.col("__r"), "left").withColumn("rare", F.coalesce("rare", F.array().cast("array<bigint>"))).join(m_of, F.col("id") == F.col("__id")).drop("__r", "__id")
        placed = labelled(placed, components(cut(heads.select(F.col("hid").alias("a"), F.col("id").alias("b")).distinct())), "id", "cluster")
        counted = counted.unionByName(block_counts(cut(placed), sets, percent).withColumnRenamed("n", "k")).groupBy("id").agg(F.sum("k").alias("k"))
    per = members.join(counted.withColumnRenamed("id", "__id"), F.col("id") == F.col("__id"), "left").select(*keys, "m", (F.col("m") - 1 + F.coalesce("k", F.lit(0))).alias("n_links"))
    out = attach_groups(rows.select("doc_id", *keys), cut(per), keys, "m", rows.count(), "doc_id")
    return out.select("doc_id", F.when(F.col("n") > 0, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that have the smallest doc_id of their group, with all their columns; of rows that repeat a doc_id and a text one stays. Rows without a doc_id stay."""
    groups = cut(near_groups(docs, **options).select("doc_id", "component_id"))
    same = F.col("doc_id").eqNullSafe(F.col("component_id"))
    left = without(docs, groups.filter(~same), {"doc_id": F.col("doc_id").cast("long")})
    return one_row_each(left, ["doc_id", "text"], groups.filter(same & F.col("doc_id").isNotNull()).select("doc_id"))


def op10(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), size=4, percent=85)


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS id, doc_id AS reached FROM w UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(reached) AS component_id FROM r GROUP BY id) m ON m.id = w.doc_id
"""
