"""Exact duplicates by content-defined chunk recipes.

A text (A-Z lower-cased, null as empty) is cut into chunks where a rolling
hash of its bytes says so, so that equal passages give equal chunks. A chunk
has a 128-bit digest. The digests are verified: all chunks go once, combined
on the map side, through an aggregation by digest and content, and a digest
with two contents makes the next digest function take over. A text is then
its recipe, the ordered list of its verified chunk identifiers, and texts are
equal when their lists are. Long texts themselves never move again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlattice.llm._common import LOWER, UPPER, attach_groups, cut, one_row_each, table, without

_GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)


def chunk_ends(data: bytes, least: int = 2048, mask_bits: int = 12, most: int = 65536) -> list[int]:
    """Ends of the chunks of data. A cut depends on the 32 bytes before it and on the chunk's start alone."""
    n = len(data)
    if n <= least:
        return [n]
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for width in (1, 2, 4, 8, 16):  # the gear hash of 32 bytes, by doubling
        h[width:] += h[:-width] << np.uint32(width)
    marks = np.flatnonzero((h >> np.uint32(32 - mask_bits)) == 0) + 1
    ends, start = [], 0
    while n - start > least:
        k = np.searchsorted(marks, start + least)
        end = min(int(marks[k]) if k < len(marks) else n, start + most, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def _xxh(b: bytes) -> bytes:
    return xxhash.xxh3_128_digest(b)


def _sha(b: bytes) -> bytes:
    return hashlib.sha256(b).digest()[:16]


DIGESTS = {"xxh3_128": _xxh, "sha256_128": _sha}


def recipes(docs: DataFrame, digest: str = "xxh3_128", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (a hash of the text as it is), n_bytes, text_sha256 and recipe (the 16-byte digests of the chunks, one after another)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, sha, made = [], [], []
            for text in batch.column(2):
                data = (text.as_py() or "").encode().lower()
                start, ids = 0, []
                for end in chunk_ends(data):
                    ids.append(DIGESTS[digest](data[start:end]))
                    start = end
                size.append(len(data))
                sha.append(hashlib.sha256(data).hexdigest())
                made.append(b"".join(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(sha, pa.string()), pa.array(made, pa.binary())], names=["doc_id", "text_key", "n_bytes", "text_sha256", "recipe"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, text_key long, n_bytes long, text_sha256 string, recipe binary")


def chunk_contents(docs: DataFrame, digest: str = "xxh3_128", text_col: str = "text") -> DataFrame:
    """digest, content of each chunk of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, contents, held = [], [], 0
            out = lambda: pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(contents, pa.binary())], names=["digest", "content"])
            for text in batch.column(0):
                data = (text.as_py() or "").encode().lower()
                start = 0
                for end in chunk_ends(data):
                    contents.append(data[start:end])
                    ids.append(DIGESTS[digest](contents[-1]))
                    start = end
                held += len(data)
                if held > 8_000_000:
                    yield out()
                    ids, contents, held = [], [], 0
            if ids:
                yield out()

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "digest binary, content binary")


def colliding(contents: DataFrame) -> DataFrame:
    """Digests that stand for two contents or more."""
    return contents.groupBy("digest", "content").agg(F.count("*").alias("n")).groupBy("digest").agg(F.count("*").alias("contents")).filter("contents > 1")


def verified_digest(docs: DataFrame, text_col: str = "text") -> str:
    """The first digest function that no two chunks of docs share."""
    for name in DIGESTS:
        if colliding(chunk_contents(docs, name, text_col)).isEmpty():
            return name
    raise RuntimeError("every digest function stands for two chunks somewhere")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, text_key: a row for each row of docs.

    Of rows with equal texts the one with the largest doc_id stays; null is
    less than any number, and a group whose ids are all null has keep_id null
    and stays whole. Rows that repeat a doc_id and a text are each a row, all
    kept or none. Null and empty texts are one group. text_key is a hash of
    the text before normalising. Further columns are not read. An empty table
    gives an empty table.
    """
    made = cut(recipes(docs, verified_digest(docs, text_col), id_col, text_col))
    groups = cut(made.groupBy("n_bytes", "recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1"))
    out = attach_groups(made, groups, ["n_bytes", "recipe"], "group_size", made.count(), "doc_id")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", "text_key")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs that stay, with all their columns; of rows that repeat a doc_id and a text one stays."""
    groups = cut(exact_groups(docs, id_col, text_col).select("doc_id", "text_key", "kept"))
    left = without(docs, groups.filter("NOT kept"), {"doc_id": F.col(id_col).cast("long"), "text_key": F.xxhash64(text_col)})
    return one_row_each(left, [id_col, text_col], groups.filter("kept AND doc_id IS NOT NULL").select("doc_id", "text_key"))


def op9(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("text_key")


_NORMAL = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_NORMAL} AS t FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
