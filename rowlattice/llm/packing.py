"""Best-fit packing of tokenised documents into sequences.

Each piece of a document is an item with three sizes: its tokens, one
document, and its attention cost (the square of its length, as attention runs
inside a document). A sequence has a capacity for each. Items go, longest
first, into the open sequence that holds them under every constraint and
scores best: the smallest weighted norm of what would be left ("norm"), or the
largest weighted dot product of the item and what is left ("dot").

Groups of about `group` pieces, dealt by a hash of what they are, are packed
apart: at most one badly filled sequence for each group, no task that grows with
the input, and a lost task is repeated alone.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlattice.llm._common import cut, table

_ENCODERS: dict[str, object] = {}


class _Encoder:
    """Ids as the tokenizers library gives them for byte_bpe_50k.json.

    The same vocabulary as tiktoken ranks gives the same ids about four times
    as fast; what tiktoken refuses goes to the tokenizers library itself.
    """

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name + ".tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.name = name
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})
        self.slow = None

    def __call__(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
        except Exception:  # a pattern that runs out of its backtracking limit
            if self.slow is None:
                import public_tokenizers
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(public_tokenizers.path(self.name + ".json"))
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")


def tokenized_pieces(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit numbers) for each piece.

    A document is the ids of its text, then end_id; a null or empty text is
    end_id alone. Only a document of more than `capacity` ids is cut: all
    pieces have `capacity` ids, but for the first, which may be shorter.
    Repeated rows give repeated pieces; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _ENCODERS.get(tokenizer) or _ENCODERS.setdefault(tokenizer, _Encoder(tokenizer))
        for batch in batches:
            doc, piece, start, length, ids = [], [], [], [], []
            held = 0

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])

            for d, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                all_ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4", copy=False)
                n, at, k = len(all_ids), 0, 0
                end = n % capacity or min(n, capacity)
                while at < n:
                    doc.append(d)
                    piece.append(k)
                    start.append(at)
                    length.append(end - at)
                    ids.append(all_ids[at:end].tobytes())
                    held += end - at
                    at, end, k = end, end + capacity, k + 1
                if held > 4_000_000:
                    yield out()
                    doc, piece, start, length, ids, held = [], [], [], [], [], 0
            if doc:
                yield out()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def best_fit(lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float], rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; lengths are in the order in which items are placed."""
    tokens, docs, cost = capacity
    scale = np.array([tokens, docs, cost], dtype=float)
    w = np.asarray(weights, dtype=float)
    n = len(lengths)
    left = np.empty((3, 256))
    bins, offsets, used = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    live = np.empty(0, np.int64)  # open bins that may still take an item
    for i, t in enumerate(lengths.tolist()):
        item = (t, 1, t * t)
        if t > tokens or item[2] > cost or docs < 1:
            raise ValueError(f"an item of {t} tokens fits into no sequence")
        r = left[:, live]
        ok = np.flatnonzero((r[0] >= t) & (r[1] >= 1) & (r[2] >= item[2])) if len(live) else live
        if len(ok):
            r = r[:, ok]
            if rule == "dot":
                score = -(w[0] * r[0] * t / scale[0] ** 2 + w[1] * r[1] / scale[1] ** 2 + w[2] * r[2] * item[2] / scale[2] ** 2)
            else:
                score = w[0] * ((r[0] - t) / scale[0]) ** 2 + w[1] * ((r[1] - 1) / scale[1]) ** 2 + w[2] * ((r[2] - item[2]) / scale[2]) ** 2
            b = int(live[ok[int(np.argmin(score))]])
        else:
            if used == left.shape[1]:
                left = np.concatenate([left, np.empty_like(left)], axis=1)
            b = used
            left[:, b] = scale
            used += 1
            live = np.append(live, b)
        bins[i], offsets[i] = b, tokens - int(left[0, b])
        left[:, b] -= item
        if left[0, b] < 1 or left[1, b] < 1:
            live = live[live != b]
    return bins, offsets


def capacities(pieces: DataFrame, tokens: int = 2048, room: float = 4.0) -> tuple[int, tuple[int, int, int]]:
    """Number of pieces, and the capacities of a sequence: tokens, documents and attention cost.

    Documents and cost are `room` times what a sequence would hold were all
    alike, so that both bind where small documents or long ones would crowd,
    but at least 32 documents, and the cost of the costliest piece, which must
    fit somewhere.
    """
    square = F.col("length") * F.col("length")
    n, total, cost, most = pieces.agg(F.count("*"), F.sum("length"), F.sum(square.cast("decimal(38,0)")), F.max(square)).first()
    sequences = max(1, -(-(total or 0) // tokens))
    return n, (tokens, max(32, math.ceil(room * n / sequences)), max(most or 1, math.ceil(room * float(cost or 0) / sequences)))


def pack_pieces(pieces: DataFrame, n: int, capacity: tuple[int, int, int], weights: tuple[float, float, float] = (1.0, 0.5, 0.1), rule: str = "norm", group: int = 4096) -> DataFrame:
    """pieces (doc_id, piece, length and any more columns) with sequence_id and offset.

    n: about how many pieces there are. capacity: most tokens, documents
    (pieces) and attention cost of a sequence. Equal pieces are counted and told
    apart by a number, so they are dealt to different groups; nothing depends on
    how rows are partitioned. Of equally good sequences the one opened first is
    taken, of equally long pieces the one with the least columns goes first. An
    empty table gives an empty table.
    """
    groups = max(1, -(-n // group))
    more = [c for c in pieces.columns if c not in ("__group", "__copy", "__n", "sequence_id", "offset")]
    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.select(*more).dtypes) + ", sequence_id long, offset long"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="__group").sort_values(["length", *(c for c in more if c != "length")], ascending=[False] + [True] * (len(more) - 1), kind="stable")
        bins, offsets = best_fit(pdf["length"].to_numpy(), capacity, weights, rule)
        return pdf.assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    counted = pieces.select(*more).groupBy(*more).agg(F.count("*").alias("__n"))
    each = counted.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    dealt = each.select(*more, F.pmod(F.xxhash64(*more, "__copy"), F.lit(groups)).alias("__group"))
    return dealt.groupBy("__group").applyInPandas(run, schema)


def pack_documents(docs: DataFrame) -> DataFrame:
    """Digest of the packing: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = cut(tokenized_pieces(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return pack_pieces(pieces, *capacities(pieces))


def op1(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
