"""The pipeline's stages on the smallest tables, and the queries with SQL."""

from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from rowlattice.llm import packing, queries
from tests.conftest import same


def test_stages(spark, sf):
    """Each stage on what the one before it kept, held against plain Python."""
    from tests.llm.test_operators import WORD, brute_components, brute_targets, lowered

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, sf).toPandas(), docs.schema)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        got = docs.collect()
        ids = sorted(r["doc_id"] for r in got)
        whole = {r["doc_id"]: r for r in rows}
        assert all(whole[r["doc_id"]] == r for r in got), name
        if name == "exact_dedup":
            groups = {}
            for r in rows:
                groups.setdefault(lowered(r["text"]), []).append(r["doc_id"])
            assert ids == sorted(map(max, groups.values()))
        if name == "near_dedup":
            assert ids == sorted({c for _, c in brute_components({r["doc_id"]: r["text"] for r in rows}, 5, 80).values()})
        if name == "mixing":
            words, longest, taken = Counter(), Counter(), Counter()
            for r in rows:
                n = len(WORD.findall(r["text"] or ""))
                words[r["source"]] += n
                longest[r["source"]] = max(longest[r["source"]], n)
            for r in got:
                taken[r["source"]] += len(WORD.findall(r["text"] or ""))
            for s, t in brute_targets(words).items():
                assert abs(taken[s] - t) <= longest[s] + 0.01 * t
            assert max(Counter(ids).values()) <= 3
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] > sizes[2] > sizes[3] > 0 and docs.count() != sizes[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    encode = packing._Encoder("byte_bpe_50k")
    want = sum(len(encode(r["text"] or "")) + 1 for r in docs.collect())
    at = {}
    for r in packed:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sum(r["length"] for r in packed) == want and len(at) <= -(-want // 2048) * 1.02 + 1
    for spans in at.values():
        ends = [o + n for o, n in sorted(spans)]
        assert [o for o, _ in sorted(spans)] == [0, *ends[:-1]] and ends[-1] <= 2048


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql(spark, sf, duck, name):
    same(queries.QUERIES[name](spark, sf), duck.execute(queries.SQL[name]))


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
