"""Toxicity of texts, restored from obfuscated spelling.

Noisy channel: a token with digits or symbols in the place of letters, with
drawn-out letters, or a row of single letters is a lattice of what may have
been meant. A Viterbi pass over the lattice finds the likeliest letters under a
character language model (4-grams over 32 classes, counted over all documents).
Texts are scored as written and as restored.

The score rests on letter n-grams (3 to 6, word edges included). Their weight
is a lower confidence bound of the log ratio of how often toxic and clean
labelled documents have them. A document's evidence is its fourth heaviest
n-gram, as a word that tells has several and chance hits stand alone; a logistic
curve, fitted on labelled documents that had no part in the weights,
makes it a probability. Copies of one text count once in training.

The classifier is fitted on `sample` labelled rows at most, those with the
smallest hashes of their doc_ids, and has MAX_FEATURES n-grams at most, the
heaviest; as only n-grams of LEAST_DOCS toxic documents of the sample count, the
bound seldom matters. All else covers all documents. Letters of all scripts make
n-grams; outside Latin they share classes by a hash, and only Latin ones are
restored.
"""

from __future__ import annotations

import math
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlattice.llm._common import cut, table
from rowlattice.llm._words import Block, mix

SAMPLE = 20_000
MAX_FEATURES = 65_536
LENGTHS = (3, 4, 5, 6)
LEAST_DOCS = 5
#: A word that tells has several telling n-grams; the evidence of a document is the weight of this one of them, from the heaviest.
HITS = 4

# ---- alphabets (fixed values) ----
ACCENTED = "äöüßàáâãåæçèéêëìíîïñòóôõøùúûýÿœ"
DIGIT = 58
#: What a character may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "¡": "i"}
SEPARATORS = " ._*-,/~"


#: Letters and digits of all scripts lie below; what is above has no class.
POINTS = 0x32400


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Classes of code points: 64 fine ones (letters of other scripts share the accented ones by a hash), 32 coarse ones."""
    fine, coarse = np.zeros(POINTS, np.uint8), np.zeros(POINTS, np.uint8)
    for cp in range(POINTS):
        c = chr(cp).lower()[0]
        base = c if cp < 128 else unicodedata.normalize("NFKD", c)[0]
        if c in ACCENTED:
            fine[cp] = 27 + ACCENTED.index(c)
        elif "a" <= base <= "z":
            fine[cp] = ord(base) - 96
        elif c.isdigit():
            fine[cp] = DIGIT
        elif c.isalpha():
            fine[cp] = 27 + ord(c) * 2654435761 % 2**32 % len(ACCENTED)
        coarse[cp] = ord(base) - 96 if "a" <= base <= "z" else 19 if c == "ß" else 27 if c.isdigit() else 28 if c.isalpha() else 0 if c.isspace() or c in SEPARATORS + "'\"()?:;" else 29
    return fine, coarse


_FINE, _COARSE = _tables()
_TRIGGER = np.zeros(POINTS, bool)
_TRIGGER[[ord(c) for c in LEET]] = True
_SEP = np.zeros(POINTS, bool)
_SEP[[ord(c) for c in SEPARATORS]] = True
_BLANK = np.zeros(POINTS, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each after two line feeds, cut to the tables' size; and each text's start."""
    joined = "\n\n" + "\n\n".join(texts) + "\n\n"
    cps = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), POINTS - 1).astype(np.int32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    return cps, np.concatenate([[2], 2 + np.cumsum(lengths)[:-1]]).astype(np.int64)


# ---- the language model ----
def gram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """code, n: counts of 4-grams of coarse classes (32**4 codes at most) over all texts; runs of spaces count as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(32**4, np.int64)
        for batch in batches:
            for texts in _some(batch.column(0)):
                c = _COARSE[points(texts)[0]].astype(np.int32)
                keep = np.ones(len(c), bool)
                keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
                c = c[keep]
                code = ((c[:-3] << 5 | c[1:-2]) << 5 | c[2:-1]) << 5 | c[3:]
                total += np.bincount(code, minlength=32**4)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["code", "n"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def language_model(counts: DataFrame) -> np.ndarray:
    """Log probabilities of a class after three others: interpolated counts, float32, 32**4 of them (4 MB)."""
    t = counts.toArrow()
    n4 = np.zeros(32**4)
    n4[t["code"].to_numpy()] = t["n"].to_numpy()
    n4 = n4.reshape(32, 32, 32, 32)
    p = (n4.sum((0, 1, 2)) + 1) / (n4.sum() + 32)
    for axes, shape in (((0, 1), (1, 1, 32, 32)), ((0,), (1, 32, 32, 32)), ((), (32, 32, 32, 32))):
        n = n4.sum(axes).reshape(shape) if axes else n4
        p = (n + 4 * p) / (n.sum(-1, keepdims=True) + 4)
    return np.log(p).astype(np.float32).reshape(-1)


def restore(token: str, model: np.ndarray) -> str:
    """The likeliest letters behind an obfuscated token: a Viterbi pass, a state being the last three classes.

    Edges: a letter stands for itself; a character of LEET for its letters (or,
    at a price, for nothing meant); three or more equal letters for one or two;
    a separator between single letters for nothing or for a space. All states
    survive, so the pass is exact; of equal scores the first edge's wins.
    """
    spaced = sum(c in SEPARATORS for c in token) * 2 >= len(token) - 2
    steps: list[list[tuple[str, float]]] = []
    i = 0
    low = token.lower()
    while i < len(low):
        c, j = low[i], i + 1
        if c in SEPARATORS:
            steps.append([("", -1.0), (" ", -2.0)] if spaced else [(" ", 0.0)])
        elif c in LEET:
            steps.append([(x, -1.5) for x in LEET[c]] + [(" ", -6.0)])
        elif c.isalpha():
            while j < len(low) and low[j] == c:
                j += 1
            steps.append([(c, 0.0)] if j == i + 1 else [(c * 2, 0.0)] + ([(c, -1.0)] if spaced else []) if j == i + 2 else [(c, -1.0), (c * 2, -1.5)])
        else:
            steps.append([(" ", -1.0)])
        i = j
    # a survivor is its score and the classes' text since the survivors last agreed
    best, made = {(0, 0, 0): (0.0, "")}, []
    for at, options in enumerate([*steps, [(" ", 0.0)]]):
        new: dict[tuple[int, int, int], tuple[float, str]] = {}
        for (a, b, c), (score, text) in best.items():
            for out, cost in options:
                x, y, z, s = a, b, c, score + cost
                for ch in out:
                    k = int(_COARSE[min(ord(ch), POINTS - 1)])
                    if k == 0 and z == 0:
                        continue
                    s += float(model[((x << 5 | y) << 5 | z) << 5 | k])
                    x, y, z = y, z, k
                old = new.get((x, y, z))
                if old is None or s > old[0]:
                    new[x, y, z] = (s, text + out)
        best = new
        if at % 64 == 63:  # long stretches: what all survivors agree on is settled
            agreed = len(os.path.commonprefix([text for _, text in best.values()]))
            made.append(next(iter(best.values()))[1][:agreed])
            best = {state: (score, text[agreed:]) for state, (score, text) in best.items()}
    return "".join([*made, max(best.values())[1]]).strip()


def obfuscated(cps: np.ndarray) -> np.ndarray:
    """Starts and ends (two rows) of the stretches of the code points that may hide words."""
    letter = (_FINE[cps] > 0) & (_FINE[cps] < DIGIT)
    trig, blank, sep = _TRIGGER[cps], _BLANK[cps], _SEP[cps]
    n = len(cps)
    at = lambda m, k: np.concatenate([m[k:], np.zeros(k, bool)]) if k >= 0 else np.concatenate([np.zeros(-k, bool), m[:k]])
    leet = trig & (at(letter, 1) | (at(trig, 1) & at(letter, 2)) | (at(letter, -1) & ~blank & at(blank, 1)))
    leet &= ~(trig & at(trig, -1) & at(blank, 1))  # a tail of symbols is decoration
    same = np.zeros(n, bool)
    same[:-2] = (cps[:-2] == cps[1:-1]) & (cps[1:-1] == cps[2:])
    marks = leet | (same & letter)
    # a row of three or more single letters with one separator between each two
    sign = letter | trig
    single = sign & at(sep | blank, -1) & at(sep | blank, 1)
    pair = single & at(single, 2)
    trio = pair & at(pair, 2)
    row = trio | at(trio, -2) | at(trio, -4)
    blanks = np.flatnonzero(blank & ~(at(row, -1) & at(row, 1)))  # blanks inside a row don't end a stretch
    hits = np.flatnonzero(marks | trio)
    if not len(hits):
        return np.empty((2, 0), np.int64)
    k = np.unique(np.searchsorted(blanks, hits))
    return np.stack([blanks[k - 1] + 1, blanks[np.minimum(k, len(blanks) - 1)]])


def _some(column: pa.Array, size: int = 1_000_000) -> Iterator[list[str]]:
    texts, held = [], 0
    for t in column:
        s = t.as_py() or ""
        texts.append(s)
        held += len(s)
        if held >= size:
            yield texts
            texts, held = [], 0
    if texts:
        yield texts


class Reader:
    """n-grams of texts, as written and as restored."""

    def __init__(self, model: np.ndarray):
        self.model, self.seen = model, {}

    def streams(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Fine classes, and the text of each of them: of the texts, then of what is restored."""
        cps, starts = points(texts)
        yield _FINE[cps], np.searchsorted(starts, np.arange(len(cps)), side="right") - 1
        spans = obfuscated(cps)
        made, of = [], []
        for s, e, d in zip(spans[0].tolist(), spans[1].tolist(), (np.searchsorted(starts, spans[0], side="right") - 1).tolist(), strict=True):
            token = texts[d][s - int(starts[d]) : e - int(starts[d])]
            out = self.seen.get(token)
            if out is None:
                out = restore(token, self.model)
                if len(self.seen) >= 200_000:
                    self.seen.clear()
                if len(token) <= 64:
                    self.seen[token] = out
            made.append(out)
            of.append(d)
        if made:
            cps, starts = points(made)
            yield _FINE[cps], np.asarray(of)[np.maximum(np.searchsorted(starts, np.arange(len(cps)), side="right") - 1, 0)]

    @staticmethod
    def grams(c: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the n-grams without an inner edge, tagged with their length, and their places."""
        n = len(c) - length + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        inner = (c > 0) & (c < DIGIT)
        ok = np.ones(n, bool)
        for j in range(1, length - 1):
            ok &= inner[j : j + n]
        at = np.flatnonzero(ok)
        code = np.full(len(at), length, np.int64)
        for j in range(length):
            code = code << 6 | c[at + j]
        return code, at


def _doc_grams(reader: Reader, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, code) pairs."""
    docs, codes = [], []
    for c, of in reader.streams(texts):
        for length in LENGTHS:
            code, at = reader.grams(c, length)
            docs.append(of[at])
            codes.append(code)
    d, k = np.concatenate(docs), np.concatenate(codes)
    order = np.lexsort((k, d))
    d, k = d[order], k[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (k[1:] != k[:-1])
    return d[new], k[new]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """text, toxic, part (0: weights, 1: curve) of up to `sample` labelled rows that aren't held out; texts that share their smallest five-word hash count once."""
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumnRenamed("doc_id", "__id")
    texts = docs.select(F.col("doc_id").alias("__d"), "text").join(F.broadcast(chosen), F.col("__d") == F.col("__id")).select("__id", "text", "toxic")

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for t in batch.column(1):
                b = Block([(t.as_py() or "").encode()], lower=True)
                h, _ = b.windows(5)
                keys.append(int((h if len(h) else mix(np.array([b.words.sum() if len(b.words) else 0], np.uint64))).min() >> np.uint64(1)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *batch.columns], names=["key", "id", "text", "toxic"])

    keyed = texts.mapInArrow(key, "key long, id long, text string, toxic int")
    one = keyed.groupBy("key").agg(F.min_by(F.struct("text", "toxic"), "id").alias("x"), F.min("id").alias("id"))
    return cut(one.select("x.text", "x.toxic", F.when(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(4)) == 0, 1).otherwise(0).alias("part")))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The language model, n-gram codes (sorted) with their weights, and the curve."""
    model = language_model(gram_counts(docs))
    rows = training_sample(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def count(only: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader, codes, sums = Reader(shared.value), [], []
            for batch in batches:
                toxic = batch.column(1).to_numpy()
                first = 0
                for texts in _some(batch.column(0)):
                    d, k = _doc_grams(reader, texts)
                    if only is not None:
                        at = np.minimum(np.searchsorted(only, k), len(only) - 1)
                        hit = only[at] == k
                        d, k = d[hit], k[hit]
                    keys, inverse = np.unique(k, return_inverse=True)
                    t = toxic[first : first + len(texts)][d]
                    codes.append(keys)
                    sums.append(np.stack([np.bincount(inverse, t > 0, len(keys)), np.bincount(inverse, t <= 0, len(keys))]))
                    first += len(texts)
            if codes:
                k, s = np.concatenate(codes), np.concatenate(sums, axis=1).astype(np.int64)
                keys, inverse = np.unique(k, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(np.bincount(inverse, x, len(keys)).astype(np.int64)) for x in s)], names=["code", "a", "b"])

        return run

    sizes = {(r["part"], r["t"]): r["n"] for r in rows.groupBy("part", (F.col("toxic") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    n_t, n_c = sizes.get((0, True), 0), sizes.get((0, False), 0)
    prior = (sum(v for (_, t), v in sizes.items() if t) + 0.5) / (sum(sizes.values()) + 1)
    none = {"model": shared, "codes": np.empty(0, np.int64), "weights": np.empty(0), "curve": (0.0, math.log(prior / (1 - prior)))}
    if not n_t:
        return none
    part = rows.filter("part = 0").select("text", "toxic")
    most = part.filter("toxic > 0").mapInArrow(count(None), "code long, a long, b long").groupBy("code").agg(F.sum("a").alias("a")).filter(F.col("a") >= min(LEAST_DOCS, max(2, n_t // 20))).orderBy(F.desc("a"), "code").limit(4 * MAX_FEATURES).toArrow()
    toxic_docs = dict(zip(most["code"].to_pylist(), most["a"].to_pylist(), strict=True))
    if not toxic_docs:
        return none
    only = np.sort(np.fromiter(toxic_docs, np.int64))
    clean = part.filter("toxic <= 0").mapInArrow(count(only), "code long, a long, b long").groupBy("code").agg(F.sum("b").alias("b")).toArrow()
    clean_docs = dict(zip(clean["code"].to_pylist(), clean["b"].to_pylist(), strict=True))
    a = np.array([toxic_docs[int(k)] for k in only]) + 0.5
    b = np.array([clean_docs.get(int(k), 0) for k in only]) + 0.5
    weight = np.log(a / (n_t + 1)) - np.log(b / (n_c + 1)) - 1.28 * np.sqrt(1 / a + 1 / b)
    keep = np.flatnonzero(weight > 0.5)
    keep = np.sort(keep[np.argsort(-weight[keep], kind="stable")[:MAX_FEATURES]])
    out = {"model": shared, "codes": only[keep], "weights": weight[keep], "curve": (0.0, 0.0)}
    seen = rows.filter("part = 1" if sizes.get((1, True)) and sizes.get((1, False)) else "part < 2").select("text", "toxic").mapInArrow(evidence_of(out), "toxic int, evidence double").toArrow()
    return out | {"curve": curve(seen["evidence"].to_numpy(), seen["toxic"].to_numpy() > 0)}


def curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve, by Newton steps with a little ridge."""
    X, w = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    ridge = np.diag([1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        step = np.linalg.solve(X.T @ (X * (p * (1 - p))[:, None]) + ridge, X.T @ (y - p) - ridge @ w)
        w = w + step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def evidence_of(fitted: dict):
    """An Arrow function: the columns but the first text, and the weight of the HITS-th heaviest n-gram (0 with fewer)."""
    shared, codes, weights = fitted["model"], fitted["codes"], fitted["weights"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        tables = []
        for length in LENGTHS:
            mine = codes[(codes >> np.int64(6 * length)) == length]
            first = np.zeros(64 ** min(length, 4), bool)  # of the first three or four classes
            first[(mine >> np.int64(6 * max(0, length - 4))) & (len(first) - 1)] = True
            tables.append((length, mine, weights[(codes >> np.int64(6 * length)) == length], first, len(tables) << 20))
        for batch in batches:
            found = []
            for texts in _some(batch.column(0)):
                best = np.zeros(len(texts))
                pairs, heavy = [np.empty(0, np.int64)], [np.empty(0)]
                for c, of in reader.streams(texts) if len(codes) else ():
                    c = np.concatenate([c, np.zeros(8, np.uint8)]).astype(np.int32)
                    n = len(of)
                    three = (c[:n] << 6 | c[1 : n + 1]) << 6 | c[2 : n + 2]
                    four = three << 6 | c[3 : n + 3]
                    for length, mine, w, first, base in tables:
                        if not len(mine):
                            continue
                        at = np.flatnonzero(first[three if length == 3 else four])
                        code = np.full(len(at), length, np.int64)
                        for j in range(length):
                            code = code << 6 | c[at + j]
                        k = np.minimum(np.searchsorted(mine, code), len(mine) - 1)
                        hit = mine[k] == code
                        pairs.append(of[at[hit]] << np.int64(32) | base + k[hit])
                        heavy.append(w[k[hit]])
                pair, first_at = np.unique(np.concatenate(pairs), return_index=True)
                weight, doc = np.concatenate(heavy)[first_at], pair >> np.int64(32)
                order = np.lexsort((-weight, doc))
                doc, weight = doc[order], weight[order]
                rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
                best[doc[rank == HITS - 1]] = weight[rank == HITS - 1]
                found.append(best)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate(found) if found else np.empty(0))], names=[*batch.schema.names[1:], "evidence"])

    return run


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each row of docs.

    A null text is an empty one; it has no evidence and the lowest score. If no
    usable label is toxic, each score is the share of toxic labels. Repeated
    rows have equal scores; a score of exactly one half is predicted toxic. Of a
    doc_id's labels the largest counts, and labels of rows that aren't in docs
    are not used. Only doc_id and text are read, so other names may clash. An
    empty table gives an empty table. Whole texts are read; memory follows the
    longest one, by about fifty bytes for each of its characters.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fitted = fit(docs, labels, sample)
    slope, at_zero = fitted["curve"]
    made = docs.select("text", "doc_id").mapInArrow(evidence_of(fitted), "doc_id long, evidence double")
    p = 1 / (1 + F.exp(-(F.col("evidence") * slope + at_zero)))
    return made.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), p.alias("score"), (p >= 0.5).cast("int").alias("predicted"))


def clean_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns. Nothing is shuffled: whole rows pass the scorer."""
    fitted = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, sample)
    slope, at_zero = fitted["curve"]
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    made = rows.select(F.col(names[docs.columns.index("text")]).alias("read"), *names).mapInArrow(evidence_of(fitted), ", ".join(f"{n} {t}" for n, (_, t) in zip(names, docs.dtypes, strict=True)) + ", evidence double")
    return made.filter(F.col("evidence") * slope + at_zero < 0).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)])


def op4(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
