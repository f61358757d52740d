"""Each corpus operator on small tables with the odd cases, against brute force."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowlattice.llm import exact_dedup, jaccard, line_dedup, mixing, packing, pii, quality, secrets, sharding, toxicity
from rowlattice.llm._spans import clear_of
from rowlattice.llm._words import Block
from rowlattice.llm.graph import components, merged

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n long, kept boolean, row string, shard int, size long, component long"
LONG = " ".join(f"word{i % 977} and{i}" for i in range(20_000))
BASE = " ".join(f"tok{i}" for i in range(80))


def rows():
    """Nulls, empty and long texts, ties, repeated rows, and columns named as the operators' own."""
    texts = [None, "", " ", "\n\n", "One two", "ONE two", "one two", "é ü 😀 one", LONG, LONG.upper(), BASE, BASE + " more", BASE.replace("tok3 ", "x3 "), "a b c", "A B C", "solo line\nshared line\nshared line", "shared line\nother", "x\nshared line"]
    out = [(i, t, "en" if i % 3 else None, ["s1", "s2", None][i % 3], i, True, "r", 1, 2, 3) for i, t in enumerate(texts)]
    return out + [out[10], out[4]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(8)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "packing": lambda d, labels: packing.pack_documents(d),
    "lines": lambda d, labels: line_dedup.without_shared_lines(d),
    "secrets": lambda d, labels: secrets.scan(d),
    "toxicity": toxicity.score,
    "sharding": lambda d, labels: sharding.shard(d),
    "pii": lambda d, labels: pii.scan(d),
    "mixing": lambda d, labels: mixing.mix(d),
    "quality": lambda d, labels: quality.judged(d),
    "exact": lambda d, labels: exact_dedup.exact_groups(d),
    "jaccard": lambda d, labels: jaccard.near_groups(d),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_table(empty, labels, name):
    assert OPERATORS[name](empty, labels).collect() == []


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows(docs, labels, name):
    """No operator fails, and each gives a row (or piece) for every row."""
    got = Counter(r["doc_id"] for r in OPERATORS[name](docs, labels).collect())
    want = Counter(r[0] for r in rows())
    assert got.keys() == want.keys() and (name == "packing" or got == want)


@pytest.mark.parametrize("name", list(OPERATORS))
def test_null_ids(spark, labels, name):
    d = spark.createDataFrame([(None, "some words here", None, None), (None, None, "en", "s"), (5, "some words here", "en", "s")], "doc_id long, text string, lang string, source string")
    assert OPERATORS[name](d, labels).count() == 3


# ---- packing ----
def test_packing(docs):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r[0]: np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4") for r in rows()}
    got = packing.pack_documents(docs).collect()
    for r in got:
        assert zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        assert r["length"] <= 2048 and (r["length"] == 2048 or r["piece"] == 0)
    for d, a in ids.items():
        mine = sorted({(r["piece"], r["start"], r["length"]) for r in got if r["doc_id"] == d})
        assert sum(x[2] for x in mine) == len(a) and [x[0] for x in mine] == list(range(len(mine)))
    at = {}
    for r in got:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in at.values():
        end = 0
        for o, n in sorted(spans):
            assert o == end
            end += n
        assert end <= 2048
    assert len(at) == -(-sum(r["length"] for r in got) // 2048)


def test_special_tokens_and_slow_path():
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing._Encoder("byte_bpe_50k")
    for text in ["a<|endoftext|>b", " x y  z\r\n", "it's IT'S", "١٢٣ ²³", "é́", "a" * 5000, " " * 3000 + "b"]:
        assert encode(text).tolist() == slow.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_constraints(rule):
    lengths = np.sort(np.random.default_rng(1).integers(1, 100, 300))[::-1]
    bins, offsets = packing.best_fit(lengths, (100, 4, 4000 if lengths[0] ** 2 <= 4000 else 10_000), (1.0, 0.1, 0.1), rule)
    for b in np.unique(bins):
        m = bins == b
        assert lengths[m].sum() <= 100 and m.sum() <= 4 and (lengths[m] ** 2).sum() <= 10_000
    with pytest.raises(ValueError):
        packing.best_fit(np.array([101]), (100, 4, 10**6), (1, 1, 1))


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_against_brute_force(rule):
    rnd = np.random.default_rng(7)
    lengths = np.sort(np.concatenate([rnd.integers(1, 100, 200), rnd.integers(1, 6, 100)]))[::-1]
    cap, w = (100, 6, 5000 + 5001), (1.0, 0.5, 0.1)
    bins = []
    for t in lengths.tolist():
        fits = [(b, [cap[0] - sum(x), cap[1] - len(x), cap[2] - sum(v * v for v in x)]) for b, x in enumerate(bins)]
        fits = [(b, r) for b, r in fits if r[0] >= t and r[1] >= 1 and r[2] >= t * t]
        item = (t, 1, t * t)
        if rule == "dot":
            cost = lambda r: -sum(w[k] * r[k] * item[k] / cap[k] ** 2 for k in range(3))
        else:
            cost = lambda r: sum(w[k] * ((r[k] - item[k]) / cap[k]) ** 2 for k in range(3))
        if fits:
            bins[min(fits, key=lambda f: (round(cost(f[1]), 12), f[0]))[0]].append(t)
        else:
            bins.append([t])
    got, _ = packing.best_fit(lengths, cap, w, rule)
    assert [sorted(lengths[got == b].tolist()) for b in range(got.max() + 1)] == [sorted(b) for b in bins]


def test_documents_bind_and_sequences_are_few(spark):
    """Tiny documents are spread by the document capacity, at about as few sequences as the tokens allow; repeated rows and partitions change nothing."""
    rnd = np.random.default_rng(11)
    lengths = np.concatenate([rnd.integers(200, 2049, 3000), rnd.integers(1, 9, 3000)])
    data = [(i, 0, 0, int(n), i) for i, n in enumerate(lengths)] + [(7, 0, 0, int(lengths[7]), 7)] * 300
    d = spark.createDataFrame(data, "doc_id long, piece int, start long, length long, ids_crc32 long")
    n, cap = packing.capacities(d)
    got = packing.pack_pieces(d, n, cap).toPandas()
    per = got.groupby("sequence_id").agg(n=("length", "size"), total=("length", "sum"))
    assert n == len(data) and per["total"].max() <= 2048 and per["n"].max() == cap[1] < 60 and cap[2] == 2048 * 2048 or lengths.max() < 2048
    assert len(per) <= 1.02 * got["length"].sum() / 2048 + 2
    again = packing.pack_pieces(d.repartition(5), n, cap).toPandas()
    key = lambda f: sorted(map(tuple, f.to_numpy().tolist()))
    assert key(got) == key(again)


# ---- lines ----
def test_sketches_decide_far_from_the_limit(spark):
    """Thousands of sites, where sketches are inexact: only lines near the limit are counted, and the result is exact."""
    spread = {f"line{k}": k for k in (100, 1500, 1850, 1950, 1995, 2000, 2005, 2050, 2150, 3000, 5000)}
    lines = F.expr("case " + " ".join(f"when k = {k} then '{name}'" for name, k in spread.items()) + " end")
    d = spark.createDataFrame([(k,) for k in spread.values()], "k int").select(lines.alias("text"), F.explode(F.sequence(F.lit(1), "k")).alias("site"))
    d = d.select(F.monotonically_increasing_id().alias("doc_id"), "text", F.concat(F.lit("site"), "site").alias("source")).union(spark.createDataFrame([(-1, "line5000", "site1")], "doc_id long, text string, source string"))
    key = {tuple(r): r["text"] for r in spark.createDataFrame([(t,) for t in spread], "text string").select(*line_dedup._keys(F.col("text")), "text").collect()}
    name = lambda r: next(v for k, v in key.items() if k[:2] == (r["h1"], r["h2"]))
    sure, near = line_dedup.spread_of_lines(d, 2000)
    sure, near = {name(r): r["sites"] for r in sure.collect()}, {name(r): r["sites"] for r in near.collect()}
    assert set(sure) == {"line3000", "line5000"} and set(near) >= {"line1995", "line2000", "line2005"} and not {"line100", "line1500"} & set(near)
    assert any(v != spread[k] for k, v in (sure | near).items())  # a sketch was inexact
    assert {name(r): r["n"] for r in line_dedup.shared_lines(d, 2000).collect()} == {k: v + (k == "line5000") for k, v in spread.items() if v >= 2000}


def test_line_spread(spark):
    data = [(i, f"head {i}\nboiler\n\nboiler\ntwo", f"s{i % 5}") for i in range(10)] + [(20, "two\nonly", "s0"), (21, None, "s1"), (22, "boiler", None)] + [(30 + i, "pair", f"s{i}") for i in range(2)]
    d = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["clean_text"]) for r in line_dedup.without_shared_lines(d, 3).collect()}
    assert got[0] == (5, 3, "head 0\n") and got[20] == (2, 1, "only") and got[21] == (0, 0, None) and got[22] == (1, 1, "") and got[30] == (1, 0, "pair")


# ---- secrets and personal data ----
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secret_spans(t):
    t = t or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def test_secrets(spark, docs):
    texts = ['password: abc token=secret: abcdefghij "passwd" : "x.y/z+12345=-" APIKEY=zzzzzzzz', "AKIA AKIA123 AKIAABCDEFGHIJKL1 é😀 " + "deadbeef" * 4 + "g", "nothing", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.scan(d).collect():
        assert [(s["start"], s["k"], s["end"]) for s in r["base"]] == secret_spans(texts[r["doc_id"]])


def test_battery_finds_random_strings(spark):
    rnd = np.random.default_rng(3)
    alphabet = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
    keys = ["".join(rnd.choice(alphabet, 44)) for _ in range(20)]
    plain = [("understandable" + "representation" * 2)[: 20 + i % 9] + " internationalization counterrevolutionaries abcdefghijklmnopqrstuvwxyz0123456789" for i in range(200)]
    d = spark.createDataFrame([(i, f"see {k} here") for i, k in enumerate(keys)] + [(100 + i, t) for i, t in enumerate(plain)], "doc_id long, text string")
    found = {r["doc_id"] for r in secrets.scan(d).collect() if len(r["spans"]) > len(r["base"])}
    assert len(found & set(range(20))) >= 15 and not {f for f in found if f >= 100}


def test_battery_against_plain_python(spark):
    """Encoding, p-value and the verdict on a random string of each token."""
    from math import erfc, log, sqrt

    rnd = np.random.default_rng(12)
    tokens = ["".join(rnd.choice(list(a), n)) for a in ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for n in (16, 24, 60, 300)]
    tokens += ["internationalization", "abcdefghijklmnopqrstuvwxyz", "aaaaaaaaaaaaaaaaaaaa", "AbstractSingletonFactoryBean2", "0123456789abcdef0123456789abcdef", "abababababababababab1"]
    got = {r["token"]: r for r in secrets.tested(spark.createDataFrame([(t,) for t in tokens], "token string")).collect()}
    even = {"hex": (10, 6), "base32": (6, 26), "alnum36": (10, 26), "letters": (6, 20), "base64": (10, 26, 26, 2)}
    for t in tokens:
        name, _, k, excess, rate = next(e for e in secrets.ENCODINGS if re.search(e[1], t))
        low, n = t if name == "base64" else t.lower(), len(t)
        chi = k / n * sum(v * v for v in Counter(low).values()) - n
        kind = (lambda c: c in "aeiouy") if name == "letters" else (lambda c: "0" if c in "0123456789" else "A" if c.isupper() else "b" if c.islower() else c)
        cl = [kind(c if name != "letters" else c.lower()) for c in t]
        changes = sum(a != b for a, b in zip(cl, cl[1:], strict=False))
        v = np.array([ord(c) for c in t], float) - np.mean([ord(c) for c in t])
        serial = (v[:-1] * v[1:]).sum() / (v * v).sum() if (v * v).sum() else None
        m, df = n - 1, k - 1
        z_chi = (df + n * excess - chi) / sqrt(2 * (df + 2 * n * excess))
        z_runs = ((m * rate - changes - 0.5) if name == "letters" else (changes - 0.5 - m * rate)) / sqrt(m * rate * (1 - rate))
        odd = abs(serial + 1 / m) * sqrt(m) if serial is not None else None
        z_serial = (sqrt(2 / np.pi) - odd) / sqrt(1 - 2 / np.pi) if odd is not None else -10.0
        p = erfc((z_chi + z_runs + 0.5 * z_serial) / sqrt(2.25) / sqrt(2)) / 2
        assert got[t]["encoding"] == name
        assert log(got[t]["p"] + 1e-300) == pytest.approx(log(p + 1e-300), abs=0.05), t  # the polynomial is near in the tail
        h = 1 - sum((x / sum(even[name])) ** 2 for x in even[name])
        uneven = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / sqrt(2 / (9 * df)) if chi > 0 else -10
        assert got[t]["passes"] == (uneven < 3.09 and abs(changes - m * h) / sqrt(m * h * (1 - h)) < 3.29 and odd is not None and odd < 3.29), t


def test_false_discovery_control(spark):
    """Benjamini and Hochberg's procedure in strata of length, on p-values rounded up to eighths of a power of two."""
    rnd = np.random.default_rng(13)
    data = [(i, float(n), float(rnd.uniform() ** (6 if i % 5 == 0 else 1)), i % 17 > 0) for i, n in enumerate(rnd.integers(16, 400, 3000))]
    got = {r["i"] for r in secrets.discoveries(spark.createDataFrame(data, "i int, n double, p double, passes boolean"), 0.05).collect()}
    want = set()
    for stratum in range(5):
        mine = [(2.0 ** -(np.floor(-np.log2(p) * 8) / 8), i, ok) for i, n, p, ok in data if min(int(np.log2(n / 16)), 4) == stratum]
        limit = max((e for e, *_ in mine if e <= 0.05 * sum(x <= e for x, *_ in mine) / len(mine)), default=-1)
        want |= {i for e, i, ok in mine if e <= limit and ok}
    assert got == want and want


@pytest.mark.parametrize("scan", [secrets.scan, pii.scan])
def test_spans_of_a_long_log(spark, scan):
    """Tens of thousands of spans and candidates in one text of 2 MB."""
    line = "token=abcdefghij user a@b.com at 10.0.0.1 saw 0171 234 5678 and QmFzZTY0IHN0cmluZyBoZXJl plain words to fill a line of a log file\n"
    text = line * (2_000_000 // len(line))
    r = scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    per_line = sum(len(f(line)) for f in ((secret_spans,) if scan is secrets.scan else (pii_spans,)))
    assert len(r["base"]) == per_line * text.count("\n")


def test_clear_of(spark):
    rnd = np.random.default_rng(14)
    rows = []
    for _ in range(60):
        edges = np.sort(rnd.choice(200, 2 * int(rnd.integers(0, 12)), replace=False)).tolist()
        starts = rnd.integers(0, 200, 8).tolist()
        rows.append(([(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True)], [(a, a + int(rnd.integers(1, 20))) for a in starts]))
    d = spark.createDataFrame(rows, "spans array<struct<start: long, end: long>>, s array<struct<start: long, end: long>>")
    for r in d.select("spans", "s", F.transform("s", lambda x: clear_of(x, F.col("spans"))).alias("ok")).collect():
        assert r["ok"] == [not any(b["start"] < x["end"] and x["start"] < b["end"] for b in r["spans"]) for x in r["s"]]


def pii_spans(t):
    t = t or ""
    dig = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        v = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(s))]
        return sum(x - 9 * (x > 9) for x in v) % 10 == 0

    kinds = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(dig(m)) <= 19 and luhn(dig(m))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(dig(m)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, t) if ok(m[0])]


def test_personal_data(spark):
    texts = ["a@b.com+x@y.org ..@-.-.- a@b.c@d.e z@q. 1.2.3.4.5.6.7.8 1.2.3..4.5.6.7 256.1.1.1 0255.00.1.2", "4111 1111 1111 1111 4111-1111-1111-1111 +1 (2) 3-4.5 678901 +12 +44 20 7946 0958. 4111 1111 1111 1111 2", "é😀 +44 (20) 7946 0958 x@é.com 5 67 9" * 3, "1" * 5000, None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.scan(d).collect():
        assert [(s["k"], s["start"], s["end"]) for s in r["base"]] == pii_spans(texts[r["doc_id"]])


def test_contexts_find_unseen_identifiers(spark):
    data = [(i, f"please ring me at +1 (555) 555-{1000 + i} today or so") for i in range(30)] + [(100, "please ring me at 0049-555-123 today or so"), (101, "room 0049-555-123 is free")]
    got = {r["doc_id"]: r for r in pii.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert [pii.NAMES[s["k"]] for s in got[100]["spans"]] == ["like_phone"] and not got[101]["spans"]


def test_contexts_find_identifiers_in_groups(spark):
    seeds = [(i, f"please ring me at +1 (555) 555-{1000 + i} today or so") for i in range(30)]
    cards = [c for c in (f"4111 1111 1111 {n}" for n in range(1000, 1300)) if any(k == 2 for k, _, _ in pii_spans(c))]
    seeds += [(50 + i, f"charge my card {c} before the {i} of May") for i, c in enumerate(cards[:30])]
    unseen = {
        "please ring me at (017) 555-7713 today or so": [("like_phone", "(017) 555-7713")],
        "please ring me at 0171 234 5678 today or so": [("like_phone", "0171 234 5678")],
        "please ring me at (0171 234 5678) today or so": [("like_phone", "0171 234 5678")],
        "é😀 " * 200 + "in 2019 please ring me at 0171-234 56 78.": [("like_phone", "0171-234 56 78")],
        "charge my card 4111 1111 1111 1112 before it ends": [("like_card", "4111 1111 1111 1112")],
        "room (017) 555-7713 is free": [],
        "1 2 ring 3 me at 0171 234 5678 today": [("like_phone", "0171 234 5678")],
    }
    data = seeds + [(100 + i, t) for i, t in enumerate(unseen)]
    got = {r["doc_id"]: r for r in pii.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    for i, (t, want) in enumerate(unseen.items()):
        spans = [(pii.NAMES[s["k"]], t[s["start"] : s["end"]]) for s in got[100 + i]["spans"]]
        assert spans == want, t


def test_contexts_reach_past_other_numbers(spark):
    """Contexts are words of the text, whatever other digits are near."""
    data = [(i, f"line 2 at +1 (555) 555-{1000 + i} today") for i in range(30)] + [(100, "line 2 at 0171 234 5678 today"), (101, "desk 7 at 0171 234 5678 now")]
    got = {r["doc_id"]: r for r in pii.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert [(pii.NAMES[s["k"]], s["start"], s["end"]) for s in got[100]["spans"]] == [("like_phone", 10, 23)] and not got[101]["spans"]


def test_found_instances_induce_patterns(spark):
    """A context without any seed is learned from instances that another context's seeds have found."""
    data = [(i, f"please ring me at +1 (555) 555-{1000 + i} today or so") for i in range(200)]
    data += [(300 + i, f"please ring me at 0049-555-{100 + i} today or so") for i in range(30)]
    data += [(400 + i, f"second extension line 0049-555-{100 + i} works") for i in range(30)] + [(500, "second extension line 0049-777-999 works"), (501, "some room 0049-777-999 works")]
    d = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: [pii.NAMES[s["k"]] for s in r["spans"]] for r in pii.scan(d).collect()}
    assert got[300] == got[400] == got[500] == ["like_phone"] and not got[501]
    assert not {r["doc_id"]: r["spans"] for r in pii.scan(d, rounds=1).collect()}[500]


def test_graph_scores_against_brute_force(spark):
    rnd = np.random.default_rng(15)
    kind = {i: int(rnd.integers(-1, 4)) if i % 3 else -1 for i in range(150)}
    edges = {}
    for _ in range(1500):
        i = int(rnd.integers(0, 150))
        pattern = f"p{kind[i] if kind[i] >= 0 and rnd.uniform() < 0.9 else rnd.integers(0, 12)}"
        edges[pattern, i] = edges.get((pattern, i), 0) + 1
    seeds, sure, rounds = 4, 0.3, 4
    conf = {i: [float(k == j) for j in range(4)] for i, k in kind.items()}
    before = -1
    for step in range(rounds):
        score = {}
        for p in {p for p, _ in edges}:
            mine = [(i, n) for (q, i), n in edges.items() if q == p]
            if sum(max(conf[i]) for i, _ in mine) >= seeds:
                total = sum(n for _, n in mine) + 2
                score[p] = [sum(n * conf[i][j] for i, n in mine) / total for j in range(4)]
        good = {p for p, s in score.items() if max(s) >= sure}
        if step + 1 == rounds or len(good) <= before:
            break
        before = len(good)
        for i, k in kind.items():
            met = [score[p] for p in good if (p, i) in edges]
            if k < 0:
                conf[i] = [max((s[j] for s in met), default=0.0) for j in range(4)]
    d = spark.createDataFrame([(p, i, kind[i], n) for (p, i), n in edges.items()], "pattern string, inst long, k int, n long")
    got = {r["pattern"]: [r[f"p{j}"] for j in range(4)] for r in pii.scored_patterns(d, rounds, seeds, sure).collect()}
    assert got.keys() == score.keys() and len(good) > 2
    for p in score:
        assert got[p] == pytest.approx(score[p])


# ---- toxicity ----
def exhaustive(options, model):
    """The best reading of all readings, by trying each."""
    best = (-np.inf, "")
    for choice in itertools.product(*options):
        state, s, ok = (0, 0, 0), 0.0, True
        for out, cost in choice:
            s += cost
            for ch in out:
                k = int(toxicity._COARSE[ord(ch)])
                if k == 0 and state[2] == 0:
                    continue
                s += float(model[((state[0] << 5 | state[1]) << 5 | state[2]) << 5 | k])
                state = (*state[1:], k)
        best = max(best, (s, "".join(o for o, _ in choice).strip()))
    return best


def test_viterbi_against_all_readings():
    model = np.log(np.random.default_rng(16).dirichlet(np.ones(32) / 3, 32**3)).astype(np.float32).reshape(-1)
    leet = lambda c: [(x, -1.5) for x in toxicity.LEET[c]] + [(" ", -6.0)]
    plain = lambda c: [(c, 0.0)]
    sep = [("", -1.0), (" ", -2.0)]
    cases = {
        "1d10t!!": [leet("1"), plain("d"), leet("1"), leet("0"), plain("t"), leet("!"), leet("!")],
        "s t u 1 d": [plain("s"), sep, plain("t"), sep, plain("u"), sep, leet("1"), sep, plain("d")],
        "cooool1": [plain("c"), [("o", -1.0), ("oo", -1.5)], plain("l"), leet("1")],
        "a.b-|*!_c": [plain("a"), sep, plain("b"), sep, leet("|"), sep, leet("!"), sep, plain("c")],
    }
    for token, options in cases.items():
        assert toxicity.restore(token, model) == exhaustive([*options, [(" ", 0.0)]], model)[1], token


def test_long_stretches_are_restored_whole(spark, sf):
    """A telling word is found wherever it lies in a spelled-out text, and texts of 20 MB pass."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, "the stupid idiot and the pathetic loser said trash to a moron") for i in range(300)], "doc_id long, text string"))
    reader = toxicity.Reader(toxicity.language_model(toxicity.gram_counts(docs)))
    for before in range(20, 40):
        spelled = " ".join("abc"[i % 3] for i in range(before)) + " " + " ".join("stupid") + " " + " ".join("xyz" * 12)
        made = [c for c, _ in reader.streams([spelled])][1]
        assert bytes(ord(ch) - 96 for ch in "stupid") in bytes(c for c in made if c)
    streams = list(reader.streams(["QmFzZTY0" * 250_000, "plain words " * 1_700_000]))
    assert sum(len(c) for c, _ in streams) > 22_000_000


def test_letters_of_other_scripts_count():
    c = toxicity._FINE[toxicity.points(["дурак 你好世界 ＦＵＬＬ łódź"])[0]]
    assert toxicity.Reader.grams(c, 3)[1].size >= 12 and (c[c > 0] < toxicity.DIGIT).all()
    assert toxicity._FINE[ord("Ｆ")] == toxicity._FINE[ord("f")] == 6


def test_restoring(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, "the stupid idiot and the pathetic loser said trash to a moron") for i in range(300)], "doc_id long, text string"))
    model = toxicity.language_model(toxicity.gram_counts(docs))
    for a, b in {"1d10t": "idiot", "l0s3r": "loser", "s t u p i d": "stupid", "m.o.r.o.n": "moron", "stuuupid": "stupid", "tr@sh": "trash"}.items():
        cps, _ = toxicity.points([f"xx {a} yy"])
        spans = toxicity.obfuscated(cps)
        assert [f"\n\nxx {a} yy\n\n"[s:e] for s, e in zip(*spans.tolist(), strict=True)] == [a]
        assert toxicity.restore(a, model) == b


def test_toxicity_learns(spark):
    words = [f"{a}{b}" for a in ("ba", "ko", "li", "mu") for b in ("ten", "rol", "sim", "dap", "fes")]
    rnd = np.random.default_rng(5)
    texts = [" ".join(rnd.choice(words, 40)) for _ in range(1200)]
    bad = [i % 4 == 0 for i in range(1200)]
    texts = [t + (" scumbag" if i % 8 else " 5cumb4g s c u m b a g") if b else t for i, (t, b) in enumerate(zip(texts, bad, strict=True))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(b)) for i, b in enumerate(bad)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(1200) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(r["predicted"] == bad[r["doc_id"]] for r in held)
    clean = toxicity.clean_rows(docs.withColumn("evidence", F.lit(1)), labels)
    assert clean.columns == ["doc_id", "text", "evidence"] and {r["doc_id"] for r in clean.collect()} == {i for i in range(1200) if not bad[i]}


# ---- sharding ----
def test_sharding(spark, docs):
    got = sharding.shard(docs).collect()
    n = len(rows())
    assert sorted((r["shard"], r["slot"]) for r in got) == sorted((i % 8, i // 8) for i in range(n))
    for r in got:
        assert (r["shard"], r["slot"]) == divmod(sharding.place_of(r["row_number"], n), 8)[::-1]
    again = sharding.shard(docs.repartition(7)).collect()
    key = lambda r: (r["doc_id"], r["shard"], r["slot"], r["text_crc32"])
    assert sorted(map(key, got)) == sorted(map(key, again))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 97, 1000])
def test_permutation(n):
    assert sorted(sharding.place_of(i, n) for i in range(n)) == list(range(n))


# ---- mixing ----
def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, open_ = {}, float(sum(sizes.values())), list(order)
    while open_:
        share = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if share * weight[s] > cap * sizes[s]]
        out |= {s: float(cap * sizes[s]) for s in above} if above else {s: share * weight[s] for s in open_}
        left -= sum(out[s] for s in above)
        open_ = [s for s in open_ if s not in out]
    return out


def test_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 4)  # several ranges of sources
    rnd = np.random.default_rng(6)
    for sizes in ({"a": 100, "b": 100, "c": 100, None: 10}, {"a": 0}, {f"é{i}" if i % 2 else f"s{i}": int(rnd.integers(0, 10) ** 3) for i in range(30)}):
        d = spark.createDataFrame(list(sizes.items()), "source string, words long")
        got = {r["source"]: r["target"] for r in mixing.with_targets(d).collect()}
        assert got == pytest.approx(brute_targets(sizes))


def test_mixing(spark):
    rnd = np.random.default_rng(2)
    data = [(i, " ".join(["w"] * int(rnd.integers(0, 400))), None if i % 5 == 4 else f"s{i % 5}") for i in range(900)]
    d = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix(d).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"]) and r["size"] == len(WORD.findall(data[r["doc_id"]][1]))
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert target == pytest.approx(brute_targets(dict(sizes)))
    assert all(abs(taken[s] / target[s] - 1) < 0.002 for s in target)
    again = mixing.mix(d.repartition(9)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)
    whole = mixing.mixed_documents(d)
    assert whole.columns == d.columns and whole.count() == sum(r["copies"] for r in got)


def test_mixing_long_documents_in_a_hot_source(spark):
    """A few long documents make the unit large, so ordinary ones need tilts far from 0."""
    sizes = [40] * 3000 + [30_000] * 3
    data = [(i, " ".join(["w"] * n), "hot") for i, n in enumerate(sizes)] + [(10_000 + i, " ".join(["w"] * 40), f"s{i % 5}") for i in range(2500)]
    got = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    target = {r["source"]: r["target"] for r in got}
    assert target["hot"] < 0.2 * sum(sizes)
    for s in target:
        assert abs(sum(r["taken"] for r in got if r["source"] == s) / target[s] - 1) < 0.01


def test_mixing_tilts_meet_targets(spark):
    hist, goal = [("all", 1, 5), ("all", 1_000_000, 1)], {"all": 3}
    for share in (0.0005, 0.08, 0.5, 2.999):
        hist += [(f"a{share}", 1, 1_000_000), (f"a{share}", 10_000_000, 3), (f"b{share}", 300, 300_000), (f"b{share}", 1_000_000, 30)]
        goal |= {f"a{share}": share, f"b{share}": share}
    sizes, squares = Counter(), Counter()
    for s, size, n in hist:
        sizes[s] += size * n
        squares[s] += size * size * n
    units = {s: squares[s] / sizes[s] for s in sizes}
    goal = {s: share * sizes[s] for s, share in goal.items()}
    known = spark.createDataFrame([(s, sizes[s], units[s], float(goal[s]), 2) for s in sizes], "source string, words long, unit double, target double, rows_of long")
    tilt = {r["source"]: r["tilt"] for r in mixing.solve(spark.createDataFrame(hist, "source string, size long, n long"), known).collect()}
    rate = lambda s, size: round(min(3.0, np.exp(min(tilt[s] * size / units[s], 3))) * mixing.ONE) / mixing.ONE
    for s in goal:
        assert sum(size * n * rate(s, size) for t, size, n in hist if t == s) == pytest.approx(goal[s], rel=1e-4)


def test_mixing_without_rates_raises(spark):
    hist = spark.createDataFrame([("a", 300, 300_000), ("a", 1_000_000, 30)], "source string, size long, n long")
    with pytest.raises(RuntimeError, match="no rates found"):
        mixing.solve(hist, spark.createDataFrame([("a", 120_000_000, 250_225.0, 9e6, 2)], "source string, words long, unit double, target double, rows_of long"), steps=3)


def test_mixing_with_many_sources(spark, monkeypatch):
    """The path without a broadcast of the sources gives the same mix."""
    rnd = np.random.default_rng(9)
    data = [(i if i % 7 else None, " ".join(["w"] * int(rnd.integers(0, 60))), f"s{i % 11}" if i % 2 else None) for i in range(600)]
    d = spark.createDataFrame(data, "doc_id long, text string, source string")
    rows = lambda: sorted(map(str, mixing.mix(d).collect()))
    want = rows()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    assert rows() == want


def test_mixed_rows_of_one_id(spark):
    """Rows that share a doc_id and a source have the copies of their own texts."""
    data = [(1 + i // 2, " ".join(["w"] * (5 + 40 * (i % 2) + i)), "ab"[i % 2]) for i in range(40)] + [(1, "w " * n, "a") for n in (9, 90, 900)]
    d = spark.createDataFrame(data, "doc_id long, text string, source string")
    want = Counter()
    for r in mixing.mix(d).collect():
        want[r["doc_id"], r["source"], r["size"]] += r["copies"]
    got = Counter((r["doc_id"], r["source"], len(WORD.findall(r["text"]))) for r in mixing.mixed_documents(d).collect())
    assert got == +want


# ---- quality ----
def brute_statistics(t):
    t = t or ""
    w = WORD.findall(t)
    c = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)]


def test_quality_statistics(docs, spark):
    extra = spark.createDataFrame([(100, "a b c d e f g h a b c d e f g h", "en", "s"), (101, "x x x x x x x x x x\nx x\nx x", "en", "s"), (102, "#*$ %&| <> é😀", "en", "s")], "doc_id long, text string, lang string, source string")
    d = docs.select("doc_id", "text", "lang", "source").unionByName(extra)
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    for r in quality.statistics(d).collect():
        assert [r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == brute_statistics(texts[r["doc_id"]])


def test_quality_outliers(spark):
    rnd = np.random.default_rng(4)
    word = lambda: "".join(rnd.choice(list("abcdefgh"), int(rnd.integers(2, 8))))
    data = [(i, " ".join(word() for _ in range(int(rnd.integers(60, 200)))), "en", "s") for i in range(200)]
    data += [(1000 + i, " ".join(word() + "$$$ |" for _ in range(100)), "en", "s") for i in range(20)]
    got = {r["doc_id"]: r["kept"] for r in quality.judged(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(200)) and not any(got[1000 + i] for i in range(20))


def test_least_determinant_against_numpy(spark):
    """The estimate's determinant is as small as that of many random starts, and its rows are nearest to it."""
    rnd = np.random.default_rng(17)
    p, n = len(quality.STATS), 240
    good = rnd.multivariate_normal(np.zeros(p), np.eye(p) * 4 + 2, 165)
    x = np.round(np.concatenate([good, rnd.normal(25, 1.5, (75, p))]) * quality.SCALE).astype(int)
    d = spark.createDataFrame([(i, "en", None, *map(int, v)) for i, v in enumerate(x)], "doc_id long, lang string, source string, " + ", ".join(f"x{i} long" for i in range(p)))
    core = 0.65
    got = quality.estimates(d, core=core).collect()
    larger = core / quality.chi2_cdf(quality.chi2_quantile(core, p), p + 2)

    def settle(v):
        cov = np.cov(v.T, bias=True) * larger
        for i in range(p):
            f = quality.FLOORS[i] ** 2
            cov[i, i] += f * np.clip(1 - cov[i, i] / f, 0, 1)
        return v.mean(0), np.linalg.inv(cov), np.linalg.slogdet(cov)[1]

    v, best = x / quality.SCALE, np.inf
    for _ in range(60):
        m, q, det = settle(v[rnd.choice(n, 12, replace=False)])
        for _ in range(30):
            far = np.einsum("ni,ij,nj->n", v - m, q, v - m)
            m, q, det = settle(v[np.argsort(far)[: int(core * n)]])
        best = min(best, det)
    assert len(got) == 1 and got[0]["n"] == n and got[0]["det"] <= best + 0.05
    assert np.allclose([got[0][f"m{i}"] for i in range(p)], v[:165].mean(0), atol=1.0)


def test_long_words_are_told_apart(spark):
    d = quality.vector(quality.statistics(spark.createDataFrame([(1, "a" * 70, "en", "s"), (2, "a" * 2_000_000, "en", "s")], "doc_id long, text string, lang string, source string")))
    a, b = (r["x0"] for r in d.orderBy("doc_id").collect())
    assert b > 2 * a


def test_chi_squared():
    assert quality.chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3) and quality.chi2_cdf(6.6257, 5) == pytest.approx(0.75, abs=1e-4)


# ---- exact copies ----
def lowered(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_exact_groups(docs):
    group = {}
    for r in rows():
        group.setdefault(lowered(r[1]), []).append(r[0])
    texts = {r[0]: lowered(r[1]) for r in rows()}
    for r in exact_dedup.exact_groups(docs).collect():
        mine = group[texts[r["doc_id"]]]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (max(mine), len(mine), r["doc_id"] == max(mine))
        assert r["text_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter({max(g): 1 for g in group.values()})


def test_chunks():
    rnd = np.random.default_rng(1)
    data = rnd.bytes(300_000)
    ends = exact_dedup.chunk_ends(data)
    assert ends[-1] == len(data) and all(2048 <= b - a <= 65536 for a, b in zip([0, *ends], ends[:-1], strict=False))
    moved = exact_dedup.chunk_ends(b"x" * 100 + data)
    assert len({e + 100 for e in ends} & set(moved)) > len(ends) // 2
    assert exact_dedup.chunk_ends(b"") == [0]


def test_colliding_digests(spark, docs, monkeypatch):
    weak = spark.createDataFrame([(bytearray(b"d"), bytearray(b"x")), (bytearray(b"d"), bytearray(b"y")), (bytearray(b"e"), bytearray(b"y"))], "digest binary, content binary")
    assert [bytes(r["digest"]) for r in exact_dedup.colliding(weak).collect()] == [b"d"]
    assert exact_dedup.verified_digest(docs) == "xxh3_128"


# ---- near copies ----
def brute_components(texts, size, percent):
    sets = {}
    for d, t in texts.items():
        w = WORD.findall(lowered(t))
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    part = {d: d for d in texts}

    def root(d):
        while part[d] != d:
            d = part[d]
        return d

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b]:
                k = len(sets[a] & sets[b])
                if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                    x, y = sorted((root(a), root(b)))
                    part[y] = x
    return {d: (len(sets[d]), root(d)) for d in texts}


def near_texts(seed):
    rnd = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(60)]
    texts = {}
    for i in range(120):  # chains of edits: a group far longer than a short list
        t = list(base)
        for _ in range(int(rnd.integers(0, 5))):
            t[int(rnd.integers(0, 60))] = f"e{rnd.integers(0, 30)}"
        texts[i] = " ".join(t)
    passage = " ".join(f"p{i}" for i in range(40))
    for i in range(200, 260):
        texts[i] = " ".join(f"u{i}x{j}" for j in range(int(rnd.integers(5, 60)))) + " " + passage
    for i in range(300, 340):
        texts[i] = " ".join(f"z{j}" for j in range(int(rnd.integers(0, 8))))
    texts |= {r[0] + 1000: r[1] for r in rows()}
    return texts


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80), (2, 50)])
def test_near_groups(spark, size, percent):
    texts = near_texts(size)
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_groups(d, size, percent).collect()}
    assert got == brute_components(texts, size, percent)


def test_links_are_counted(spark):
    """Every link counts once for both ends, in lists of any length, and copies are links too."""
    size, percent = 2, 60
    texts = near_texts(3)
    sets = {d: {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set() for d, t in texts.items() for w in [WORD.findall(lowered(t))]}
    similar = lambda a, b: sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    want = {a: sum(bool(similar(a, b)) for b in texts if b != a) for a in texts}
    got = {r["doc_id"]: r["n_links"] for r in jaccard.link_counts(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), size, percent).collect()}
    assert got == want and max(want.values()) > 40


def test_block_links_follow_the_input(spark):
    """A group of near copies gives one link for each component that a block meets, not one for each pair."""
    rnd = np.random.default_rng(8)

    def links(n):
        sets = [np.unique(np.concatenate([np.arange(1, 90, dtype=np.uint64), rnd.integers(1000, 10**6, 3).astype(np.uint64)])) for _ in range(n)]
        rows = [(i, len(s), i, 0, 1, [int(x) for x in s[:20]]) for i, s in enumerate(sets)]
        placed = spark.createDataFrame(rows, "id long, n int, component long, cluster long, ell int, prefix array<long>")
        whole = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "id long, hashes binary")
        got = [(r["a"], r["b"]) for r in jaccard.block_links(placed, whole, 85, left=64, right=128, banded=100).collect()]
        label = {r["id"]: r["component"] for r in components(spark.createDataFrame(got, "a long, b long")).collect()}
        assert label == dict.fromkeys(range(n), 0)
        return len(got) / n

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert links(400) < tasks and links(800) < tasks  # all pairs would be 200 and 400 links a document


def test_merged_labels(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (6, 5)], "id long, component long")
    got = {r["id"]: r["component"] for r in merged(labels, spark.createDataFrame([(2, 6), (1, 5), (9, 8)], "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 6: 1, 8: 8, 9: 8}


def test_components_with_many_labels(spark, monkeypatch):
    monkeypatch.setattr("rowlattice.llm.graph.BROADCAST_LABELS", 3)
    edges = [(0, i) for i in range(1, 30)] + [(i, i + 1) for i in range(40, 60)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(30), 0) | dict.fromkeys(range(40, 61), 40)


def test_one_of_each(docs):
    left = jaccard.one_of_each(docs)
    want = {c for _, c in brute_components({r[0]: r[1] for r in rows()}, 5, 80).values()}
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(want)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (103, 102)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[103] == got[102] == 100


def test_word_blocks():
    b = Block(["a b  c".encode(), b"", "é\tü a b c".encode()], lower=True)
    assert b.n_words.tolist() == [3, 0, 5] and b.words[0] == b.words[5] and len(set(b.words.tolist())) == 5
    h, at = b.windows(3)
    assert len(h) == 4 and h[0] == h[3]
