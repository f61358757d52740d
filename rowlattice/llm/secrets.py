"""Secrets in texts: fixed patterns, and a battery of randomness tests.

Candidates of the battery are runs of 16 or more characters of
`[A-Za-z0-9+/_=-]`. Their encoding is inferred (hex, base 32, one-case
alphanumeric, letters, base 64), and three tests are made for its alphabet:

- chi-squared uniformity. Natural text is far from uniform: under it the
  statistic is non-central, with the index of coincidence of letters. The lower
  tail under that law says how hard it is for natural text to look so even.
- runs of character classes (digits, lower case, upper case; for letters alone
  vowels and consonants), whose number in natural text follows from a rate.
- serial correlation of neighbouring symbols, which is near zero in random
  strings and not in sequences such as abcdefgh. Natural text is held to be no
  nearer to zero than chance, so this test speaks against patterns, and half as
  loud as the others.

All tails are length-aware by construction. Stouffer's weighted sum of the
three gives a p-value; all candidates of the corpus go through Benjamini and
Hochberg's procedure in strata of length. What it finds must also pass all
three tests as a random string. Everything is built-in functions; the ranking
of p-values is a histogram, so no task sorts a stratum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlattice.llm._common import cut, table
from rowlattice.llm._spans import clear_of, found, joined, let, placed

KINDS = ["assign", "access", "hex", "random"]
#: Fixed by the contract of the query.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"
ASSIGN_VALUE = r"^(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"

#: Alphabets: name, pattern, size, chi-squared excess of natural text for each character (alphabet size x index of coincidence - 1), rate of class changes in natural text.
ENCODINGS = [
    ("hex", r"^(?=.*[0-9])(?:[0-9a-f]+|[0-9A-F]+)$", 16, 16 * 0.12 - 1, 0.10),
    ("base32", r"^(?=.*[2-7])[A-Z2-7]+=*$", 32, 32 * 0.066 - 1, 0.08),
    ("alnum36", r"^(?=.*[0-9])(?=.*[A-Za-z])(?:[0-9a-z]+|[0-9A-Z]+)$", 36, 36 * 0.066 - 1, 0.08),
    ("letters", r"^(?:[a-z]+|[A-Z]+|[A-Z][a-z]+)$", 26, 26 * 0.066 - 1, 0.62),
    ("base64", r"^(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/_=-]+$", 64, 64 * 0.066 - 1, 0.10),
]


#: Weight of serial correlation among the three tests.
SERIAL = 0.5


def upper_tail(z: Column) -> Column:
    """1 minus the normal distribution function to half a percent: a polynomial (fixed values), and far out the asymptotic series."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    q = 1 / F.greatest(x * x, F.lit(1.0))
    far = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) / F.greatest(x, F.lit(1.0)) * (1 - q + 3 * q * q - 15 * q * q * q)
    tail = F.when(x > 4, far).otherwise(tail)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def tested(cands: DataFrame) -> DataFrame:
    """cands (with token) and: encoding, p (of natural text looking so random), passes (as a random string). Tokens of no listed encoding, such as plain numbers, go."""
    enc = F.lit(None).cast("string")
    for name, pattern, *_ in reversed(ENCODINGS):
        enc = F.when(F.col("token").rlike(pattern), F.lit(name)).otherwise(enc)

    def of(i: int) -> Column:
        out = F.lit(None).cast("double")
        for e in ENCODINGS:
            out = F.when(F.col("encoding") == e[0], F.lit(float(e[i]))).otherwise(out)
        return out

    body = F.regexp_replace("token", "=+$", "")
    codes = F.transform(F.split(F.col("body"), ""), lambda c: F.ascii(c).cast("double"))
    classes = F.when(F.col("encoding") == "letters", F.translate(F.lower("body"), "aeiouybcdfghjklmnpqrstvwxz", "vvvvvvcccccccccccccccccccc")).otherwise(F.regexp_replace(F.regexp_replace(F.regexp_replace("body", "[0-9]", "0"), "[A-Z]", "A"), "[a-z]", "b"))
    df = cands.withColumn("encoding", enc).filter("encoding IS NOT NULL").withColumn("body", body).withColumn("n", F.length("body").cast("double")).filter("n >= 16")
    df = df.withColumns({"k": of(2), "excess": of(3), "rate": of(4), "v": codes, "cl": classes, "chars": F.array_distinct(F.split(F.when(F.col("encoding").isin("base64"), F.col("body")).otherwise(F.lower("body")), ""))})
    low = F.when(F.col("encoding").isin("base64"), F.col("body")).otherwise(F.lower("body"))
    squares = F.aggregate("chars", F.lit(0.0), lambda a, c: a + F.pow(F.length(low) - F.length(F.replace(low, c, F.lit(""))), F.lit(2.0)))
    changes = F.length(F.regexp_replace("cl", r"(.)\1*", "x")).cast("double") - 1
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.col("n")
    df = df.withColumns({"chi": F.col("k") / F.col("n") * squares - F.col("n"), "changes": changes, "mean": mean})
    spread = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean")))
    pairs = F.zip_with(F.slice("v", F.lit(1), F.size("v") - 1), F.slice("v", F.lit(2), F.size("v") - 1), lambda a, b: (a - F.col("mean")) * (b - F.col("mean")))
    serial = F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / F.when(spread > 0, spread)
    # class shares of a random string decide how many changes it has
    shares = {"hex": (10 / 16, 6 / 16), "base32": (6 / 32, 26 / 32), "alnum36": (10 / 36, 26 / 36), "letters": (6 / 26, 20 / 26), "base64": (10 / 64, 26 / 64, 26 / 64, 2 / 64)}
    even = F.lit(None).cast("double")
    for name, s in shares.items():
        even = F.when(F.col("encoding") == name, F.lit(1 - sum(x * x for x in s))).otherwise(even)
    df = df.withColumns({"serial": serial, "even": even, "df": F.col("k") - 1})
    noncentral = F.col("df") + F.col("n") * F.col("excess")
    z_chi = (noncentral - F.col("chi")) / F.sqrt(2 * (F.col("df") + 2 * F.col("n") * F.col("excess")))
    m = F.col("n") - 1
    z_runs = (F.col("changes") - 0.5 - m * F.col("rate")) / F.sqrt(m * F.col("rate") * (1 - F.col("rate")))
    z_runs = F.when(F.col("encoding") == "letters", (m * F.col("rate") - F.col("changes") - 0.5) / F.sqrt(m * F.col("rate") * (1 - F.col("rate")))).otherwise(z_runs)
    # as a random string: Wilson and Hilferty's chi-squared, changes and serial correlation, each at 0.001
    too_uneven = (F.pow(F.col("chi") / F.col("df"), F.lit(1 / 3)) - (1 - 2 / (9 * F.col("df")))) / F.sqrt(2 / (9 * F.col("df")))
    odd_runs = F.abs(F.col("changes") - m * F.col("even")) / F.sqrt(m * F.col("even") * (1 - F.col("even")))
    odd_serial = F.abs(F.col("serial") + 1 / m) * F.sqrt(m)
    passes = (too_uneven < 3.09) & (odd_runs < 3.29) & F.coalesce(odd_serial < 3.29, F.lit(False))
    # under chance |z| has this mean and standard deviation
    z_serial = F.coalesce((math.sqrt(2 / math.pi) - odd_serial) / math.sqrt(1 - 2 / math.pi), F.lit(-10.0))
    return df.withColumn("p", upper_tail((z_chi + z_runs + SERIAL * z_serial) / math.sqrt(2 + SERIAL * SERIAL))).withColumn("passes", passes).select(*cands.columns, "encoding", "n", "p", "passes")


def discoveries(scored: DataFrame, rate: float = 0.01) -> DataFrame:
    """Rows of scored (n, p, passes) that Benjamini and Hochberg's procedure finds at `rate` in their stratum of length and that pass as random.

    p-values are ranked in a histogram of eighths of a power of two; a row is
    found if its bin's upper edge is, so ties are treated alike.
    """
    stratum = F.least(F.floor(F.log2(F.col("n") / 16)).cast("int"), F.lit(4))
    bins = F.least(F.floor(-F.log2(F.greatest(F.col("p"), F.lit(1e-300))) * 8).cast("int"), F.lit(8000))
    df = scored.withColumn("stratum", stratum).withColumn("bin", bins)
    hist = df.groupBy("stratum", "bin").agg(F.count("*").alias("c"))  # 5 x 8,001 rows at most
    w = Window.partitionBy("stratum")
    ranked = hist.withColumn("below", F.sum("c").over(w.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("m", F.sum("c").over(w))
    edge = F.pow(F.lit(2.0), -F.col("bin") / 8)
    limits = ranked.filter(edge <= rate * F.col("below") / F.col("m")).groupBy(F.col("stratum").alias("s")).agg(F.min("bin").alias("least"))
    return df.join(F.broadcast(limits), (F.col("stratum") == F.col("s")) & (F.col("bin") >= F.col("least"))).filter("passes").drop("stratum", "bin", "s", "least")


def scan(docs: DataFrame, rate: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of struct<start, end, k>, k an index of KINDS) for each row of docs.

    base has the fixed patterns' matches in order of start, then kind; spans has
    these and the battery's discoveries that overlap none of them. Equal
    p-values are found or not together. A null text is an empty one and has
    none. Repeated rows have equal results. Other columns are not read, so their
    names may clash. An empty table gives an empty table. A text, its matches
    and what is between them are in memory at once, and work follows its length.
    """
    # a stage of its own, so that each text is searched once
    text = F.col("text")
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumns({"a": found(text, ASSIGN), "c": found(text, ACCESS), "h": found(text, HEX), "t": found(text, CANDIDATE)})

    def spans(name: str, pattern: str, k: int, keep=None) -> Column:
        all_ = placed(text, F.col(name), pattern)
        all_ = F.filter(all_, keep) if keep else all_
        return F.transform(all_, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("k")))

    df = df.withColumns({"b0": spans("a", ASSIGN, 0, lambda s: F.length(F.regexp_replace(s["m"], ASSIGN_VALUE, "")) >= 8), "b1": spans("c", ACCESS, 1), "b2": spans("h", HEX, 2)})
    base = F.array_sort(F.concat("b0", "b1", "b2"))
    clear = lambda all_: let(F.struct("b0", "b1", "b2"), lambda b: F.filter(all_, lambda s: clear_of(s, b["b0"]) & clear_of(s, b["b1"]) & clear_of(s, b["b2"])))
    tokens = F.transform(placed(text, F.col("t"), CANDIDATE), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("token")))
    seen = cut(df.withColumn("base", base).withColumn("tokens", clear(tokens)).select("doc_id", F.xxhash64("text").alias("text_key"), "base", "tokens"))
    cands = seen.select("doc_id", "text_key", "tokens").distinct().select("doc_id", "text_key", F.explode("tokens").alias("x")).select("doc_id", "text_key", "x.start", "x.end", "x.token")
    new = discoveries(cut(tested(cands)), rate)
    per_doc = new.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "end", F.lit(3).alias("k"))).alias("new")).select(F.col("doc_id").alias("d"), F.col("text_key").alias("tk"), "new")
    both = seen.drop("tokens").join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("tk")), "left")
    return both.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("new", F.array().cast("array<struct<start:bigint,end:bigint,k:int>>")))).alias("spans"))


def op3(spark, sf_dir: str) -> DataFrame:
    of = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
    return scan(table(spark, sf_dir, "documents")).select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(F.col("spans"), KINDS).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_random"))
