"""Personal data in texts: fixed patterns, and contexts learned from what these find.

Bootstrapped extraction. The fixed patterns' matches are seeds. The words
around a seed make lexical patterns (two words before; one before and one
after). The same contexts are taken of every other token that has five digits or
an at sign, and of every maximal run of digit groups with spaces in it: an
identifier may be written in groups. A candidate has 6 to 64 characters, and a
run is none if a seed overlaps it; marked places that overlap become one.

Patterns and instances form a graph. In each round a pattern is live if
instances of `least_seeds` confidence support it; its confidence for a kind is
the share of its occurrences that are instances of the kind, weighted by their
confidence, and an unseen instance has that of its best live pattern. Unseen
instances that reach `least_confidence` support patterns in the next round, so
what was found induces patterns that no seed has, until a round makes no further
pattern confident, or for `rounds` rounds. Common contexts stand beside all
kinds, so they are confident for none.

Everything is built-in functions; joins with patterns deal hot patterns out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlattice.llm._common import attach_groups, cut, table
from rowlattice.llm._spans import clear_of, found, joined, let, placed

KINDS = ["email", "ip", "card", "phone"]
NAMES = [*KINDS, *(f"like_{k}" for k in KINDS)]
#: The contract's patterns, written so that a failing start is left at once and long matches need no stack.
PATTERNS = [
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9]++(?:[\x20-][0-9]++)*+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
WS = r"\x20\x09-\x0D"
TOKEN = rf"(?<![^{WS}])[^{WS}0-9@]*+[0-9@][^{WS}]*+"

#: Groups of digits with the separators of the card and phone patterns between them.
GROUPS = r"(?<![A-Za-z0-9])[+(]{0,2}+[0-9]++(?:[\x20().-]++[0-9]++)++"
#: Contexts are taken from pieces of so many characters: words are seen within so far, and longer ones are known by their nearest part.
BLOCK = 256
#: Lengths of a candidate and the digits of one without an at sign.
SHORTEST, LONGEST, DIGITS = 6, 64, 5


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    d = F.transform(F.split(F.reverse(_digits(m)), ""), lambda c: F.ascii(c) - 48)
    total = F.aggregate(F.transform(d, lambda v, i: F.when(i % 2 == 1, F.when(v * 2 > 9, v * 2 - 9).otherwise(v * 2)).otherwise(v)), F.lit(0), lambda a, v: a + v)
    return total % 10 == 0


def _small_parts(m: Column) -> Column:
    short = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(m, r"\."), lambda p: (F.length(short(p)) < 3) | ((F.length(short(p)) == 3) & (short(p) <= "255")))


HOLDS = [
    lambda m: F.lit(True),
    _small_parts,
    lambda m: F.when(F.length(_digits(m)).between(13, 19), _luhn(m)).otherwise(F.lit(False)),
    lambda m: F.length(_digits(m)).between(9, 15),
]


def contexts(before: Column, after: Column) -> Column:
    """The lexical patterns of a place: its last two words before, and its last one before with its first one after."""
    back, head = F.reverse(F.lower(before)), F.lower(after)  # from the place on, so that no search tries other starts
    one = F.reverse(F.regexp_extract(back, rf"^[{WS}\"'(]*+([^{WS}]++)", 1))
    two = F.reverse(F.regexp_extract(back, rf"^[{WS}\"'(]*+([^{WS}]++[{WS}]++[^{WS}]++)", 1))
    right = F.regexp_extract(head, rf"^[^{WS}]*+[{WS}]*+([^{WS}]++)", 1)
    made = F.array(F.when(F.length(two) > 0, F.concat(F.lit("L2 "), F.regexp_replace(two, rf"[{WS}]+", " "))), F.when((F.length(one) > 0) & (F.length(right) > 0), F.concat(F.lit("LR "), one, F.lit(" _ "), right)))
    return F.filter(made, lambda p: p.isNotNull())


def _contexts_at(start: Column, end: Column) -> Column:
    """contexts() of a place in the text whose pieces of BLOCK characters are the column blocks."""
    piece = lambda at, step: F.coalesce(F.get("blocks", (F.floor(at / BLOCK) + step).cast("int")), F.lit(""))
    inside = lambda at: (at % BLOCK).cast("int")
    before = F.concat(piece(start, -1), F.substring(piece(start, 0), F.lit(1), inside(start)))
    after = F.concat(F.substring(piece(end, 0), inside(end) + 1, F.lit(BLOCK)), piece(end, 1))
    return contexts(before, after)


def scored_patterns(edges: DataFrame, rounds: int, least_seeds: float, least_confidence: float) -> DataFrame:
    """pattern, n_edges, p0 .. p3: the live patterns' confidence for each kind, from edges (pattern, inst, k: -1 if unseen, n: count)."""
    n_edges = edges.count()
    unit = [F.when(F.col("k") == j, F.lit(1.0)).otherwise(F.lit(0.0)) for j in range(4)]
    scored = edges.withColumns({f"c{j}": unit[j] for j in range(4)})
    best = F.greatest(*[F.col(f"p{j}") for j in range(4)])
    confident = -1
    for step in range(rounds):
        support = F.sum(F.greatest(*[F.col(f"c{j}") for j in range(4)]))
        made = scored.groupBy("pattern").agg(F.count("*").alias("n_edges"), F.sum("n").alias("total"), support.alias("support"), *[F.sum(F.col("n") * F.col(f"c{j}")).alias(f"s{j}") for j in range(4)])
        patterns = cut(made.filter(F.col("support") >= least_seeds).select("pattern", "n_edges", *[(F.col(f"s{j}") / (F.col("total") + 2)).alias(f"p{j}") for j in range(4)]))
        now = patterns.filter(best >= least_confidence).count()
        if step + 1 == rounds or now <= confident:
            break
        confident = now
        live = patterns.filter(best >= least_confidence)
        reached = attach_groups(edges.filter("k < 0"), live, ["pattern"], "n_edges", n_edges, "inst").filter("p0 IS NOT NULL")
        unseen = cut(reached.groupBy("inst").agg(F.count("*").alias("n_pats"), *[F.max(f"p{j}").alias(f"q{j}") for j in range(4)]))
        scored = attach_groups(edges, unseen, ["inst"], "n_pats", n_edges, "pattern").select("pattern", "inst", "k", "n", *[F.coalesce(F.when(F.col("k") < 0, F.col(f"q{j}")), unit[j]).alias(f"c{j}") for j in range(4)])
    return patterns


def scan(docs: DataFrame, rounds: int = 5, least_seeds: int = 8, least_confidence: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans (arrays of struct<start, end, k>, k an index of NAMES) for each row of docs.

    base has the fixed patterns' matches by kind, then start; spans has these
    and the unseen identifiers that overlap none of them. Of equally confident
    kinds the first of KINDS counts, of equally confident patterns the last
    kind. A null text is an empty one and has none. Repeated rows have equal
    results. Other columns are not read, so their names may clash. An empty
    table gives an empty table. A text, its matches and what is between them are
    in memory at once, and work follows its length.
    """
    text = F.col("text")
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumns({f"m{k}": found(text, p) for k, p in enumerate(PATTERNS)} | {"t": found(text, TOKEN), "g": found(text, GROUPS)})

    def seeds(k: int) -> Column:
        good = F.filter(placed(text, F.col(f"m{k}"), PATTERNS[k]), lambda s: HOLDS[k](s["m"]))
        some = F.exists(f"m{k}", lambda m: HOLDS[k](m))  # most texts have none, and needn't be split
        full = F.transform(good, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("k"), s["m"].alias("m"), _contexts_at(s["start"], s["end"]).alias("pats")))
        return F.when(some, full).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,k:int,m:string,pats:array<string>>>"))

    like = lambda m: (F.length(m).between(SHORTEST, LONGEST)) & ((F.length(_digits(m)) >= DIGITS) | F.contains(m, F.lit("@")))

    def token(s) -> Column:
        lead = F.length(F.regexp_extract(s["m"], r"^[\"'(\[<]*", 0))
        trail = F.length(F.regexp_extract(s["m"], r"[\"')\]>.,;:!?]*$", 0))
        return F.struct((s["start"] + lead).alias("start"), (s["end"] - trail).alias("end"), F.lit(-1).alias("k"), F.lower(s["m"]).alias("m"), _contexts_at(s["start"], s["end"]).alias("pats"))

    def group(s) -> Column:
        lead = F.length(F.regexp_extract(s["m"], r"^\((?=[^)]*$)", 0))  # a parenthesis that the run doesn't close
        return F.struct((s["start"] + lead).alias("start"), s["end"].alias("end"), F.lit(-1).alias("k"), s["m"].alias("m"), _contexts_at(s["start"], s["end"]).alias("pats"))

    spaced = lambda m: like(m) & F.contains(m, F.lit(" "))

    def clear(all_: Column) -> Column:
        names = [f"b{k}" for k in range(len(PATTERNS))]
        return let(F.struct(*names), lambda b: F.filter(all_, lambda s: clear_of(s, b["b0"]) & clear_of(s, b["b1"]) & clear_of(s, b["b2"]) & clear_of(s, b["b3"])))

    none = F.array().cast("array<struct<start:bigint,end:bigint,k:int,m:string,pats:array<string>>>")
    tokens = F.when(F.exists("t", like), F.transform(F.filter(placed(text, F.col("t"), TOKEN), lambda s: like(s["m"])), token)).otherwise(none)
    groups = F.when(F.exists("g", spaced), F.transform(F.filter(placed(text, F.col("g"), GROUPS), lambda s: spaced(s["m"])), group)).otherwise(none)
    some = F.exists("t", like) | F.exists("g", spaced)
    for k in range(len(PATTERNS)):
        some = some | F.exists(f"m{k}", HOLDS[k])
    df = df.withColumn("blocks", F.when(some, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))
    seen = df.withColumns({f"b{k}": seeds(k) for k in range(4)}).withColumn("base", F.concat(*[f"b{k}" for k in range(4)])).withColumn("tokens", clear(F.concat(tokens, groups)))
    seen = cut(seen.select("doc_id", F.xxhash64("text").alias("text_key"), "base", "tokens"))

    # occurrences -> edges of the graph: pattern, instance, kind (-1: unseen), count
    occ = seen.select("doc_id", "text_key", F.explode(F.concat("base", "tokens")).alias("x")).select("doc_id", "text_key", "x.*")
    edges = occ.select(F.explode("pats").alias("pattern"), F.xxhash64("k", "m").alias("inst"), "k").groupBy("pattern", "inst", "k").agg(F.count("*").alias("n"))
    edges = cut(edges)
    patterns = scored_patterns(edges, rounds, least_seeds, least_confidence)
    best = F.greatest(*[F.col(f"p{j}") for j in range(4)])
    kind = F.coalesce(*[F.when(F.col(f"p{j}") == best, F.lit(4 + j)) for j in range(4)])
    sure = cut(patterns.filter(best >= least_confidence).select("pattern", "n_edges", best.alias("confidence"), kind.alias("kind")))
    n_edges = edges.count()
    places = occ.filter("k < 0").select("doc_id", "text_key", "start", "end", F.explode("pats").alias("pattern"))
    marked = attach_groups(places, sure, ["pattern"], "n_edges", max(n_edges, 1), "start").filter("confidence IS NOT NULL")
    new = marked.groupBy("doc_id", "text_key", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("k"))
    new = new.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("k", "start", "end")).alias("new")).select(F.col("doc_id").alias("d"), F.col("text_key").alias("tk"), "new")
    both = seen.drop("tokens").join(new, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("tk")), "left")
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["k"].alias("k")))
    spans = "array<struct<start:bigint,end:bigint,k:int>>"
    ordered = F.array_sort(F.coalesce(F.transform("new", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["k"].alias("k"))), F.array().cast(spans)))

    def merged(done, s):
        last = F.try_element_at(done, F.lit(-1))
        both = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), F.when(s["end"] - s["start"] > last["end"] - last["start"], s["k"]).otherwise(last["k"]).alias("k"))
        return F.when(last["end"] > s["start"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(both))).otherwise(F.concat(done, F.array(s))).cast(spans)

    whole = F.transform(F.aggregate(ordered, F.array().cast(spans), merged), lambda s: F.struct(s["k"].alias("k"), s["start"].alias("start"), s["end"].alias("end")))
    added = F.transform(F.array_sort(whole), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["k"].alias("k")))
    return both.select("doc_id", plain.alias("base"), F.concat(plain, added).alias("spans"))


def op6(spark, sf_dir: str) -> DataFrame:
    of = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return scan(table(spark, sf_dir, "documents")).select("doc_id", *map(of, range(4)), F.sha2(joined(F.col("base"), NAMES), 256).alias("base_sha256"), joined(F.col("spans"), NAMES).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_found"))
