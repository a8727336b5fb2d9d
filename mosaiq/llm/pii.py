"""Personal data: base patterns, and contextual patterns bootstrapped from what those find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.lineage import cut
from mosaiq.llm.spans import SPAN, count_kind, find_spans, joined, let, near_ones, with_bounds

KINDS = ["email", "ip", "card", "phone", "context"]
# The base patterns. Possessive parts and the anchors only keep a long run from being read again and again, or its repeats from nesting calls.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
BYTES = rf"^{BYTE}(?:\.{BYTE}){{3}}$"
#: A word without digits, then a token with a digit or an @ and the groups of digits that go on from it: the context and the instance of the extraction graph.
CONTEXT = r"(?<!\S)[^\s0-9]{1,60}+\x20[^\s0-9@]*+[0-9@]\S*+(?:\x20\(?[0-9]\S*+)*+"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of m pass Luhn's check."""
    d = F.reverse(digits(m))
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(d)),
        F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, d.substr(i, F.lit(1)).cast("int")).otherwise((d.substr(i, F.lit(1)).cast("int") * 2) % 10 + F.floor(d.substr(i, F.lit(1)).cast("int") / 5).cast("int")),
    )
    return total % 10 == 0


def base_spans(text: Column) -> Column:
    number = text.rlike("[0-9]")
    return F.concat(
        find_spans(text, EMAIL, 0, text.contains("@")),
        find_spans(text, IP, 1, number, lambda m: m.rlike(BYTES)),
        find_spans(text, CARD, 2, number, luhn),
        find_spans(text, PHONE, 3, text.contains("+"), lambda m: F.length(digits(m)).between(10, 15)),
    )


def instance_edges(found: DataFrame) -> DataFrame:
    """(pattern, instance, seed, n): how often a context stands before a token, added up before any join."""
    return found.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n"))


def score_patterns(edges: DataFrame, rounds: int = 2) -> DataFrame:
    """Scores by mutual reinforcement: a pattern is as sure as its instances, an instance as its patterns.

    Seeds stay at 1. Each round is two grouped sums over the edges; the number
    of rounds is fixed, so the plan doesn't grow with the data.
    """
    scored = edges.select("pattern", "instance", "seed", "n", F.col("seed").cast("double").alias("w"))
    for last in [False] * (rounds - 1) + [True]:
        by_pattern = scored.groupBy("pattern").agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("conf"), F.sum(F.when(F.col("seed") == 1, 1).otherwise(0)).alias("support"))
        if last:
            return by_pattern
        of = edges.join(by_pattern, "pattern")
        inst = of.groupBy("instance").agg(F.max("conf").alias("w"))
        scored = edges.join(inst, "instance").select("pattern", "instance", "seed", "n", F.greatest(F.col("seed").cast("double"), "w").alias("w"))
    return scored


def extract_pii(docs: DataFrame, least_conf: float = 0.6, least_support: int = 8, rounds: int = 2) -> DataFrame:
    """(doc_id, base, extra): base spans of the fixed patterns, extra spans that high-confidence contexts found.

    A context is the lower-cased word before a token with digits or an @, and
    the groups of digits that follow a token belong to it. Contexts whose
    tokens are seeds (base entities) to least_conf at least, with
    least_support different seeds, mark their other tokens too. Tokens of
    letters alone are no instances. Null and empty texts have no spans.
    Repeated rows each get the same spans.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("h"), base_spans(text).alias("base"), find_spans(text, CONTEXT, 4, text.rlike("[0-9@]")).alias("ctx"))
    first = F.substring_index("c.m", " ", 1)
    word = F.regexp_replace(F.lower(first), r"[^\p{L}@]", "")
    token = F.substring(F.col("c.m"), F.length(first) + 2, F.length("c.m"))

    def seed_of(bounded: Column, c: Column) -> Column:
        start = c["s"] + F.length(F.substring_index(c["m"], " ", 1)) + 1
        return F.get(F.filter(near_ones(bounded, start, c["e"]), lambda b: (b["s"] < c["e"]) & (b["e"] > start)), 0)["m"]

    seeded = let(with_bounds(F.col("base")), lambda bounded: F.transform("ctx", lambda c: F.struct(c.alias("c"), seed_of(bounded, c).alias("of"))))
    found = (
        rows.filter(F.size("ctx") > 0)
        .select("doc_id", "h", F.inline(seeded))
        .select("doc_id", "h", "of", (F.col("c.s") + F.length(first) + 1).alias("s"), F.col("c.e").alias("e"), word.alias("pattern"), token.alias("token"))
        .filter(F.col("pattern") != "")
        .withColumns({"instance": F.xxhash64(F.coalesce("of", "token")), "seed": F.col("of").isNotNull().cast("int")})
    )
    found = cut(found)
    good = score_patterns(instance_edges(found.select("pattern", "instance", "seed")), rounds).filter((F.col("conf") >= least_conf) & (F.col("support") >= least_support)).select("pattern")
    extra = found.filter("seed = 0").join(good, "pattern").groupBy("doc_id", "h").agg(F.collect_set(F.struct(F.col("s"), F.lit(4).alias("k"), F.col("e"), F.lit("").alias("m"))).alias("extra"))
    out = rows.drop("ctx").join(extra.select(F.col("doc_id").alias("d"), F.col("h").alias("hh"), "extra"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("hh")), "left")
    return out.select("doc_id", "base", F.coalesce("extra", F.array().cast(SPAN)).alias("extra"))


def pii_digest(docs: DataFrame) -> DataFrame:
    found = extract_pii(docs)
    return found.select(
        "doc_id",
        *(count_kind(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(4)),
        F.sha2(joined(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("base", "extra"), KINDS).alias("spans"),
    )
