"""Secret scans: base patterns, and multipart credentials linked by an interval join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.spans import SPAN, count_kind, find_spans, joined, let, near_ones, with_bounds

KINDS = ["assign", "access", "hex", "secret_part", "endpoint"]
# The base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
# Weak parts: alone they say nothing, so they count only beside a complementary part.
SECRET_PART = r"(?<![A-Za-z0-9+/=_-])(?:[A-Za-z0-9+/]{40}|[A-Za-z0-9+/]{64})(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"(?i:https?|s3|ftp|jdbc|postgres|mysql|mongodb)://[A-Za-z0-9._~:/?#@!$&'*+;=%-]{4,}+|(?i:endpoint|host|server|region|bucket)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._:/-]{4,}+"


def link_parts(strong: Column, weak: Column, window: int) -> Column:
    """Weak spans within window of any strong one that they don't overlap: an interval join inside the row.

    The strong spans lie in parts with bounds, so that a weak one is compared
    with those of the parts in its scope only.
    """
    return let(with_bounds(strong), lambda parts: F.filter(weak, lambda w: F.exists(near_ones(parts, w["s"], w["e"], window), lambda a: (a["e"] <= w["s"]) | (w["e"] <= a["s"]))))


def scan_secrets(docs: DataFrame, window: int = 400) -> DataFrame:
    """Adds spans_found (array of s, k, e, m) to docs(doc_id, text).

    Base spans: assign, access and hex. A secret_part is reported only within
    window code points of an access identifier, and an endpoint only within
    window of an access identifier or an assignment. Null and empty texts have
    no spans; repeated rows each get theirs; other columns are left out.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    long_enough = lambda m: F.length(m) >= 8
    base = docs.select(
        "doc_id",
        text.alias("text"),
        find_spans(text, ASSIGN, 0, F.lit(True), long_enough, 2).alias("assign"),
        find_spans(text, ACCESS, 1, text.contains("AKIA")).alias("access"),
        find_spans(text, HEX, 2, F.lit(True)).alias("hex"),
    )
    has = F.size("access") > 0
    none = F.array().cast(SPAN)
    weak = base.select(
        "*",
        F.when(has, find_spans(F.col("text"), SECRET_PART, 3, F.lit(True))).otherwise(none).alias("part"),
        F.when(has | (F.size("assign") > 0), find_spans(F.col("text"), ENDPOINT, 4, F.lit(True))).otherwise(none).alias("point"),
    )
    linked = weak.select(
        "doc_id", "assign", "access", "hex",
        F.when(F.size("part") > 0, link_parts(F.col("access"), F.col("part"), window)).otherwise(none).alias("part"),
        F.when(F.size("point") > 0, link_parts(F.concat("access", "assign"), F.col("point"), window)).otherwise(none).alias("point"),
    )
    return linked.select("doc_id", F.concat("assign", "access", "hex").alias("base"), F.concat("part", "point").alias("linked"))


def secret_digest(docs: DataFrame) -> DataFrame:
    found = scan_secrets(docs)
    return found.select(
        "doc_id",
        *(count_kind(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(joined(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("base", "linked"), KINDS).alias("spans"),
    )
