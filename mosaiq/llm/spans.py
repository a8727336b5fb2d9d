"""Regular-expression spans as native columns: positions in code points, no Python on the executors.

Spark returns what a pattern matched but not where. The text split by the
pattern gives the gaps, so the running sum of gap and match lengths gives the
positions of the same leftmost non-overlapping matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<s:bigint,k:int,e:bigint,m:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates value once and uses it in body."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Matches that are added up one by one, each copying the list so far; more are added up in parts of so many.
PART = 128


def parts(values: Column, size: int = PART) -> Column:
    """values cut into arrays of size, the last one shorter; one empty one for none.

    values must be a column or a variable of let: what else stands here is
    evaluated again for each part.
    """
    last = F.greatest(F.floor((F.size(values) - 1) / size), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * size + 1, F.lit(size)))


def find_spans(text: Column, pattern: str, kind: int, gate: Column, keep: Callable[[Column], Column] | None = None, group: int = 0) -> Column:
    """Matches of pattern as (s, k, e, m), m being the group; empty where gate doesn't hold.

    keep filters on m. Null and empty texts have no spans. The work grows in
    proportion to the matches: their lengths are summed part by part.
    """
    found = F.arrays_zip(
        F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))), lambda g: F.length(g).cast("bigint")).alias("g"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("w"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("m"),
    )
    zero = F.lit(0).cast("bigint")

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        e = s + F.length(x["w"]).cast("bigint")
        one = F.array(F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e"), x["m"].alias("m")))
        return F.struct(e.alias("at"), F.when(keep(x["m"]), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out") if keep else F.concat(acc["out"], one).alias("out"))

    def of_part(part: Column, at: Column) -> Column:
        return F.aggregate(part, F.struct(at.alias("at"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])

    def of_all(cut: Column) -> Column:
        sums = F.transform(cut, lambda part: F.aggregate(part, zero, lambda acc, x: acc + x["g"] + F.length(x["w"])))
        starts = F.aggregate(sums, F.array(zero), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return let(starts, lambda at: F.flatten(F.transform(F.arrays_zip(cut.alias("part"), F.slice(at, F.lit(1), F.size(cut)).alias("at")), lambda x: of_part(x["part"], x["at"]))))

    return F.when(gate & text.rlike(pattern), let(found, lambda whole: let(parts(whole), of_all))).otherwise(F.array().cast(SPAN))


def with_bounds(spans: Column) -> Column:
    """spans in parts by start, with the least start and greatest end of each, to be searched by near_ones."""
    return F.transform(let(F.array_sort(spans), lambda x: parts(x)), lambda part: F.struct(F.array_min(F.transform(part, lambda x: x["s"])).alias("s"), F.array_max(F.transform(part, lambda x: x["e"])).alias("e"), part.alias("of")))


def near_ones(bounded: Column, start: Column, end: Column, window: int = 0) -> Column:
    """The spans of with_bounds that are at most window away from start to end; parts that are farther away are skipped."""
    near = lambda x: (x["s"] - F.lit(window) <= end) & (x["e"] + F.lit(window) >= start)
    return F.flatten(F.transform(F.filter(bounded, near), lambda part: F.filter(part["of"], near)))


def joined(spans: Column, names: list[str]) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    kinds = F.array(*map(F.lit, names))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["k"] == kind)).cast("bigint")
