"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash range is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.llm.spans import let

SPACES = r"[\x20\x09-\x0D]+"


def word_hashes(text: Column) -> Column:
    """A hash of each word; words are what stands between runs of ASCII white space, lower-cased."""
    return F.transform(F.filter(F.split(F.lower(text), SPACES, -1), lambda w: w != ""), lambda w: F.xxhash64(w))


def sketch(text: Column, bits: int = 2, words: int = 5) -> Column:
    """Sorted distinct hashes of the shingles of words words, those below 2**-bits of the range.

    A text of fewer words is one shingle, which is kept whatever its hash, and
    a text with no hash below keeps its smallest one (as a signed number; that
    it isn't below marks it), so that short texts can be told apart. Only a
    text without words has an empty sketch.
    """

    def below(hashes: Column) -> Column:
        low = F.filter(hashes, lambda h: F.shiftrightunsigned(h, 64 - bits) == 0)
        return let(low, lambda k: F.when(F.size(k) > 0, F.array_sort(F.array_distinct(k))).otherwise(F.array(F.array_min(hashes))))

    def kept(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(*(w[i + j] if j else w[i] for j in range(words))))
        return (
            F.when(F.size(w) >= words, let(hashes, below) if bits else F.array_sort(F.array_distinct(hashes)))
            .when(F.size(w) > 0, F.array(F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: F.xxhash64(a, x))))
            .otherwise(F.array().cast("array<bigint>"))
        )

    return let(word_hashes(text), kept)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two sketches; two empty ones are alike."""
    both, one = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(one == 0, F.lit(1.0)).otherwise(both.cast("double") / one)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has, also for very unequal sizes; an empty a is contained."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / F.size(a))


def merge_sketches(sketches: Column) -> Column:
    """Aggregate: the sketch of a union of documents is the union of their sketches."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(sketches))))


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 16, "0")), "")


#: Cut points of doc_id that are asked for, and rows of the heads' table up to which it is broadcast.
CUTS, MOST_BROADCAST = 1024, 20_000


def with_next(rows: DataFrame, sketched: Callable[[Column], Column], rows_in_range: int = 4000) -> DataFrame:
    """Adds sk, the sketch of text, and next_text and next_sk of the row that follows by descending doc_id (after the last: the first).

    No sort of the whole table: quantiles cut doc_id into ranges, each of which
    is cut evenly into as many parts as the table needs for parts of about
    rows_in_range, and the parts are sorted one by one. The last row of a part
    takes its follower from the first row of the next one. Null ids come last;
    ties go by text; rows of one id are in one part.
    """
    n, low, ids = rows.select(F.count(F.lit(1)), F.min("doc_id"), F.percentile_approx("doc_id", [i / CUTS for i in range(1, CUTS)], 20000)).first()
    cuts = sorted({low, *(ids or [])[:: max(1, round(rows_in_range * CUTS / max(n, 1)))]} - {None})
    each = max(1, round(n / max(len(cuts), 1) / rows_in_range))
    starts = F.array(*(F.lit(x).cast("bigint") for x in [*cuts, (cuts or [0])[-1] + 1]))
    nth = F.size(F.filter(starts, lambda x: x <= F.col("doc_id")))
    wide = F.greatest(F.element_at(starts, F.least(F.col("nth") + 1, F.lit(len(cuts) + 1))) - F.element_at(starts, F.greatest("nth", F.lit(1))), F.lit(1))
    share = F.least(F.floor((F.col("doc_id") - F.element_at(starts, F.greatest("nth", F.lit(1)))).cast("double") * each / wide), F.lit(each - 1))
    part = F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("nth").cast("bigint") * each + (share if each > 1 else 0))
    cut = rows.withColumn("nth", nth).withColumn("part", part.cast("bigint")).drop("nth")
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text").asc())
    led = cut.withColumn("next_text", F.lead("text").over(inside)).withColumn("sk", sketched(F.col("text"))).withColumn("next_sk", F.lead("sk").over(inside))
    # from here to heads: a row for each part; parts follow each other within a range, and then ranges do, at most CUTS + 1 of them
    firsts = cut.groupBy("part").agg(F.max("doc_id").alias("m")).select(F.col("part").alias("p"), "m", F.floor(F.col("part") / each).alias("range"))
    ranges = firsts.groupBy("range").agg(F.max("p").alias("top"))
    whole, back = Window.partitionBy(), Window.orderBy(F.col("range").desc())
    then = ranges.select(F.col("range").alias("r"), F.coalesce(F.lead("top").over(back), F.max("top").over(whole)).alias("then"))
    within = F.lead("p").over(Window.partitionBy("range").orderBy(F.col("p").desc()))
    linked = firsts.withColumn("below", within).join(then, F.col("range") == F.col("r")).select(F.col("p").alias("of"), F.coalesce("below", "then").alias("follows"))
    few = lambda df: F.broadcast(df) if len(cuts) * each < MOST_BROADCAST else df
    first_text = cut.join(few(firsts), (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("m"))).groupBy("p").agg(F.min("text").alias("head_text"))
    heads = linked.join(first_text, F.col("follows") == F.col("p")).select("of", "head_text", sketched(F.col("head_text")).alias("head_sk"))
    out = led.join(heads, F.col("part") == F.col("of"), "left")
    return out.withColumns({"next_text": F.coalesce("next_text", "head_text"), "next_sk": F.coalesce("next_sk", "head_sk")}).drop("of", "head_text", "head_sk", "part")


def fingerprint_digest(docs: DataFrame, bits: int = 2) -> DataFrame:
    """One row per document of docs(doc_id, text): its sketch, its edited text's, and their likeness.

    Null texts count as empty. A single document follows itself. An empty
    table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").try_cast("bigint").alias("doc_id").alias("doc_id"), text.alias("text"))
    full = with_next(rows, lambda t: sketch(t, bits))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = full.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    both = edited.withColumn("edited_sk", sketch(F.col("edited"), bits))
    return both.select(
        "doc_id",
        n.cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sk")).alias("fingerprint"),
        as_text(F.col("edited_sk")).alias("edited_fingerprint"),
        likeness(F.col("sk"), F.col("edited_sk")).alias("near_edited"),
        likeness(F.col("sk"), F.col("next_sk")).alias("near_next"),
    )
