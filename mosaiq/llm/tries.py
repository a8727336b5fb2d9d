"""The prefix trie of conversations: digest-keyed parent edges, rolled up by pointer jumping.

1. Turns are numbered by a sort over ranges, so a conversation may span many
   tasks: places within a task and conversation, and offsets from the sizes of
   the parts before. Texts stay behind; a digest and a number of words go on.
2. A prefix is the exclusive or of the digests of its turns and their places,
   which parts of a conversation sum up apart from each other. Equal prefixes
   are one node, and its parent's digest follows from its own.
3. Each node points to an ancestor, first its parent. In each round the sums
   of all that point to a node are added to its own, and pointers double.
   After as many rounds as the depth has bits each node has the sum of its
   subtree; only nodes of at least that depth take part in a round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.llm.lineage import cut

#: What stands between words: a blank, and the characters from tab to carriage return.
WORDS = r"[^\x20\x09-\x0D]+"
#: Ids that are joined to one text before they are hashed.
CHUNK = 50_000
NODE = ["x", "y"]


def number_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, part, place, a, b, words) of turns(conv_id, turn, role, text): places from 1 on, by turn, null first.

    conv_id is read as a whole number, and rows where it isn't one are left
    out. Equal turns of a conversation are ordered by the digests (a, b) of
    role and text. part is a share of the conversation's turns, in order.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    sha = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    rows = turns.select(F.col("conv_id").try_cast("bigint").alias("conv_id"), "turn", sha.alias("sha"), F.regexp_count(text, F.lit(WORDS)).cast("bigint").alias("words")).filter("conv_id is not null")
    rows = rows.select("conv_id", "turn", F.xxhash64("sha").alias("a"), F.xxhash64(F.lit(1), "sha").alias("b"), "words", F.monotonically_increasing_id().alias("nth"))
    order = [F.asc_nulls_first("turn"), F.col("a"), F.col("b"), F.col("nth")]
    parts = cut(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))).join(sizes.select("conv_id", "part", before.alias("before")), ["conv_id", "part"])
    return placed.select("conv_id", "part", (F.col("k") + F.col("before")).alias("place"), "a", "b", "words")


def share_heads(placed: DataFrame, every: int = 20, kinds: int = 4) -> tuple[DataFrame, DataFrame]:
    """(numbered turns, conv_id of all conversations) after each conversation's first turns are taken from another one.

    Conversation c loses its first h turns and begins with the first h of
    conversation c - c % every instead (all if it has fewer, none if there is
    no such conversation), where h is the unsigned crc32 of c in decimals
    modulo kinds. % has the sign of c.
    """
    head = (F.crc32(F.col("conv_id").cast("string")) % kinds).cast("bigint")
    parts = placed.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    convs = parts.groupBy("conv_id").agg(F.sum("n").alias("n")).select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % every).alias("donor"), head.alias("h"))
    lengths = convs.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("donor"), F.col("n").alias("held"))
    convs = convs.join(lengths, "donor", "left").select("conv_id", "donor", "h", F.least("h", F.coalesce("held", F.lit(0))).alias("taken"))
    heads = placed.filter((F.col("conv_id") % every == 0) & (F.col("place") < kinds)).select(F.col("conv_id").alias("donor"), "place", "a", "b", "words")
    taken = convs.filter("taken > 0").join(heads, "donor").filter("place <= h").select("conv_id", F.lit(-1).alias("part"), "place", "a", "b", "words")
    own = placed.filter(F.col("place") > head).join(parts.select("conv_id", "part").join(convs, "conv_id"), ["conv_id", "part"])
    return own.select("conv_id", "part", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "a", "b", "words").union(taken), convs.select("conv_id")


def ends_digest(ends: DataFrame) -> DataFrame:
    """(x, y, ends_sha256) of ends(x, y, conv_id): SHA-256 of each node's ids in decimals, in order, joined by commas.

    Ids are sorted over ranges and joined in chunks by many tasks, so that one
    hashes a node's few chunks as they come and holds none of its ids.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, node, ids = TaskContext.get().partitionId(), 0, None, []

        def send() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"x": node[0], "y": node[1], "part": task, "seq": seq, "ids": ",".join(ids)}], pa.schema([("x", pa.int64()), ("y", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("ids", pa.string())]))

        for batch in batches:
            out = []
            for x, y, c in zip(*(batch.column(k).to_pylist() for k in ("x", "y", "conv_id"))):  # noqa: B905
                if (x, y) != node or len(ids) >= CHUNK:
                    if ids:
                        out.append(send())
                    node, ids, seq = (x, y), [], seq + 1
                ids.append(str(c))
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if ids:
            yield send()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        row = lambda: {"x": node[0], "y": node[1], "ends_sha256": sha.hexdigest()}
        schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("ends_sha256", pa.string())])
        for batch in batches:
            out = []
            for x, y, ids in zip(*(batch.column(k).to_pylist() for k in ("x", "y", "ids"))):  # noqa: B905
                if (x, y) != node:
                    if node:
                        out.append(row())
                    node, sha = (x, y), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist(out, schema)
        if node:
            yield pa.RecordBatch.from_pylist([row()], schema)

    sorted_ids = ends.repartitionByRange("x", "y", "conv_id").sortWithinPartitions("x", "y", "conv_id")
    joined = sorted_ids.mapInArrow(chunks, "x bigint, y bigint, part int, seq bigint, ids string")
    return joined.repartition("x", "y").sortWithinPartitions("x", "y", "part", "seq").mapInArrow(digests, "x bigint, y bigint, ends_sha256 string")


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(x, y, values) of nodes(x, y, px, py, depth, values): the sums over each node's subtree, itself included.

    px, py is the parent; nodes of depth 0 have none. The number of rounds is
    that of the bits of the depth.
    """
    held = [*NODE, "depth", *values]
    active = nodes.filter("depth > 0").select(*held, F.col("px").alias("jx"), F.col("py").alias("jy"))
    found, step = [nodes.select(*NODE, *values)], 1
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    while step <= deepest:
        # what points to a node lies step below it, and has the sums of what lies up to step below itself
        got = cut(active.groupBy(F.col("jx").alias("x"), F.col("jy").alias("y")).agg(*(F.sum(v).alias(v) for v in values)))
        found.append(got)
        if 2 * step <= deepest:
            more = got.select(*NODE, *(F.col(v).alias(f"{v}_more") for v in values))
            deep = active.filter(F.col("depth") >= 2 * step).join(more, NODE, "left").select(*NODE, "depth", *((F.col(v) + F.coalesce(f"{v}_more", F.lit(0))).alias(v) for v in values), "jx", "jy")
            onward = active.select(F.col("x").alias("jx"), F.col("y").alias("jy"), F.col("jx").alias("kx"), F.col("jy").alias("ky"))
            active = cut(deep.join(onward, ["jx", "jy"]).select(*held, F.col("kx").alias("jx"), F.col("ky").alias("jy")))
        step *= 2
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return every.groupBy(*NODE).agg(*(F.sum(v).alias(v) for v in values))


def trie(placed: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of numbered turns(conv_id, part, place, a, b, words); convs(conv_id) has all conversations, each once."""
    placed = placed.select("conv_id", "part", "place", "words", F.xxhash64("place", "a", "b").alias("tx"), F.xxhash64(F.lit(1), "b", "a", "place").alias("ty"))
    parts = placed.groupBy("conv_id", "part").agg(F.bit_xor("tx").alias("sx"), F.bit_xor("ty").alias("sy"), F.count(F.lit(1)).alias("n"))
    whole, before = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "part", *(F.coalesce(F.bit_xor(s).over(before), F.lit(0)).alias(s) for s in ("sx", "sy")), F.sum("n").over(whole).alias("length"))
    run = Window.partitionBy("conv_id", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    own = placed.select("*", F.bit_xor("tx").over(run).alias("rx"), F.bit_xor("ty").over(run).alias("ry"))
    x, y = F.col("rx").bitwiseXOR(F.col("sx")), F.col("ry").bitwiseXOR(F.col("sy"))
    steps = cut(own.join(parts, ["conv_id", "part"]).select("conv_id", F.col("place").alias("depth"), "words", x.alias("x"), y.alias("y"), x.bitwiseXOR(F.col("tx")).alias("px"), y.bitwiseXOR(F.col("ty")).alias("py"), (F.col("place") == F.col("length")).alias("last")))

    total = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = total.select(F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"), F.lit(None).cast("bigint").alias("px"), F.lit(None).cast("bigint").alias("py"), F.lit(0).cast("bigint").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("bigint").alias("saved"))
    found = steps.groupBy(*NODE).agg(F.min("px").alias("px"), F.min("py").alias("py"), F.min("depth").cast("bigint").alias("depth"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"))
    bare = cut(found.select(*NODE, "px", "py", "depth", "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("saved")).union(root))
    kids = bare.filter("depth > 0").groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut(bare.join(kids, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("leaves", (F.col("n_children") == 0).cast("bigint")))

    sums = subtree_sums(nodes, ["leaves", "saved"]).withColumnsRenamed({"leaves": "n_leaves", "saved": "saved_tokens"})
    turnless = convs.join(steps.filter("depth = 1").select("conv_id"), "conv_id", "left_anti").select(F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"), "conv_id")
    ends = ends_digest(steps.filter("last").select(*NODE, "conv_id").union(turnless))
    # the root, to which most may point, needs no join
    top = nodes.filter("depth = 0").select(F.col("conv_id").alias("root_conv_id"))
    above = nodes.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    low = nodes.filter("depth > 1").join(above, ["px", "py"]).select(*NODE, "parent_conv_id")
    high = nodes.filter("depth = 1").crossJoin(F.broadcast(top)).select(*NODE, F.col("root_conv_id").alias("parent_conv_id"))
    done = nodes.join(sums, NODE).join(ends, NODE, "left").join(low.union(high), NODE, "left")
    empty = hashlib.sha256().hexdigest()
    return done.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations of turns(conv_id, turn, role, text), the empty one included.

    conv_id is the smallest of those that begin with the prefix, depth its
    turns, parent_conv_id the parent's conv_id (null for the root), n_convs
    how many begin with it, n_children its children, n_leaves the childless
    nodes of its subtree, saved_tokens the words of repeated turns in it
    (each node's n_convs - 1 times the words of its last text), and
    ends_sha256 the digest of the ids of those that end with it.

    Null roles and texts count as empty ones, null turns come first, equal
    turns are ordered by a digest of role and text, rows whose conv_id isn't a
    whole number are left out, and so are other columns. Without conversations
    there are no nodes.
    """
    placed = cut(number_turns(turns))
    return trie(placed, placed.select("conv_id").distinct())


def shared_trie(turns: DataFrame) -> DataFrame:
    """The same after share_heads has rebuilt the conversations."""
    placed, convs = share_heads(cut(number_turns(turns)))
    return trie(placed, cut(convs))


def trie_sql() -> str:
    """SQL of shared_trie over the table conversations; crc32 is worked out bit by bit."""
    step = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda c, b: {step}), 4294967295)"
    key = "md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))"
    return f"""
WITH placed AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {key}) AS place FROM conversations WHERE conv_id IS NOT NULL),
heads AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS donor, {crc} % 4 AS h FROM placed),
taken AS (SELECT h.conv_id, place, role, text FROM heads h JOIN placed p ON p.conv_id = h.donor AND place <= h),
sized AS (SELECT h.conv_id, h.h, count(t.place) AS k FROM heads h LEFT JOIN taken t ON t.conv_id = h.conv_id GROUP BY ALL),
rebuilt AS (SELECT * FROM taken UNION ALL SELECT p.conv_id, place - h + k, role, text FROM placed p JOIN sized s ON s.conv_id = p.conv_id WHERE place > h),
steps AS (
  SELECT conv_id, place AS depth, text, string_agg({key}, '') OVER (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS key, place = max(place) OVER (PARTITION BY conv_id) AS ends FROM rebuilt
  UNION ALL SELECT conv_id, 0, NULL, '', conv_id NOT IN (SELECT conv_id FROM rebuilt) FROM heads),
nodes AS (
  SELECT key, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(len(regexp_extract_all(min(text), '[^\\x20\\x09-\\x0D]+')), 0) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM steps GROUP BY key),
kids AS (SELECT left(key, length(key) - 32) AS key, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
full_nodes AS (SELECT n.*, coalesce(k.n, 0) AS n_children, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN kids k ON k.key = n.key LEFT JOIN nodes p ON n.depth > 0 AND p.key = left(n.key, length(n.key) - 32)),
sums AS (SELECT s.key, sum(CASE WHEN n.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(n.saved) AS saved_tokens FROM full_nodes n JOIN steps s ON s.conv_id = n.conv_id AND s.depth <= n.depth GROUP BY s.key)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256 FROM full_nodes n JOIN sums s ON s.key = n.key
"""
