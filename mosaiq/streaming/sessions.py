"""State that lives across requests (I4, I6, I9, I10): generational tile caches, checkpoint caches, a change watcher."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.registry import Tables, query


@dataclass
class SlotCache:
    """I4: slots of tiles by generation: reused, changed or inserted; what a generation doesn't name goes, and its slots are given out again, the last freed first."""

    slots: dict[str, tuple[int, int]] = field(default_factory=dict)
    free: list[int] = field(default_factory=list)
    next_slot: int = 0

    def plan(self, tiles: list[tuple[str, int]]) -> list[tuple[str, int, str]]:
        """(tile, slot, action) for the tiles of a generation with their hashes; the first of equal tiles counts."""
        out, seen = [], set()
        for tile, hash_ in tiles:
            if tile in seen:
                continue
            seen.add(tile)
            if tile in self.slots:
                slot, was = self.slots[tile]
                action = "reuse" if was == hash_ else "changed"
            else:
                if self.free:
                    slot = self.free.pop()
                else:
                    slot, self.next_slot = self.next_slot, self.next_slot + 1
                action = "inserted"
            self.slots[tile] = (slot, hash_)
            out.append((tile, slot, action))
        for tile in sorted(set(self.slots) - seen):
            self.free.append(self.slots.pop(tile)[0])
        return out


@dataclass
class CheckpointCache:
    """Few entries under a budget; the lowest priority goes first, of equals the one used longest ago; a newcomer of lower priority is refused."""

    most: int = 2
    budget: int = 512 << 20
    entries: OrderedDict = field(default_factory=OrderedDict)  # key: (priority, bytes)

    def get(self, key: str) -> bool:
        if key not in self.entries:
            return False
        self.entries.move_to_end(key)
        return True

    def store(self, key: str, priority: int, size: int) -> bool:
        if size > self.budget or not self.most:
            return False
        self.entries.pop(key, None)
        while sum(b for _, b in self.entries.values()) + size > self.budget or len(self.entries) >= self.most:
            lowest = min(self.entries, key=lambda k: self.entries[k][0])
            if self.entries[lowest][0] > priority:
                return False
            del self.entries[lowest]
        self.entries[key] = (priority, size)
        return True


@query("i4_slot_cache")
def i4(t: Tables) -> DataFrame:
    """I4 over days as generations and event types as tiles, for each user; slots depend on order, so SQL can't tell them."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        cache, out = SlotCache(), []
        for day, rows in group.sort_values(["day", "event_id"]).groupby("day"):
            plan = cache.plan(list(zip(rows["event_type"], rows["event_id"] % 3, strict=True)))
            out += [(group["user_id"].iloc[0], day, *p) for p in plan]
        return pd.DataFrame(out, columns=["user_id", "day", "tile", "slot", "action"])

    days = t["events"].select("user_id", "event_id", "event_type", F.to_date("ts").cast("string").alias("day"))
    return days.groupBy("user_id").applyInPandas(run, "user_id bigint, day string, tile string, slot bigint, action string")


@query(
    "i4_generation_actions",
    """WITH g AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS tile, arg_min(event_id % 3, event_id) AS hash FROM events GROUP BY ALL),
d AS (SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY day) AS k FROM (SELECT DISTINCT user_id, day FROM g))
SELECT a.user_id, a.day, a.tile, CASE WHEN b.tile IS NULL THEN 'inserted' WHEN a.hash = b.hash THEN 'reuse' ELSE 'changed' END AS action
FROM g a JOIN d ON a.user_id = d.user_id AND a.day = d.day LEFT JOIN d p ON p.user_id = d.user_id AND p.k = d.k - 1 LEFT JOIN g b ON b.user_id = p.user_id AND b.day = p.day AND b.tile = a.tile""",
)
def i4_actions(t: Tables) -> DataFrame:
    """The actions alone need only the generation before: a join, no state."""
    from pyspark.sql import Window

    e = t["events"].withColumn("day", F.to_date("ts").cast("string"))
    g = e.groupBy("user_id", "day", F.col("event_type").alias("tile")).agg(F.min_by(F.col("event_id") % 3, "event_id").alias("hash"))
    days = g.select("user_id", "day").distinct().withColumn("prev", F.lag("day").over(Window.partitionBy("user_id").orderBy("day")))
    now = g.join(days, ["user_id", "day"])
    was = g.select("user_id", F.col("day").alias("prev"), "tile", F.col("hash").alias("was"))
    action = F.when(F.col("was").isNull(), "inserted").when(F.col("hash") == F.col("was"), "reuse").otherwise("changed")
    return now.join(was, ["user_id", "prev", "tile"], "left").select("user_id", "day", "tile", action.alias("action"))


def watch_changes(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """I9 (extension): changes of a file stream of (path, hash, ts), each once; state is dropped behind the watermark."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["path", "hash"])


def windowed_counts(stream: DataFrame, delay: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Extension: counts by event type in tumbling windows; late rows behind the watermark are dropped."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"))


def answer_requests(batches: Iterator[list[dict]], cache: CheckpointCache) -> Iterator[dict]:
    """Requests in, statuses out, with the cache kept between them."""
    for batch in batches:
        for r in batch:
            hit = cache.get(r["key"])
            yield {"key": r["key"], "hit": hit, "stored": False if hit else cache.store(r["key"], r["priority"], r["bytes"])}
