"""Splits that keep related records together, balanced by largest differencing.

Records that share a key are one component (core operator, distributed). Component sizes are the weights: in shards
of a bounded number of weights, the two partial solutions of the largest spread are combined again and again, large
bins against small ones (multiway Karmarkar-Karp), into `bins` nearly equal bins. The bins are then the weights of
the next level, until one shard is left, whose bins go whole to the split that lacks most of its target. No task
holds more than `shard` weights and nothing about components reaches the driver but their number.

Defined cases: null ids take no part, a repeated id counts once, a null or blank key ties nothing, a record without
keys is a component of its own, an empty table gives an empty result. A component larger than a split's target still
goes to one split; the report shows the shares reached. Equal weights are ordered by name, so a run can be repeated.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatework.operators.graph import connected_components
from slatework.runtime import need, settled, ship


def components(records: DataFrame, record_id: str, keys: dict[str, Column]) -> DataFrame:
    """(id, group_id): records tied through any of the keys, also through others; group_id is the smallest id."""
    need(records, record_id)
    own = records.select(F.col(record_id).cast("string").alias("id"), *[c.cast("string").alias(f"_key_{k}") for k,
        c in keys.items()]).filter("id is not null").distinct()
    own = settled(own)
    ties = None
    for k in keys:
        part = own.select(F.struct(F.lit(k).alias("kind"), F.col(f"_key_{k}").alias("key")).alias("key"), "id").filter("key.key is not null")
        ties = part if ties is None else ties.unionByName(part)
    low = ties.groupBy("key").agg(F.min("id").alias("low"))
    edges = ties.join(low, "key").select(F.col("id").alias("u"), F.col("low").alias("v"))
    return own.select("id").distinct().join(connected_components(edges).withColumnRenamed("node", "id"), "id", "left").select("id",
        F.coalesce("component", "id").alias("group_id"))


def largest_difference(weights: list[int], bins: int) -> list[int]:
    """The bin of each weight, by multiway differencing."""
    heap = []
    for n, w in enumerate(weights):
        sums = [w] + [0] * (bins - 1)
        heap.append((-w, n, sums, [[n]] + [None] * (bins - 1)))
    heapq.heapify(heap)
    count = len(weights)
    while len(heap) > 1:
        _, _, s1, m1 = heapq.heappop(heap)
        _, _, s2, m2 = heapq.heappop(heap)
        joined = []
        for a, x, b, y in zip(s1, m1, reversed(s2), reversed(m2)):
            if x and y:
                x, y = (x, y) if len(x) >= len(y) else (y, x)
                x.extend(y)
            joined.append((a + b, x or y))
        joined.sort(key=lambda t: -t[0])
        low = joined[-1][0]
        count += 1
        heapq.heappush(heap, (low - joined[0][0], count, [s - low for s, _ in joined], [m for _, m in joined]))
    out = [0] * len(weights)
    for b, m in enumerate(heap[0][3] if heap else []):
        for n in m or ():
            out[n] = b
    return out


def assign_splits(groups: DataFrame, shares: dict[str, float], *, bins: int = 200, shard: int = 20_000, seed: int = 0) -> DataFrame:
    """(id, group_id, split) of the rows of groups (id, group_id); shares are the targets and sum to 1."""
    if not shares or min(shares.values()) < 0 or abs(sum(shares.values()) - 1) > 1e-6:
        raise ValueError("shares must be at least 0 and sum to 1")
    if shard <= bins:
        raise ValueError("a shard must hold more weights than there are bins")
    ship(groups.sparkSession)
    level = settled(groups.groupBy(F.col("group_id").alias("item")).agg(F.count("*").alias("w")))
    steps: list[DataFrame] = []

    def bin_of(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["w", "item"], ascending=[False, True])
        got = largest_difference([int(w) for w in pdf["w"]], bins)
        return pd.DataFrame({"item": pdf["item"].to_numpy(), "w": pdf["w"].to_numpy(), "up": [f"{s}.{b}" for s, b in zip(pdf["s"], got)]})

    while (n := level.count()) > shard:
        parts = -(-2 * n // shard)  # half full on average, so that chance makes no shard much larger
        binned = level.withColumn("s", F.pmod(F.xxhash64("item", F.lit(seed)), F.lit(parts))).groupBy("s").applyInPandas(bin_of,
            "item string, w bigint, up string")
        steps.append(settled(binned.withColumn("up", F.concat(F.lit(f"{len(steps)}:"), "up"))))
        level = settled(steps[-1].groupBy(F.col("up").alias("item")).agg(F.sum("w").alias("w")))

    names = sorted(shares)

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["w", "item"], ascending=[False, True])
        weights = [int(w) for w in pdf["w"]]
        got = largest_difference(weights, bins)
        sums: dict[int, int] = {}
        for b, w in zip(got, weights):
            sums[b] = sums.get(b, 0) + w
        lacks = {k: shares[k] * sum(weights) for k in names}
        home = {}
        for b in sorted(sums, key=lambda b: (-sums[b], b)):
            home[b] = max(names, key=lambda k: (lacks[k], shares[k]))
            lacks[home[b]] -= sums[b]
        return pd.DataFrame({"item": pdf["item"].to_numpy(), "split": [home[b] for b in got]})

    placed = level.groupBy(F.lit(0).alias("one")).applyInPandas(place, "item string, split string")
    for step in reversed(steps):
        placed = step.select("item", "up").join(placed.withColumnRenamed("item", "up"), "up").select("item", "split")
    return groups.join(placed.withColumnRenamed("item", "group_id"), "group_id").select("id", "group_id", "split")
