"""Mixing sources to target weights by Sainte-Lague apportionment.

Sizes are tokens of a public tokenizer. The mixture is counted in blocks of equal tokens. Blocks go to sources by
the highest quotients share / (2 n + 1), a source never beyond its capacity (its tokens times max_repeats); the
blocks of a source go to its shards by the same rule over shard sizes. What the driver holds is one number per
source and shard, not documents. The divisor is found by bisection and only the last few seats by a heap, so the
cost does not depend on the number of blocks.

Within a shard (a bounded number of documents) the documents stand in a seeded order; a quota of q tokens takes whole
passes over the shard, then the documents of the first blocks of that order (those whose middle lies before the
rest). Documents are never cut.

Defined cases: null and empty texts and null sources take no part; a repeated document id counts once; a target
without documents gets nothing and the other shares are raised in proportion; sources without target are left out;
an empty table gives an empty mixture, and a report of zeros. block_tokens is the most a block may have: blocks are
smaller where a thousandth of a source's even share is, so a tiny source gets its share, too.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slatework.llm.split import load_ranks
from slatework.runtime import mapped, need, settled

_ENCODINGS: dict[str, object] = {}


def sainte_lague(weights: Sequence[float], seats: int, caps: Sequence[int] | None = None) -> list[int]:
    """Seats by highest quotients weight / (2 n + 1), none beyond its cap; ties go to the earlier party."""
    caps = [seats] * len(weights) if caps is None else [min(c, seats) for c in caps]
    live = [w > 0 and c > 0 for w, c in zip(weights, caps)]
    seats = min(seats, sum(c for c, a in zip(caps, live) if a))
    got = [0] * len(weights)
    if seats <= 0:
        return got

    def at(divisor: float) -> list[int]:
        return [min(c, math.floor(w / divisor + 0.5)) if a else 0 for w, c, a in zip(weights, caps, live)]

    low, high = 0.0, 4 * max(weights)
    for _ in range(200):  # the smallest divisor that hands out no more than all seats
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (low, mid) if sum(at(mid)) <= seats else (mid, high)
    got = at(high)
    heap = [(-w / (2 * g + 1), i) for i, (w, g, c, a) in enumerate(zip(weights, got, caps, live)) if a and g < c]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def token_counts(documents: DataFrame, vocabulary: str, *, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, n_tokens) of every document with source and text, by a .tiktoken vocabulary file."""
    need(documents, doc_id, text, source)
    own = documents.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        F.col(text).alias("_text")).filter("doc_id is not null and source is not null and _text <> ''")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if vocabulary not in _ENCODINGS:
            _ENCODINGS[vocabulary] = load_ranks(vocabulary)
        encode = _ENCODINGS[vocabulary].encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "n_tokens": [len(encode(t)) for t in pdf["_text"]]})

    kind = own.schema["doc_id"].dataType.simpleString()
    return mapped(own, work, f"doc_id {kind}, source string, n_tokens bigint")


def mix_sources(counts: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, block_tokens: int = 2048, shard_docs: int = 20_000,
        seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares).

    mixture(doc_id, source, n_tokens, repeats): how often each chosen document is used. shares: target and actual
    share, quota and tokens per target source. Without total_tokens, the largest total is taken at which no source
    with documents falls short.
    """
    need(counts, "doc_id", "source", "n_tokens")
    need(targets, "source", "target_share", "max_repeats")
    spark = counts.sparkSession
    wanted = targets.groupBy("source").agg(F.max("target_share").alias("target_share"),
        F.max("max_repeats").alias("max_repeats")).filter("source is not null").orderBy("source").collect()
    named = [r["source"] for r in wanted]
    own = counts.filter(F.col("source").isin(named)).groupBy("doc_id", "source").agg(F.max("n_tokens").alias("n_tokens")).filter("n_tokens > 0")
    own = settled(own)
    sizes = {r["source"]: (r["n"], r["t"]) for r in own.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()}
    parts = {s: -(-n // shard_docs) for s, (n, _) in sizes.items()}
    plan = F.broadcast(spark.createDataFrame([(s, int(p)) for s, p in parts.items()] or [("", 1)], "source string, parts int"))
    sharded = own.join(plan, "source").withColumn("order", F.xxhash64("doc_id", F.lit(seed))).withColumn("shard",
        F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.col("parts")).cast("int"))
    shards: dict[str, list[tuple[int, int]]] = {}
    for r in sharded.groupBy("source", "shard").agg(F.sum("n_tokens").alias("t")).orderBy("source", "shard").collect():
        shards.setdefault(r["source"], []).append((r["shard"], r["t"]))

    rich = [r for r in wanted if r["source"] in sizes and (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) > 0]
    whole = sum(r["target_share"] for r in rich)
    weights = [r["target_share"] / whole for r in rich]
    caps = [sizes[r["source"]][1] * r["max_repeats"] for r in rich]
    total = total_tokens if total_tokens is not None else int(min((c / w for c, w in zip(caps, weights)), default=0))
    # Small enough that every source can hold its share in whole blocks; the work does not depend on their number.
    block_tokens = max(1, min(block_tokens, total // (1000 * max(1, len(rich)))))
    seats = sainte_lague(weights, total // block_tokens, [c // block_tokens for c in caps])
    quotas, quota_of = [], {}
    for r, n in zip(rich, seats):
        quota_of[r["source"]] = n * block_tokens
        own_shards = shards[r["source"]]
        for (shard, t), blocks in zip(own_shards, sainte_lague([t for _, t in own_shards], n,
                [t * r["max_repeats"] // block_tokens for _, t in own_shards])):
            quotas.append((r["source"], shard, blocks * block_tokens // t, blocks * block_tokens % t))
    quota = F.broadcast(spark.createDataFrame(quotas or [("", 0, 0, 0)], "source string, shard int, passes bigint, rest bigint"))
    line = Window.partitionBy("source", "shard").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = F.sum("n_tokens").over(line) - F.col("n_tokens") / 2
    used = sharded.join(quota, ["source", "shard"]).withColumn("repeats",
        F.col("passes") + F.when(middle < F.col("rest"), 1).otherwise(0)).filter("repeats > 0")
    mixture = used.select("doc_id", "source", "n_tokens", "repeats")
    report = spark.createDataFrame([(r["source"], float(r["target_share"] or 0), int(r["max_repeats"] or 0),
        *map(int, sizes.get(r["source"], (0, 0))), int(quota_of.get(r["source"], 0))) for r in wanted],
                                   "source string, target_share double, max_repeats int, documents bigint, tokens bigint, quota_tokens bigint")
    took = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("mixed_tokens"), F.count("*").alias("mixed_documents"),
        F.max("repeats").alias("most_repeats"))
    joined = report.join(took, "source", "left").na.fill(0, ["mixed_tokens", "mixed_documents", "most_repeats"])
    share = F.col("mixed_tokens") / F.nullif(F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1))), F.lit(0))
    return mixture, joined.withColumn("actual_share", F.coalesce(share, F.lit(0.0)))
