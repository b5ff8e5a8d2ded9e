"""Same or near-same records across splits.

Evaluation records are hashed n-gram sets; their hashes are partitioned, not broadcast, so the side may grow with
the data. Two sets of similarity t share at least one of their |s| - ceil(t |s|) + 1 rarest n-grams, so only those
are exchanged: training is scanned for hits on them (one equi-join on the hash, where the order by frequency keeps
hot n-grams out). Hits are counted per pair of texts: with a = ceil(t / (1 + t) (m + n)) n-grams to share, two sets of
m and n n-grams have at least a - ceil(t max(m, n)) + 1 hits, their first hit has a n-grams after it on both sides,
and no hit lies where too few are left before and after it. Every row also carries the parities of 256 groups of its
text's n-grams: where d of them differ, d n-grams at least stand in one set only, so (m + n - d) / 2 at most are
shared, and most chance hits end in the join itself. A pair that fails these counts cannot be similar; the others are
verified: containment of the evaluation record in the training record, and Jaccard similarity. Exact copies share a
fingerprint and are one text until ids are put back at the end. Records with the same document and the same set of
pages meet in a second equi-join.

n-grams are runs of characters of the bare text, as the problem's statement has it.

Defined cases: null ids and null or blank splits take no part; a repeated id counts once; null, blank and very short
queries (no n-gram) match nothing by text; an empty, null or all-null page list matches nothing; page lists are
compared as sets; an empty table gives an empty result. Every training record
has its own pairs, however many share its text or its document and pages; a hot group is spread over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatework.llm._grams import distinct, grams
from slatework.llm.neardup import BUCKETS, document_frequencies
from slatework.runtime import mapped, need, settled

SIZE = 4
#: About so many training records of one key meet the evaluation records in one task.
PART = 4096


def clean_name(column):
    """Trimmed (all white space) and lower-cased; blank is null."""
    c = F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))
    return F.when(c != "", c)


def parities(shingles: np.ndarray) -> np.ndarray:
    """Four numbers of 64 bits: how many of the shingles of each of 256 groups there are, even or odd."""
    odd = np.bincount((shingles >> np.uint64(20)).astype(np.int64) & 255, minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _met(held: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """held and kept (keys, train_id) joined on keys; the training records of a hot key are spread over tasks."""
    parts = kept.groupBy(*keys).agg(F.ceil(F.count("*") / PART).cast("int").alias("_parts"))
    each = kept.join(parts, keys).withColumn("_part", F.pmod(F.xxhash64("train_id"), F.col("_parts")).cast("int")).drop("_parts")
    asked = held.join(parts, keys).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return asked.join(each, [*keys, "_part"]).drop("_part")


def cross_split_pairs(records: DataFrame, *, record_id: str = "id", text: str = "query", split: str = "split", document: str = "document_id",
        pages: str = "relevant_pages",
                      held_out: tuple[str, ...] = ("dev", "test"), train: str = "train", min_similarity: float = 0.6) -> DataFrame:
    """(eval_id, train_id, eval_split, similarity, containment, same_pages) of every pair that is the same or nearly so.

    similarity and containment are null where only document and pages agree.
    """
    need(records, record_id, text, split, document, pages)
    own = records.select(F.col(record_id).cast("string").alias("_id"), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "").alias("body"),
        clean_name(F.col(split)).alias("_split"), F.col(document).alias("_doc"),
                         F.array_sort(F.array_compact(F.array_distinct(pages))).alias("_pages"))
    own = settled(own.filter(F.col("_id").isNotNull() & F.col("_split").isin(train, *held_out)).dropDuplicates(["_id"]))
    own = own.withColumn("fp", F.xxhash64("body"))
    df, _ = document_frequencies(own.filter(f"length(body) >= {SIZE}"))
    order = own.sparkSession.sparkContext.broadcast(df)

    def rare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts, size = [], []
            for h in grams(pdf["body"].tolist(), SIZE):
                s = distinct(h)
                by = np.lexsort((s, order.value[(s & np.uint64(BUCKETS - 1)).astype(np.int64)]))
                parts.append(s[by[: len(s) - math.ceil(min_similarity * len(s) - 1e-9) + 1]].view(np.int64) if len(s) else s.view(np.int64))
                size.append((len(s), *parities(s).tolist()))
            many = [len(x) for x in parts]
            if sum(many):
                rows = np.repeat(np.array(size, np.int64), many, axis=0)
                places = np.concatenate([np.arange(m) for m in many])
                yield pd.DataFrame({"h": np.concatenate(parts), "fp": np.repeat(pdf["fp"].to_numpy(), many), "p": places,
                    "n": rows[:, 0]} | {f"g{k}": rows[:, 1 + k] for k in range(4)})

    held = own.filter(F.col("_split").isin(*held_out))
    kept = own.filter(F.col("_split") == train)
    short = f"length(body) >= {SIZE}"
    columns = ["fp", "p", "n", "g0", "g1", "g2", "g3"]
    e, t = (mapped(x.filter(short).select("fp", "body").distinct(), rare,
        "h bigint, fp bigint, p bigint, n bigint, g0 bigint, g1 bigint, g2 bigint, g3 bigint") for x in (held, kept))
    e, t = (x.withColumnsRenamed({c: f"{c}_{side}" for c in columns}) for x, side in ((e, "e"), (t, "t")))
    fits = (F.col("n_t") >= F.col("n_e") * min_similarity - 1e-9) & (F.col("n_e") >= F.col("n_t") * min_similarity - 1e-9)
    least = F.ceil((F.col("n_e") + F.col("n_t")) * (min_similarity / (1 + min_similarity)) - 1e-9)
    after = F.least(F.col("n_e") - F.col("p_e"), F.col("n_t") - F.col("p_t"))
    apart = sum((F.bit_count(F.col(f"g{k}_e").bitwiseXOR(F.col(f"g{k}_t"))) for k in range(4)), F.lit(0))
    hits = e.join(t, "h").filter(fits & (F.least("p_e", "p_t") + after >= least) & (F.col("n_e") + F.col("n_t") - apart >= 2 * least))
    pairs = hits.groupBy("fp_e", "fp_t", "n_e", "n_t").agg(F.count("*").alias("n"), F.max(after).alias("after"))
    hits = pairs.filter((F.col("n") > least - F.ceil(F.greatest("n_e", "n_t") * min_similarity - 1e-9)) & (F.col("after") >= least)).select("fp_e",
        "fp_t")
    known = own.filter(short)
    bodies = known.select("fp", "body").dropDuplicates(["fp"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for fp_e, fp_t, a, b in zip(pdf["fp_e"], pdf["fp_t"], pdf["body_e"], pdf["body_t"]):
                x, y = {a[i : i + SIZE] for i in range(len(a) - SIZE + 1)}, {b[i : i + SIZE] for i in range(len(b) - SIZE + 1)}
                both = len(x & y)
                if both >= min_similarity * (len(x) + len(y) - both) - 1e-12:
                    out.append((fp_e, fp_t, both / (len(x) + len(y) - both), both / len(x)))
            yield pd.DataFrame(out, columns=["fp_e", "fp_t", "similarity", "containment"])

    full = hits.join(bodies.withColumnsRenamed({"fp": "fp_e", "body": "body_e"}),
        "fp_e").join(bodies.withColumnsRenamed({"fp": "fp_t", "body": "body_t"}), "fp_t")
    texts = mapped(full, verify, "fp_e bigint, fp_t bigint, similarity double, containment double")
    ids = known.select("fp", "_id", "_split")
    by_text = texts.join(ids.filter(F.col("_split") != train).select(F.col("fp").alias("fp_e"), F.col("_id").alias("eval_id"),
        F.col("_split").alias("eval_split")), "fp_e")
    by_text = _met(by_text, ids.filter(F.col("_split") == train).select(F.col("fp").alias("fp_t"), F.col("_id").alias("train_id")), ["fp_t"])
    paged = F.col("_doc").isNotNull() & (F.size("_pages") > 0)
    by_pages = held.filter(paged).select("_doc", "_pages", F.col("_id").alias("eval_id"), F.col("_split").alias("eval_split"))
    by_pages = _met(by_pages, kept.filter(paged).select("_doc", "_pages", F.col("_id").alias("train_id")), ["_doc", "_pages"])
    none = F.lit(None).cast("double")
    both = by_text.select("eval_id", "train_id", "eval_split", "similarity", "containment", F.lit(False).alias("same_pages")).unionByName(
        by_pages.select("eval_id", "train_id", "eval_split", none.alias("similarity"), none.alias("containment"),
        F.lit(True).alias("same_pages")))
    return both.groupBy("eval_id", "train_id", "eval_split").agg(F.max("similarity").alias("similarity"), F.max("containment").alias("containment"),
        F.max("same_pages").alias("same_pages"))
