"""Exact cosine search over given vectors, encoders as injected callables, and checked embedding caches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatework.operators.best import Best
from slatework.operators.sparse import top_k
from slatework.runtime import mapped_arrow, need, settled, ship

CHUNK_CACHE, PAGE_CACHE = "slatework-chunk-embeddings-v1", "slatework-page-embeddings-v1"


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def unit(v: Column) -> Column:
    """v over its norm, which is computed once a row."""
    v = v.cast("array<double>")
    once = F.transform(F.array(F.struct(v.alias("v"), norm(v).alias("n"))), lambda s: F.transform(s["v"], lambda x: x / s["n"]))
    return F.get(once, F.lit(0))


def checked_unit(df: DataFrame, column: str, finite: bool = True) -> DataFrame:
    """df with unit vectors in column; ValueError unless all share one dimension and have a non-zero (finite) norm."""
    v = F.col(column).cast("array<double>")
    size = norm(v)
    bad = size.isNull() | (size == 0) | ((F.isnan(size) | (size == float("inf"))) if finite else F.lit(False))
    seen = df.agg(F.count_if(bad).alias("bad"), F.min(F.size(v)).alias("low"), F.max(F.size(v)).alias("high")).first()
    if seen["low"] is not None and (seen["low"] != seen["high"] or seen["low"] <= 0):
        raise ValueError("embeddings must have one non-zero shared dimension")
    if seen["bad"]:
        raise ValueError("embeddings must be finite non-zero vectors")
    return df.withColumn(column, unit(F.col(column)))


def _arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]


def cosine_top_k(queries: DataFrame, rows: DataFrame, k: int, *, row_id: str, digits: int | None = None, held_numbers: int = 8_000_000) -> DataFrame:
    """(query_id, row_id, score, rank): a stated query set against all rows, in blocks; equals go by row_id.

    queries(query_id, embedding) and rows(row_id, embedding) hold unit vectors. One scan of the rows serves all
    queries whose vectors have up to held_numbers numbers together (the workers' share is bounded by it), further
    queries take further scans. A task keeps its k best rows per query, so what leaves it is bounded. digits rounds
    before ranking, for comparisons; scores come out rounded to 8 digits.
    """
    need(rows, row_id, "embedding")
    if k < 1:
        return queries.select("query_id", F.lit(None).alias(row_id), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    spark = queries.sparkSession
    asked = settled(queries.select("query_id", "embedding").filter("embedding is not null"))
    r = asked.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    parts = -(-r["n"] * (r["d"] or 1) // held_numbers) or 1
    kinds = [asked.schema["query_id"].dataType.simpleString(), rows.schema[row_id].dataType.simpleString()]
    out = None
    for p in range(parts):
        part = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p).toPandas()
        held = spark.sparkContext.broadcast((part["query_id"].tolist(), np.array(part["embedding"].tolist(), np.float64)))

        def score(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names, q = held.value
            best = Best(len(names), k)
            for batch in batches:
                for low in range(0, batch.num_rows if names else 0, 2048):
                    some = batch.slice(low, 2048)
                    ids = some.column(row_id).to_numpy(zero_copy_only=False)
                    x = some.column("embedding").flatten().to_numpy().reshape(len(ids), -1)
                    for first in range(0, len(names), 512):
                        s = q[first : first + 512] @ x.T
                        best.add(first, s if digits is None else np.round(s, digits), ids)
            row, ids, s = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in row], _arrow(kinds[0])), pa.array(ids.tolist(), _arrow(kinds[1])),
                pa.array(s, pa.float64())], names=["query_id", row_id, "score"])

        one = mapped_arrow(rows.select(row_id, "embedding").filter("embedding is not null"), score,
            f"query_id {kinds[0]}, {row_id} {kinds[1]}, score double")
        out = one if out is None else out.unionByName(one)
    return top_k(out, k, F.desc("score"), F.col(row_id)).withColumn("score", F.round("score", 8))


def pair_scores(pairs: DataFrame, queries: DataFrame, rows: DataFrame, row_id: str = "chunk_id") -> DataFrame:
    """(query_id, row_id, score) of the given pairs of unit vectors; nothing is ranked."""
    both = pairs.select("query_id", row_id).distinct().join(queries.select("query_id", F.col("embedding").alias("_q")),
        "query_id").join(rows.select(row_id, F.col("embedding").alias("_r")), row_id)
    return both.select("query_id", row_id, F.aggregate(F.zip_with("_q", "_r", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x).alias("score"))


def dense_search(queries: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    return cosine_top_k(queries, chunks, k, row_id="chunk_id")


def visual_search(queries: DataFrame, pages: DataFrame, k: int = 5, digits: int | None = None) -> DataFrame:
    """(query_id, document_id, page_number, score, rank); equal scores go by page number, then by document."""
    keyed = pages.select(F.format_string("%010d|%s", F.col("page_number"), F.col("document_id")).alias("key"), "embedding")
    found = cosine_top_k(queries, keyed, k, row_id="key", digits=digits)
    parts = [F.expr("substring(key, instr(key, '|') + 1)").alias("document_id"), F.substring_index("key", "|", 1).cast("int").alias("page_number")]
    return found.select("query_id", *parts, "score", "rank")


def encoded(df: DataFrame, text: str, encoder: Callable[[], Callable[[list[str]], list[list[float]]]], prefix: str = "passage: ",
        batch_size: int = 32) -> DataFrame:
    """df with embedding, by an injected model: encoder() loads it, once a worker; its result encodes a list of texts."""
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    ship(df.sparkSession)

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder()
        for s in batches:
            rows = [prefix + (t or "") for t in s]
            yield pd.Series([list(map(float, v)) for i in range(0, len(rows), batch_size) for v in model(rows[i : i + batch_size])])

    return df.withColumn("embedding", encode(F.col(text)))


def cache_rows(chunks: DataFrame, model: str, query_prefix: str = "query: ", document_prefix: str = "passage: ") -> DataFrame:
    """Rows of a chunk embedding cache: unit vectors with the fingerprint of the text they were made from, the model and its prefixes."""
    if not model:
        raise ValueError("an embedding cache needs the name of its model")
    out = checked_unit(chunks.select("chunk_id", F.sha2("text", 256).alias("text_sha256"), "embedding"), "embedding")
    return out.withColumns({"model": F.lit(model), "query_prefix": F.lit(query_prefix), "document_prefix": F.lit(document_prefix),
        "format": F.lit(CHUNK_CACHE)})


def page_cache_rows(pages: DataFrame, model: str) -> DataFrame:
    """Rows of a page embedding cache from pages with document_id, page_number, sha256 and embedding."""
    if not model:
        raise ValueError("an embedding cache needs the name of its model")
    own = pages.select("document_id", "page_number", F.col("sha256").alias("image_sha256"), "embedding")
    return checked_unit(own, "embedding", finite=False).withColumns({"model": F.lit(model), "format": F.lit(PAGE_CACHE),
        "ord": F.monotonically_increasing_id()})


def cache_header(cache: DataFrame, form: str, model: str | None = None) -> dict[str, str]:
    """What all rows of a cache agree on: model and, where there are any, its prefixes.

    ValueError for another format, no model name, several models, or another model than the one asked for. An empty
    cache has no header.
    """
    need(cache, "model", "format")
    names = [c for c in ("format", "model", "query_prefix", "document_prefix") if c in cache.columns]
    seen = cache.select(*names).distinct().limit(2).collect()
    if any(r["format"] != form for r in seen):
        raise ValueError("not a cache of this kind and version")
    if any(not r["model"] for r in seen):
        raise ValueError("the cache has no model name")
    if len(seen) > 1:
        raise ValueError("the rows of the cache are of different models or prefixes")
    if seen and model is not None and seen[0]["model"] != model:
        raise ValueError(f"the cache is of other model {seen[0]['model']!r}, not {model!r}")
    return {c: seen[0][c] or "" for c in names[1:]} if seen else {}


def cache_faults(chunks: DataFrame, cache: DataFrame, model: str | None = None) -> DataFrame:
    """(chunk_id, fault): duplicate cache rows, chunks without a row, rows made from another text or by another model."""
    rows = cache.select("chunk_id", "text_sha256", "model")
    twice = rows.groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1").select("chunk_id", F.lit("duplicate").alias("fault"))
    both = chunks.select("chunk_id", F.sha2("text", 256).alias("now")).join(rows.dropDuplicates(["chunk_id"]), "chunk_id", "left")
    fault = F.when(F.col("model").isNull() & F.col("text_sha256").isNull(), "missing").when(~F.col("text_sha256").eqNullSafe(F.col("now")),
        "text changed")
    if model is not None:
        fault = fault.when(~F.col("model").eqNullSafe(F.lit(model)), "other model")
    return twice.unionByName(both.select("chunk_id", fault.alias("fault")).filter("fault is not null"))


def load_cache(chunks: DataFrame, cache: DataFrame, model: str | None = None) -> DataFrame:
    """(chunk_id, embedding) of every chunk, unit vectors; ValueError names the faults of the cache."""
    cache_header(cache, CHUNK_CACHE, model)
    found = cache_faults(chunks, cache, model).groupBy("fault").agg(F.count("*").alias("n"),
        F.min("chunk_id").alias("first")).orderBy("fault").collect()
    if found:
        raise ValueError("; ".join(f"{r['n']} x {r['fault']} (first: {r['first']})" for r in found))
    return checked_unit(chunks.select("chunk_id").join(cache.select("chunk_id", "embedding"), "chunk_id"), "embedding")


def load_page_cache(pages: DataFrame, cache: DataFrame, model: str | None = None) -> DataFrame:
    """(document_id, page_number, embedding); of repeated cache rows the last (by ord) counts; format, model and images must agree."""
    cache_header(cache, PAGE_CACHE, model)
    key = ["document_id", "page_number"]
    last = cache.groupBy(*key).agg(F.max_by(F.struct("image_sha256", "embedding"), "ord").alias("c"))
    both = pages.select(*key, "sha256").join(last, key, "left")
    bad = both.filter(F.col("c").isNull() | ~F.col("c.image_sha256").eqNullSafe(F.col("sha256"))).orderBy(*key).limit(1).collect()
    if bad:
        raise ValueError(f"page embedding missing or made from another image: {bad[0]['document_id']} page {bad[0]['page_number']}")
    return checked_unit(both.select(*key, F.col("c.embedding").alias("embedding")), "embedding", finite=False)
