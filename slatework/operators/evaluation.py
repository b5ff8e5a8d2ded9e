"""Ranking quality: relevance, per-query metrics, summaries, comparisons and the check of labelled sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatework.functions.text import strip
from slatework.schemas import QUESTION_TYPES, SPLITS, STATUSES


def chunk_hits(examples: DataFrame, ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked rows with document, pages and hit: the chunk is labelled, or covers a labelled page of the (or any) document."""
    where = chunks.select("chunk_id", "document_id", "page_start", "page_end")
    labels = examples.select(F.col("id").alias("query_id"), F.col("document_id").alias("want"), "relevant_pages", "relevant_chunk_ids")
    inside = F.exists("relevant_pages", lambda p: p.between(F.col("page_start"), F.col("page_end")))
    named = F.array_contains("relevant_chunk_ids", F.col("chunk_id"))
    hit = F.coalesce(named, F.lit(False)) | ((F.col("want").isNull() | (F.col("want") == F.col("document_id"))) & F.coalesce(inside, F.lit(False)))
    return ranked.join(where, "chunk_id").join(labels, "query_id").withColumn("hit", F.coalesce(hit, F.lit(False))).drop("relevant_pages",
        "relevant_chunk_ids", "want")


def page_hits(examples: DataFrame, ranked: DataFrame) -> DataFrame:
    """Ranked pages with hit: the document must be the example's (a null one never is) and the page labelled."""
    labels = examples.select(F.col("id").alias("query_id"), F.col("document_id").alias("want"), "relevant_pages")
    hit = (F.col("want") == F.col("document_id")) & F.array_contains("relevant_pages", F.col("page_number"))
    return ranked.join(labels, "query_id").withColumn("hit", F.coalesce(hit, F.lit(False))).drop("relevant_pages", "want")


def _gain(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank.cast("double") + 1)


def query_metrics(examples: DataFrame, hits: DataFrame, k: int = 5, pages: bool = False) -> DataFrame:
    """(query_id, question_type, recall, precision, rr, ndcg, no_result) of every example.

    recall is a hit rate and precision divides by k. The ideal of chunks counts observed hits, that of pages does not.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    h = hits.filter(F.col("rank") <= k).groupBy("query_id").agg(F.count("*").alias("n"), F.count_if("hit").alias("good"),
        F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"), F.sum(F.when(F.col("hit"), _gain(F.col("rank"))).otherwise(0.0)).alias("dcg"))
    size = lambda c: F.greatest(F.size(F.coalesce(c, F.array().cast("array<int>" if c == "relevant_pages" else "array<string>"))),
        F.lit(0))
    own = examples.select(F.col("id").alias("query_id"), F.coalesce("question_type", F.lit("unlabeled")).alias("question_type"),
        size("relevant_pages").alias("np"), (F.lit(0) if pages else size("relevant_chunk_ids")).alias("nc"))
    out = own.join(h, "query_id", "left").na.fill(0, ["n", "good"]).na.fill(0.0, ["dcg"])
    ideal = F.least(F.lit(k), F.greatest(F.lit(1), "np") if pages else F.greatest(F.lit(1), "np", "nc", F.col("good")))
    idcg = F.aggregate(F.sequence(F.lit(1), ideal.cast("int")), F.lit(0.0), lambda a, i: a + _gain(i))
    return out.select("query_id", "question_type", (F.col("good") > 0).cast("double").alias("recall"), (F.col("good") / k).alias("precision"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), (F.col("dcg") / idcg).alias("ndcg"),
        (F.col("n") == 0).cast("double").alias("no_result"))


def summary(metrics: DataFrame, latency: str | None = None) -> DataFrame:
    """Means over all queries (question_type ALL) and by question type, to 6 digits; latency adds mean and nearest-rank p95."""
    means = [F.round(F.avg(m), 6).alias(n) for m, n in (("recall", "recall_at_k"), ("precision", "precision_at_k"), ("rr", "mrr"),
        ("ndcg", "ndcg_at_k"), ("no_result", "no_result_rate"))]
    if latency:
        means += [F.round(F.avg(latency), 3).alias("average_latency_ms"),
            F.round(F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {latency})"), 3).alias("p95_latency_ms")]
    labelled = metrics.withColumn("question_type", F.explode(F.array("question_type", F.lit("ALL"))))
    return labelled.groupBy("question_type").agg(F.count("*").alias("queries"), *means)


def compare(examples: DataFrame, hits_by_system: dict[str, DataFrame], keys: list[str], k: int = 10) -> DataFrame:
    """(query_id, system, hit_at_k, first_relevant_rank, top) of every example and system."""
    both = None
    for name, hits in hits_by_system.items():
        part = hits.filter(F.col("rank") <= k).select("query_id", F.lit(name).alias("system"), "rank", "hit",
            F.struct("rank", *keys, F.col("score"), "hit").alias("t"))
        both = part if both is None else both.unionByName(part)
    found = both.groupBy("query_id", "system").agg(F.max("hit").alias("hit_at_k"),
        F.min(F.when(F.col("hit"), F.col("rank"))).alias("first_relevant_rank"), F.array_sort(F.collect_list("t")).alias("top"))
    names = examples.sparkSession.createDataFrame([(n,) for n in hits_by_system], "system string")
    grid = examples.select(F.col("id").alias("query_id")).join(F.broadcast(names))
    return grid.join(found, ["query_id", "system"], "left").withColumn("hit_at_k", F.coalesce("hit_at_k", F.lit(False)))


def dataset_errors(examples: DataFrame, chunks: DataFrame | None = None, require: tuple[str, ...] = ()) -> DataFrame:
    """(id, code) of every fault; require names columns of document_id, question_type, split, annotation_status that must be set.

    Queries are compared without case (lower-cased after upper-casing, so that sharp s is ss). Of questions with the
    same query in a document all but the first by id are told; an id that comes again is told once.
    """
    blank = lambda c: F.length(strip(F.coalesce(c, F.lit("")))) == 0
    e = examples.select("id", "query", "document_id", "relevant_pages", "relevant_chunk_ids", "question_type", "split", "annotation_status")
    bad_pages = F.exists("relevant_pages", lambda p: p.isNull() | (p < 1))
    bad_chunks = F.exists("relevant_chunk_ids", lambda c: blank(c))
    none = (F.coalesce(F.size("relevant_pages"), F.lit(0)) <= 0) & (F.coalesce(F.size("relevant_chunk_ids"), F.lit(0)) <= 0)
    faults = [F.when(blank(F.col("id")), "id"), F.when(blank(F.col("query")), "query"), F.when(bad_pages, "relevant_pages"),
        F.when(bad_chunks, "relevant_chunk_ids"), F.when(none, "no_label"),
              F.when(F.col("document_id").isNotNull() & blank(F.col("document_id")), "document_id")]
    for c, allowed in (("question_type", QUESTION_TYPES), ("split", SPLITS), ("annotation_status", STATUSES)):
        faults.append(F.when(F.col(c).isNotNull() & ~F.col(c).isin(*allowed), c))
    faults += [F.when(F.col(c).isNull(), f"{c}_missing") for c in require]
    out = e.select("id", F.explode(F.array_compact(F.array(*faults))).alias("code"))
    twice = e.filter(~blank(F.col("id"))).groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit("duplicate_id").alias("code"))
    asked = e.filter(~blank(F.col("query"))).groupBy("document_id", F.lower(F.upper(strip(F.col("query")))).alias("q"),
        "id").agg(F.count("*").cast("int").alias("n"))
    first = asked.groupBy(F.col("document_id").alias("d"), F.col("q").alias("k")).agg(F.min("id").alias("first"),
        F.sum("n").alias("all")).filter("all > 1")
    again = asked.join(first, F.col("d").eqNullSafe(F.col("document_id")) & (F.col("k") == F.col("q"))).select("id",
        F.explode(F.array_repeat(F.lit("duplicate_query"), F.col("n") - F.col("id").eqNullSafe(F.col("first")).cast("int"))).alias("code"))
    out = out.unionByName(twice).unionByName(again)
    if chunks is not None:
        pages = chunks.select("document_id", F.explode(F.sequence("page_start", "page_end")).alias("page")).distinct()
        documents = pages.select("document_id").distinct()
        known = e.filter(F.col("document_id").isNotNull() & ~blank(F.col("document_id")))
        out = out.unionByName(known.join(documents, "document_id", "left_anti").select("id", F.lit("document_not_in_corpus").alias("code")))
        wants = known.filter(~F.coalesce(bad_pages, F.lit(False))).join(documents, "document_id", "left_semi").select("id", "document_id",
            F.explode("relevant_pages").alias("page"))
        out = out.unionByName(wants.join(pages, ["document_id", "page"], "left_anti").select("id",
            F.lit("page_not_in_corpus").alias("code")).distinct())
        named = e.filter(~F.coalesce(bad_chunks, F.lit(False))).select("id", "document_id", F.explode("relevant_chunk_ids").alias("chunk_id"))
        where = named.join(chunks.select("chunk_id", F.col("document_id").alias("d")).dropDuplicates(["chunk_id"]), "chunk_id", "left")
        each = where.groupBy("id", "document_id").agg(F.max(F.col("d").isNull()).alias("lost"),
            F.max(F.col("d") != F.col("document_id")).alias("foreign"))
        code = F.when(F.col("lost"), "chunk_not_in_corpus").when(F.col("foreign"), "chunk_of_other_document")
        out = out.unionByName(each.select("id", code.alias("code")).filter("code is not null"))
        out = out.unionByName(e.filter((F.size("relevant_pages") > 0) & ~F.coalesce(bad_pages,
            F.lit(False)) & F.col("document_id").isNull()).select("id", F.lit("pages_need_document").alias("code")))
    return out


def validate(examples: DataFrame, chunks: DataFrame | None = None, require: tuple[str, ...] = ()) -> DataFrame:
    """Counts (field, value, examples) of a sound set; ValueError lists its faults otherwise."""
    if examples.isEmpty():
        raise ValueError("invalid evaluation dataset: it has no examples")
    found = dataset_errors(examples, chunks, require).groupBy("code").agg(F.count("*").alias("n"),
        F.min("id").alias("first")).orderBy("code").collect()
    if found:
        raise ValueError("invalid evaluation dataset:\n" + "\n".join(f"- {r['code']}: {r['n']} (first: {r['first']})" for r in found))
    return dataset_counts(examples)


def dataset_counts(examples: DataFrame) -> DataFrame:
    """(field, value, examples) for question type, split, document and status; null counts as unlabeled."""
    fields = ("question_type", "split", "document_id", "annotation_status")
    long = examples.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"),
        F.coalesce(c, F.lit("unlabeled")).alias("value")) for c in fields])).alias("x"))
    return long.groupBy("x.field", "x.value").agg(F.count("*").alias("examples"))
