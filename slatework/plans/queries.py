"""Registered queries of the core operators, over whole tables; the same results in SQL are in plans.sql.

A table's repeated rows are no new records: dedupe by key comes first everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatework.functions import text as X
from slatework.operators import chunking, dense, evaluation, fusion, graph, mining, pages
from slatework.operators.sparse import Bm25Index, term_statistics
from slatework.plans import sql
from slatework.runtime import settled, table
from slatework.sources import readers

Q = dict[str, Callable[[SparkSession, str], DataFrame]]
REGISTRY: Q = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[f.__name__] = f
    return f


def queries() -> Q:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()


def _pages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "course_pages").dropDuplicates(["document_id", "page_number"])


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return readers.with_chunk_defaults(table(s, d, "course_chunks").dropDuplicates(["chunk_id"]))


def _passages(s: SparkSession, d: str) -> DataFrame:
    return pages.at_levels(_chunks(s, d), "passage")


def _examples(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "public_course_eval_reviewed").dropDuplicates(["id"])


def _asked(e: DataFrame) -> DataFrame:
    return e.filter("trim(query) <> ''").select(F.col("id").alias("query_id"), "query")


def _long(c: str, kind: str = "bigint"):
    return F.col(c).cast(kind).alias(c)


# Sources and filters


@query
def doc_content_id(s, d):
    return table(s, d, "documents").select("doc_id", X.content_id(F.col("text").cast("binary")).alias("document_id"))


@query
def manifest_flatten(s, d):
    return readers.manifest_files(table(s, d, "source_manifest"))


@query
def repeated_downloads(s, d):
    """Files that a source has several times for one topic and role."""
    return readers.repeated_keys(table(s, d, "course_files"), "source_id", "topic", "role").select("source_id", "topic", "role", _long("rows"))


@query
def level_filter(s, d):
    return pages.at_levels(_chunks(s, d), "section", "page").groupBy("level").agg(F.count("*").alias("chunks"),
        F.sum(F.length("text")).alias("characters"))


@query
def low_value_filter(s, d):
    return pages.without_low_value(_chunks(s, d)).groupBy("level").agg(F.count("*").alias("chunks"))


@query
def split_filter(s, d):
    return pages.of_split(_examples(s, d), "dev").select("id")


# Page preparation


@query
def boilerplate_lines(s, d):
    return pages.boilerplate_lines(_pages(s, d)).select("document_id", "line", _long("pages"))


@query
def cleaned_pages(s, d):
    out = pages.clean_pages(_pages(s, d))
    return out.select("document_id", _long("page_number"), "text", F.size("removed_lines").cast("bigint").alias("removed"))


@query
def page_quality(s, d):
    out = pages.assess_pages(_pages(s, d))
    return out.select("document_id", _long("page_number"), "role", "requires_vision", "text_retrieval_excluded", "visual_risk_score",
        F.array_join("visual_risk_reasons", ",").alias("reasons"))


@query
def parse_report(s, d):
    out = pages.parse_report(pages.prepare_pages(_pages(s, d)))
    sizes = [F.size(c).cast("bigint").alias(c) for c in ("empty_pages", "low_text_pages", "image_pages", "requires_vision_pages", "low_value_pages",
        "text_retrieval_excluded_pages")]
    return out.select("document_id", _long("page_count"), _long("nonempty_pages"), _long("total_characters"), _long("removed_boilerplate_lines"),
        "text_coverage", *sizes, F.size("warnings").cast("bigint").alias("warnings"))


@query
def vision_pages(s, d):
    return pages.only_vision(pages.assess_pages(_pages(s, d))).groupBy("role").agg(F.count("*").alias("pages"))


# Chunking


@query
def section_groups(s, d):
    p = chunking.sections(pages.assess_pages(_pages(s, d)))
    return p.groupBy("document_id", "section_no", "section").agg(F.min("page_number").cast("bigint").alias("page_start"),
        F.max("page_number").cast("bigint").alias("page_end"), F.count("*").alias("pages")).withColumn("section_no", _long("section_no"))


@query
def sentence_split(s, d):
    return _passages(s, d).select("chunk_id", X.sentences(F.col("text")).alias("x")).select("chunk_id",
        F.size("x").cast("bigint").alias("sentences"), F.sha1(F.array_join("x", "|")).alias("mark"))


@query
def passage_windows(s, d):
    return _pages(s, d).select("document_id", _long("page_number"), F.posexplode(X.windows(X.sentences(F.col("text")), 500, 1)).alias("window",
        "text")).withColumn("window", _long("window"))


@query
def chunked_pages(s, d):
    out = chunking.chunk_pages(pages.prepare_pages(_pages(s, d)))
    return out.select("chunk_id", "document_id", _long("page_start"), _long("page_end"), "text", "section", "parent_id", "level",
        F.array_join("child_ids", ",").alias("children"))


@query
def chunk_levels(s, d):
    return mining.count_by(chunking.chunk_pages(pages.prepare_pages(_pages(s, d))), "level", ("section", "page", "passage"))


@query
def truncated_sections(s, d):
    c = pages.at_levels(_chunks(s, d), "section")
    return c.select("chunk_id", F.sha1(X.truncated(F.col("text"), 400)).alias("mark"),
        F.length(X.truncated(F.col("text"), 400)).cast("bigint").alias("size"))


@query
def hierarchy_errors(s, d):
    return chunking.hierarchy_errors(_chunks(s, d))


@query
def own_hierarchy_errors(s, d):
    return chunking.hierarchy_errors(settled(chunking.chunk_pages(pages.prepare_pages(_pages(s, d)))))


# Retrieval


@query
def token_counts(s, d):
    return _passages(s, d).select("chunk_id", F.size(X.mixed_tokens(F.col("text"))).cast("bigint").alias("tokens"))


@query
def bm25_idf(s, d):
    return term_statistics(_passages(s, d)).select("term", _long("df"), F.round("idf", 6).alias("idf"))


def _bm25(s, d, k=5, level="passage"):
    chunks = _chunks(s, d) if level is None else pages.at_levels(_chunks(s, d), level)
    return Bm25Index.build(chunks).search(_asked(_examples(s, d)), k, digits=6)


@query
def bm25_topk(s, d):
    return _bm25(s, d).select("query_id", "chunk_id", "score", _long("rank"))


@query
def bm25_level_weighted(s, d):
    return _bm25(s, d, level=None).select("query_id", "chunk_id", "score", _long("rank"))


def _vectors(s, d, queries: bool):
    e = table(s, d, "embeddings").withColumn("embedding", dense.unit(F.col("embedding")))
    return e.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding", "label") if queries else e


def _dense(s, d, k=5):
    """Every vector whose id is divisible by 50, against all vectors."""
    return dense.cosine_top_k(_vectors(s, d, True), _vectors(s, d, False), k, row_id="vec_id", digits=6)


@query
def dense_topk(s, d):
    return _dense(s, d).select("query_id", "vec_id", "score", _long("rank"))


@query
def dense_label_precision(s, d):
    labels = table(s, d, "embeddings").select("vec_id", "label")
    own = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("want"))
    hits = _dense(s, d, 11).filter("query_id <> vec_id").join(labels, "vec_id").join(own, "query_id")
    return hits.groupBy("want").agg(F.count("*").alias("neighbours"), F.count_if(F.col("label") == F.col("want")).alias("same_label"))


@query
def visual_topk(s, d):
    """Page vectors stand in for page images: document = label, page = id."""
    p = _vectors(s, d, False).select(F.concat(F.lit("doc-"), F.col("label").cast("string")).alias("document_id"),
        F.col("vec_id").cast("int").alias("page_number"), "embedding")
    return dense.visual_search(_vectors(s, d, True), p, 5, digits=6).select("query_id", "document_id", _long("page_number"), "score")


@query
def cache_faults(s, d):
    cached = table(s, d, "chunk_embedding_cache").dropDuplicates(["chunk_id"])
    return dense.cache_faults(_passages(s, d).join(cached, "chunk_id", "left_semi"), table(s, d, "chunk_embedding_cache"))


def _to_pages(s, d, k=5):
    c = _passages(s, d)
    return fusion.to_pages(_bm25(s, d, 50), c, _pages(s, d), k)


@query
def bm25_pages(s, d):
    return _to_pages(s, d).select("query_id", "document_id", _long("page_number"), "score", _long("rank"))


def _systems(s, d, k=50):
    """BM25 over passages and over passages with a shorter length normalisation: two rankings to fuse and compare."""
    asked, index = _asked(_examples(s, d)), Bm25Index.build(_passages(s, d))
    return {"bm25": settled(index.search(asked, k, digits=6)), "bm25_flat": settled(index.flat(1.2, 0.0).search(asked, k, digits=6))}


@query
def rrf_chunks(s, d):
    return fusion.fuse(_systems(s, d), ["chunk_id"], 5, {"bm25": 1.0, "bm25_flat": 3.0}, 60, 50, 12).select("query_id", "chunk_id", "score",
        _long("rank"))


@query
def rrf_pages(s, d):
    c, p = _passages(s, d), _pages(s, d)
    ranked = {n: fusion.to_pages(r, c, p, 50, 50) for n, r in _systems(s, d).items()}
    return fusion.fuse(ranked, ["document_id", "page_number"], 5, digits=12).select("query_id", "document_id", _long("page_number"), "score",
        _long("rank"))


@query
def reranked_by_length(s, d):
    """Reranking with a stand-in scorer: the shortest passage first."""
    c = _passages(s, d).select("chunk_id", (-F.length("text")).cast("double").alias("second"))
    return fusion.reranked(_bm25(s, d, 20).join(c, "chunk_id"), "second").select("query_id", "chunk_id", "score", _long("rank"))


# Evaluation


def _hits(s, d, k=5):
    return evaluation.chunk_hits(_examples(s, d), _bm25(s, d, k), _passages(s, d))


@query
def eval_chunks(s, d):
    m = evaluation.query_metrics(_examples(s, d), _hits(s, d))
    return m.select("query_id", "question_type", "recall", "precision", *[F.round(c, 6).alias(c) for c in ("rr", "ndcg")], "no_result")


@query
def eval_pages(s, d):
    e = _examples(s, d)
    m = evaluation.query_metrics(e, evaluation.page_hits(e, _to_pages(s, d)), pages=True)
    return m.select("query_id", "question_type", "recall", "precision", *[F.round(c, 6).alias(c) for c in ("rr", "ndcg")], "no_result")


@query
def eval_summary(s, d):
    return evaluation.summary(evaluation.query_metrics(_examples(s, d), _hits(s, d)))


@query
def compare_systems(s, d):
    e, c = _examples(s, d), _passages(s, d)
    out = evaluation.compare(e, {n: evaluation.chunk_hits(e, r, c) for n, r in _systems(s, d).items()}, ["chunk_id"], 10)
    return out.select("query_id", "system", "hit_at_k", _long("first_relevant_rank"), F.size("top").cast("bigint").alias("shown"))


@query
def dataset_errors(s, d):
    return evaluation.dataset_errors(_examples(s, d), _chunks(s, d), ("document_id", "question_type", "split", "annotation_status"))


@query
def dataset_counts(s, d):
    return evaluation.dataset_counts(_examples(s, d))


# Mining and review


def _negatives(s, d, quotas=None):
    e, index = _examples(s, d), Bm25Index.build(_passages(s, d))
    rounded = lambda pairs: index.scored(pairs, _asked(e)).withColumn("score", F.round("score", 6))
    return mining.hard_negatives(e, index.search(_asked(e), 20, digits=6), _passages(s, d), 20, quotas=quotas, scored=rounded,
        first_on_pages=lambda wants: index.first_on_pages(wants, _asked(e), 6))


@query
def hard_negatives(s, d):
    return _negatives(s, d).drop("query").withColumn("negative_rank", _long("negative_rank"))


@query
def hard_negatives_quota(s, d):
    return _negatives(s, d, {"hard": 2, "medium": 1, "easy": 1}).drop("query").withColumn("negative_rank", _long("negative_rank"))


@query
def difficulty_counts(s, d):
    return mining.count_by(_negatives(s, d), "difficulty", mining.DIFFICULTIES)


@query
def review_counts(s, d):
    """Decisions of people on the questions, with those not taken at all."""
    e = _examples(s, d).select(F.coalesce("review_decision", F.lit("unreviewed")).alias("decision"))
    return mining.count_by(e, "decision", ("unreviewed", "verified", "needs_revision", "rejected"))


@query
def pair_conflicts(s, d):
    return mining.pair_rows(_negatives(s, d),
        _passages(s, d)).groupBy((F.col("low") == F.col("high")).alias("sound")).agg(F.count("*").alias("pairs"))


@query
def negative_pack(s, d):
    n = _negatives(s, d, {"hard": 1}).withColumn("idx", F.lit(0))
    return mining.negative_pack(n, _passages(s, d)).select("query_id", "positive_chunk_id", "negative_chunk_id",
        F.col("positive.document_id").alias("positive_document"), F.col("negative.document_id").alias("negative_document"))


@query
def review_pack(s, d):
    out = mining.review_pack(_examples(s, d), _chunks(s, d))
    return out.select("id", "document_id", F.col("page").cast("bigint").alias("page"), "missing", F.length("page_text").cast("bigint").alias("size"))


@query
def example_evidence(s, d):
    """Page chunks behind the questions, found by file name and page."""
    e = _examples(s, d).filter("courseware_source is not null").withColumnRenamed("courseware_source", "source_name")
    out = mining.example_evidence(e, _chunks(s, d))
    return out.select("id", "document_id", _long("documents"), F.size("chunk_ids").cast("bigint").alias("chunks"), _long("missing"))


@query
def pair_components(s, d):
    """Documents tied by common question sets."""
    e = _examples(s, d).filter("document_id is not null and pair_id is not null").select("document_id",
        F.lower(F.trim("pair_id")).alias("p")).distinct()
    low = e.groupBy("p").agg(F.min("document_id").alias("v"))
    c = graph.connected_components(e.join(low, "p"), "document_id", "v")
    return c.select(F.col("node").alias("document_id"), "component")
