"""Command line: each command is a thin composition of operators (see --help of each)."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatework import schemas
from slatework.operators import chunking, dense, evaluation, fusion, mining, pages
from slatework.operators.sparse import Bm25Index
from slatework.runtime import settled
from slatework.sources import downloads, readers, rendering, sinks

REQUIRED = ("document_id", "question_type", "split", "annotation_status")


def say(value) -> None:
    print(json.dumps(value, ensure_ascii=False, indent=2, default=str))


def load(name: str):
    """An injected model, named module:attribute."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def corpus(s: SparkSession, a) -> DataFrame:
    return readers.read_chunks(s, a.chunks)


def at_levels(c: DataFrame, a) -> DataFrame:
    return pages.at_levels(c, *a.levels.split(",")) if a.levels else c


def examples(s: SparkSession, a, chunks: DataFrame | None = None, strict: bool | None = None) -> DataFrame:
    """The labelled queries of a split, after the whole set was checked against the unfiltered corpus."""
    e = readers.read_jsonl(s, a.dataset, schemas.EXAMPLE)
    strict = getattr(a, "strict", False) if strict is None else strict
    evaluation.validate(e, chunks, REQUIRED if strict else ())
    return pages.of_split(e, a.split) if getattr(a, "split", None) else e


def asked(e: DataFrame) -> DataFrame:
    return e.select(F.col("id").alias("query_id"), "query")


def queries_of(s: SparkSession, a) -> DataFrame:
    return s.createDataFrame([("query", a.query)], "query_id string, query string")


def vectors(s: SparkSession, a, c: DataFrame) -> DataFrame:
    return dense.load_cache(c, s.read.parquet(a.embeddings), a.model_name)


def query_vectors(e: DataFrame, a) -> DataFrame:
    """Vectors of the queries, with the prefix that the cache was made for unless another one is asked for."""
    prefix = a.query_prefix
    if prefix is None:
        prefix = dense.cache_header(e.sparkSession.read.parquet(a.embeddings), dense.CHUNK_CACHE).get("query_prefix", "query: ")
    return dense.checked_unit(dense.encoded(asked(e), "query", load(a.encoder), prefix), "embedding").select("query_id", "embedding")


def dense_ranked(s: SparkSession, a, e: DataFrame, c: DataFrame, k: int) -> DataFrame:
    return dense.dense_search(query_vectors(e, a), vectors(s, a, c), k)


def weights(text: str | None) -> dict[str, float] | None:
    return {k: float(v) for k, v in (x.split("=") for x in text.split(","))} if text else None


def reported(a, name: str, e: DataFrame, hits: DataFrame, diagnostics: DataFrame | None = None, by_page: bool = False) -> None:
    """Measures of a ranking. All queries are searched in one job, so each has the job's time over their number as its latency."""
    began, hits = time.time(), settled(hits)
    m = evaluation.query_metrics(e, hits, a.top_k, pages=by_page)
    each = 1000 * (time.time() - began) / max(1, e.count())
    head = {"name": name, "top_k": a.top_k, "split": a.split, "generated_at": time.strftime("%Y-%m-%dT%H:%M:%S+00:00", time.gmtime())}
    counts = rows(evaluation.dataset_counts(e).filter("field <> 'document_id'")) + rows(e.agg(F.lit("documents").alias("field"),
        F.lit("distinct").alias("value"), F.countDistinct("document_id").alias("examples")))
    say(sinks.report(head, {"path": a.dataset, "counts": counts}, evaluation.summary(m.withColumn("latency_ms", F.lit(each)), "latency_ms"),
        a.output, diagnostics))


def ingest(s, a):
    """Pages of PDF and PPTX files are cleaned and judged; those of text files are neither, unless --clean asks for it."""
    p = readers.read_course_files(s, *a.paths, clean=True if a.clean else False if a.plain else None)
    c = chunking.chunk_pages(p, a.max_chars, a.overlap, a.max_section_chars).cache()
    bad = chunking.hierarchy_errors(c).limit(5).collect()
    if bad:
        raise ValueError(f"broken hierarchy: {bad}")
    sinks.write_jsonl(c, a.output)
    per = c.groupBy("document_id").agg(F.count_if(F.col("level") == "page").alias("pages"), F.count("*").alias("chunks"))
    sinks.write_jsonl(per, f"{a.output}.documents")
    say({"levels": rows(mining.count_by(c, "level", schemas.LEVELS)), "documents": per.count(), "documents_output": f"{a.output}.documents",
        "output": a.output})


def inspect(s, a):
    """A report line per document, as JSON lines, one after another."""
    p = readers.read_course_files(s, *a.paths)
    if a.output:
        sinks.write_jsonl(p, a.output)
    for r in pages.parse_report(p, a.low_text).toLocalIterator():
        print(json.dumps(r.asDict(recursive=True), ensure_ascii=False, default=str))


def render_pages(s, a):
    """Page images and their manifest; judged by the page preparation of the same files where their parsers are installed."""
    judged = pages.prepare_pages(readers.read_course_files(s, *a.paths, clean=False)) if a.judge else None
    converters = [load(n) for n in a.converter] if a.converter else (rendering.by_poppler, rendering.by_mupdf)
    out = settled(rendering.rendered_pages(s, a.paths, a.output, a.dpi, converters, judged=judged))
    sinks.write_jsonl(out, f"{a.output}/manifest")
    say(mining.render_summary(out).first().asDict() | {"manifest": f"{a.output}/manifest"})


def download(s, a):
    """The files of a source manifest (JSON with sources), and a report of them."""
    known = s.read.option("multiLine", True).schema(schemas.MANIFEST).json(a.manifest)
    got = downloads.downloaded(known.select(F.explode("sources").alias("x")).select("x.*"), a.root, load(a.fetch) if a.fetch else downloads.by_http)
    sinks.write_jsonl(got, f"{a.root}/download_report")
    done = s.read.json(f"{a.root}/download_report")
    say(done.agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes")).first().asDict() | {"report": f"{a.root}/download_report"})


def visual_index(s, a):
    p = readers.read_page_manifests(s, *a.pages)
    out = dense.page_cache_rows(dense.encoded(p, "image_path", load(a.encoder), "", a.batch_size), a.model_name)
    sinks.write_table(out, a.output)
    say({"pages": out.count(), "output": a.output})


def page_vectors(s, a, only_vision=False) -> DataFrame:
    p = readers.read_page_manifests(s, *a.pages)
    return dense.load_page_cache(pages.only_vision(p) if only_vision else p, s.read.parquet(a.page_embeddings), a.model_name)


def visual_search(s, a):
    q = dense.checked_unit(dense.encoded(queries_of(s, a), "query", load(a.encoder), ""), "embedding").select("query_id", "embedding")
    say(rows(dense.visual_search(q, page_vectors(s, a, a.only_vision), a.top_k).orderBy("rank")))


def visual_evaluate(s, a):
    e = examples(s, a)
    q = dense.checked_unit(dense.encoded(asked(e), "query", load(a.encoder), ""), "embedding").select("query_id", "embedding")
    reported(a, "visual", e, evaluation.page_hits(e, dense.visual_search(q, page_vectors(s, a), a.top_k)), by_page=True)


def hybrid_evaluate(s, a):
    c = corpus(s, a)
    e, p, own = examples(s, a, c), readers.read_page_manifests(s, *a.pages), at_levels(c, a)
    text = fusion.to_pages(Bm25Index.build(own).search(asked(e), a.candidate_k), own, p, a.candidate_k, a.candidate_k)
    q = dense.checked_unit(dense.encoded(asked(e), "query", load(a.encoder), ""), "embedding").select("query_id", "embedding")
    visual = dense.visual_search(q, page_vectors(s, a), a.candidate_k)
    keys = ["document_id", "page_number"]
    fused = fusion.fuse({"bm25": text, "visual": visual}, keys, max(a.top_k, 10), weights(a.weights), a.rrf_k, a.candidate_k)
    systems = {n: evaluation.page_hits(e, r) for n, r in (("bm25", text), ("visual", visual), ("hybrid", fused))}
    reported(a, "hybrid", e, systems["hybrid"], evaluation.compare(e, systems, keys), by_page=True)


def dense_index(s, a):
    c = at_levels(corpus(s, a), a)
    out = dense.cache_rows(dense.encoded(c, "text", load(a.encoder), a.document_prefix, a.batch_size), a.model_name,
        "query: " if a.query_prefix is None else a.query_prefix, a.document_prefix)
    sinks.write_table(out, a.output)
    say({"chunks": out.count(), "model": a.model_name, "output": a.output})


def dense_evaluate(s, a):
    c = corpus(s, a)
    e, own = examples(s, a, c), at_levels(c, a)
    reported(a, "dense", e, evaluation.chunk_hits(e, dense_ranked(s, a, e, own, a.top_k), own))


def text_hybrid_evaluate(s, a):
    c = corpus(s, a)
    e, own = examples(s, a, c), at_levels(c, a)
    text, near = Bm25Index.build(own).search(asked(e), a.candidate_k), dense_ranked(s, a, e, own, a.candidate_k)
    fused = fusion.fuse({"bm25": text, "dense": near}, ["chunk_id"], max(a.top_k, 10), weights(a.weights), a.rrf_k, a.candidate_k)
    systems = {n: evaluation.chunk_hits(e, r, own) for n, r in (("bm25", text), ("dense", near), ("hybrid", fused))}
    reported(a, "text-hybrid", e, systems["hybrid"], evaluation.compare(e, systems, ["chunk_id"]))


def search(s, a):
    c = at_levels(corpus(s, a), a)
    found = Bm25Index.build(c).search(queries_of(s, a), a.top_k)
    say(rows(found.join(c.select("chunk_id", "document_id", "page_start", "page_end", "section", "text"), "chunk_id").orderBy("rank")))


def evaluate(s, a):
    c = corpus(s, a)
    e, own = examples(s, a, c), at_levels(c, a)
    reported(a, "bm25", e, evaluation.chunk_hits(e, Bm25Index.build(own).search(asked(e), a.top_k), own))


def validate_dataset(s, a):
    for r in evaluation.validate(readers.read_jsonl(s, a.dataset, schemas.EXAMPLE), corpus(s, a) if a.chunks else None,
            REQUIRED if a.strict else ()).orderBy("field", "value").toLocalIterator():
        print(json.dumps(r.asDict(), ensure_ascii=False))


def build_review_pack(s, a):
    c = corpus(s, a)
    e = examples(s, a, c, True)
    rendered = readers.read_page_manifests(s, *a.pages) if a.pages else None
    pack = settled(mining.review_pack(e, c, rendered).orderBy("id", "page"))
    known = pack if "image_path" in pack.columns else pack.withColumn("image_path", F.lit(None).cast("string"))
    images, lost = sinks.copied_images(known, f"{a.output.removesuffix('.html')}_assets")
    done = sinks.write_review_page(pack, a.output, "Questions", ("unreviewed", "verified", "needs_revision", "rejected"), images)
    say(done | {"examples": e.count(), "evidence_pages": pack.filter("page is not null").count(), "copied_images": len(images),
        "missing_images": lost})


def mine_negatives(s, a):
    c = at_levels(corpus(s, a), a)
    e = readers.read_jsonl(s, a.dataset, schemas.EXAMPLE)
    index = Bm25Index.build(c)
    out = mining.hard_negatives(e, index.search(asked(e), a.top_k), c, a.top_k,
        scored=lambda pairs: index.scored(pairs, asked(e)),
        first_on_pages=lambda wants: index.first_on_pages(wants, asked(e))).select(*mining.FIELDS)
    sinks.write_jsonl(out, a.output)
    say({"triplets": out.count(), "output": a.output})


def dense_mine_negatives(s, a):
    c = corpus(s, a)
    e, own = examples(s, a, c, True), at_levels(c, a)
    quotas = {k: int(v) for k, v in weights(a.quotas).items()} if a.quotas else None
    asked_for, held = query_vectors(e, a), vectors(s, a, own)
    out = mining.hard_negatives(e, dense.dense_search(asked_for, held, a.top_k), own, a.top_k, f"dense:{a.model_name}", quotas,
        lambda pairs: dense.pair_scores(pairs, asked_for, held)).select(*mining.FIELDS)
    sinks.write_jsonl(out, a.output)
    say({"difficulties": rows(mining.count_by(out, "difficulty", mining.DIFFICULTIES)), "output": a.output})


def build_negative_review_pack(s, a):
    t, c = settled(mining.numbered(readers.read_jsonl(s, a.triplets, schemas.TRIPLET))), corpus(s, a)
    pack = settled(mining.negative_pack(t, c))
    lost = mining.missing_chunks(t, c)
    sinks.write_jsonl(lost, f"{a.output}.missing_chunks")
    done = sinks.write_review_page(pack.orderBy("idx").drop("idx"), a.output, "Negatives", mining.DECISIONS)
    levels = {r["difficulty"]: r["n"] for r in pack.groupBy(F.coalesce("difficulty",
        F.lit("unlabeled")).alias("difficulty")).agg(F.count("*").alias("n")).collect()}
    say(done | {"triplets": t.count(), "reviewable": done["rows"], "missing_chunks": lost.count(),
        "missing_chunks_output": f"{a.output}.missing_chunks", "difficulties": levels})


def apply_negative_reviews(s, a):
    schema = schemas.REVIEWED
    kept, counts = mining.apply_reviews(readers.read_jsonl(s, a.reviews, schema), not a.allow_incomplete)
    sinks.write_jsonl(kept, a.output)
    say(rows(counts)[0] | {"output": a.output})


def train_reranker(s, a):
    pairs = mining.reranker_pairs(readers.read_jsonl(s, a.triplets, schemas.TRIPLET), corpus(s, a))
    say(mining.train_cross_encoder(pairs, a.model, a.output, epochs=a.epochs, batch_size=a.batch_size, learning_rate=a.learning_rate, seed=a.seed,
        device=a.device, local_files_only=a.local_files_only, library=load(a.library)() if a.library else None))


def reranker_evaluate(s, a):
    c = corpus(s, a)
    e, own = examples(s, a, c, True), at_levels(c, a)
    found = dense_ranked(s, a, e, own, max(a.top_k, a.candidate_k)).join(own.select("chunk_id", "text"), "chunk_id").join(asked(e), "query_id")
    scored = fusion.scored_pairs(found, load(a.reranker)).drop("text", "query")
    reported(a, "reranked", e, evaluation.chunk_hits(e, fusion.reranked(scored, "second", a.top_k), own))


C, D = [("--chunks", {"required": True})], [("--dataset", {"required": True}), ("--split", {}), ("--strict", {"action": "store_true"})]
K, L, O = [("--top-k", {"type": int, "default": 5})], [("--levels", {"default": "passage"})], [("--output", {})]
OUT, PATHS, PAGES = [("--output", {"required": True})], [("paths", {"nargs": "+"})], [("--pages", {"nargs": "+", "required": True})]
ENC = [("--encoder", {"required": True, "help": "module:function that loads a text encoder"}), ("--model-name", {"default": "encoder"}),
    ("--query-prefix", {"help": "as the cache says unless given"}), ("--document-prefix", {"default": "passage: "}),
    ("--batch-size", {"type": int, "default": 32})]
VEC, PVEC = [("--embeddings", {"required": True})], [("--page-embeddings", {"required": True})]
RRF = [("--weights", {"help": "name=weight,..."}), ("--rrf-k", {"type": int, "default": 60}), ("--candidate-k", {"type": int, "default": 50})]
CHUNKING = [("--max-chars", {"type": int, "default": 500}), ("--overlap", {"type": int, "default": 1}),
    ("--max-section-chars", {"type": int, "default": 2000}), ("--clean", {"action": "store_true"}),
    ("--plain", {"action": "store_true", "help": "do not judge page quality"})]
COMMANDS = {
    "ingest": (ingest, PATHS + OUT + CHUNKING), "ingest-corpus": (ingest, PATHS + OUT + CHUNKING),
    "inspect": (inspect, PATHS + O + [("--low-text", {"type": int, "default": 40})]),
    "render-pages": (render_pages, PATHS + OUT + [("--dpi", {"type": int, "default": 144}),
    ("--converter", {"nargs": "*", "help": "module:function, tried in order"}),
    ("--judge", {"action": "store_true", "help": "parse the files and judge their pages"})]),
    "download": (download, [("manifest", {}), ("--root", {"required": True}),
    ("--fetch", {"help": "module:function (url) -> (content, content type)"})]),
    "visual-search": (visual_search, PAGES + PVEC + ENC + K + [("--query", {"required": True}), ("--only-vision", {"action": "store_true"})]),
    "visual-index": (visual_index, PAGES + ENC + OUT), "visual-evaluate": (visual_evaluate, PAGES + PVEC + ENC + D + K + O),
    "hybrid-evaluate": (hybrid_evaluate, C + L + PAGES + PVEC + ENC + D + K + O + RRF),
    "dense-index": (dense_index, C + L + ENC + OUT), "dense-evaluate": (dense_evaluate, C + L + VEC + ENC + D + K + O),
    "text-hybrid-evaluate": (text_hybrid_evaluate, C + L + VEC + ENC + D + K + O + RRF),
    "search": (search, C + K + [("--query", {"required": True}), ("--levels", {"default": ""})]),
    "evaluate": (evaluate, C + D + K + O + [("--levels", {"default": ""})]),
    "validate-dataset": (validate_dataset, [("--chunks", {}), ("--dataset", {"required": True}), ("--strict", {"action": "store_true"})]),
    "build-review-pack": (build_review_pack, C + D + OUT + [("--pages", {"nargs": "*"})]),
    "mine-negatives": (mine_negatives, C + OUT + [("--dataset", {"required": True}), ("--top-k", {"type": int, "default": 20}),
    ("--levels", {"default": ""})]),
    "dense-mine-negatives": (dense_mine_negatives, C + L + VEC + ENC + OUT + [("--dataset", {"required": True}), ("--split", {"default": "train"}),
    ("--top-k", {"type": int, "default": 20}), ("--quotas", {"help": "hard=2,medium=1,easy=1"})]),
    "build-negative-review-pack": (build_negative_review_pack, C + OUT + [("--triplets", {"required": True})]),
    "apply-negative-reviews": (apply_negative_reviews, OUT + [("--reviews", {"required": True}), ("--allow-incomplete", {"action": "store_true"})]),
    "train-reranker": (train_reranker, C + OUT + [("--triplets", {"required": True}), ("--model", {"required": True}),
    ("--epochs", {"type": int, "default": 1}), ("--batch-size", {"type": int, "default": 8}), ("--learning-rate", {"type": float, "default": 2e-5}),
    ("--seed", {"type": int, "default": 42}), ("--device", {}), ("--local-files-only", {"action": "store_true"}),
    ("--library", {"help": "module:function that stands in for the training library"})]),
    "reranker-evaluate": (reranker_evaluate, C + L + VEC + ENC + K + O + [("--dataset", {"required": True}), ("--split", {"default": "dev"}),
    ("--reranker", {"required": True}), ("--candidate-k", {"type": int, "default": 20})]),
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="slatework", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, options) in COMMANDS.items():
        sub = commands.add_parser(name)
        for flag, known in options:
            sub.add_argument(flag, **known)
    a = parser.parse_args(argv)
    s = spark or SparkSession.builder.appName("slatework").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        COMMANDS[a.command][0](s, a)
    except (ValueError, ImportError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
