"""Hard negatives, their review, and pairs for training a reranker."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slatework.functions.text import strip
from slatework.runtime import settled

DIFFICULTIES = ("hard", "medium", "easy")
DECISIONS = ("valid_negative", "false_negative", "uncertain", "pending")
REVIEW_SUMMARY = ("rows", *DECISIONS, "retained_triplets", "rejected_triplets", "difficulty_counts", "queries", "queries_retained")
FIELDS = ("query", "positive_chunk_id", "negative_chunk_id", "negative_rank", "miner", "difficulty")


def difficulty(rank):
    return F.when(rank <= 5, "hard").when(rank <= 10, "medium").otherwise("easy")


def positives(examples: DataFrame, chunks: DataFrame, anywhere: bool = True) -> DataFrame:
    """(query_id, chunk_id): labelled chunks that exist, and chunks that cover a labelled page (of any document if null).

    Without anywhere the pages of examples without a document are left out: they pair with chunks of all documents.
    """
    known = chunks.select("chunk_id").distinct()
    named = examples.select(F.col("id").alias("query_id"), F.explode("relevant_chunk_ids").alias("chunk_id")).join(known, "chunk_id")
    pages = chunks.select("chunk_id", "document_id", F.explode(F.sequence("page_start", "page_end")).alias("page"))
    wants = examples.select(F.col("id").alias("query_id"), "document_id", F.explode("relevant_pages").alias("page"))
    own = wants.filter("document_id is not null").join(pages, ["document_id", "page"]).select("query_id", "chunk_id")
    out = named.select("query_id", "chunk_id").unionByName(own)
    if anywhere:
        out = out.unionByName(wants.filter("document_id is null").drop("document_id").join(pages, "page").select("query_id", "chunk_id"))
    return out.distinct()


def hard_negatives(examples: DataFrame, ranked: DataFrame, chunks: DataFrame, top_k: int = 20, miner: str = "bm25",
        quotas: dict[str, int] | None = None,
                   scored: Callable[[DataFrame], DataFrame] | None = None,
                   first_on_pages: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Triplets (query_id and FIELDS) from the first top_k ranks; a difficulty without a quota is not limited.

    The representative positive is the one that a ranking of all chunks puts first, else the smallest id. scored
    gives the scores of (query_id, chunk_id) pairs, so that only positives need scores beyond top_k; without it,
    ranked must be a ranking of all chunks. first_on_pages gives, for (query_id, page), the best (query_id, chunk_id,
    score) of all chunks that cover such a page: with it, the chunks of all documents that are positives of an example
    without a document are never paired with it.
    """
    if quotas is not None and (set(quotas) - set(DIFFICULTIES) or min(quotas.values(), default=0) < 0):
        raise ValueError("quotas must be at least 0 and named hard, medium or easy")
    good = settled(positives(examples, chunks, first_on_pages is None))
    known = (ranked if scored is None else scored(good)).select("query_id", "chunk_id", "score")
    best = good.join(known, ["query_id", "chunk_id"], "left")
    shown = settled(ranked.filter(F.col("rank") <= top_k))
    bad = shown.join(good, ["query_id", "chunk_id"], "left_anti")
    if first_on_pages is not None:
        free = examples.filter("document_id is null and size(relevant_pages) > 0").select(F.col("id").alias("query_id"), "relevant_pages")
        wants = free.select("query_id", F.explode("relevant_pages").alias("page")).filter("page is not null").distinct()
        spans = chunks.select("chunk_id", "page_start", "page_end")
        least = spans.select("chunk_id", F.explode(F.sequence("page_start", "page_end")).alias("page")).groupBy("page").agg(F.min("chunk_id").alias("chunk_id"))
        best = best.unionByName(wants.join(least, "page").select("query_id", "chunk_id", F.lit(None).cast("double").alias("score")))
        best = best.unionByName(first_on_pages(wants).select("query_id", "chunk_id", "score"))
        inside = F.exists("relevant_pages", lambda p: F.array_contains(F.sequence("page_start", "page_end"), p))
        covered = shown.join(free, "query_id").join(spans, "chunk_id").filter(inside).select("query_id", "chunk_id")
        bad = bad.join(covered, ["query_id", "chunk_id"], "left_anti")
    best = best.groupBy("query_id").agg(F.coalesce(F.min_by("chunk_id",
        F.when(F.col("score").isNotNull(), F.struct(-F.col("score"), "chunk_id"))), F.min("chunk_id")).alias("positive_chunk_id"))
    bad = bad.join(best, "query_id").withColumn("difficulty", difficulty(F.col("rank")))
    if quotas:
        limit = F.lit(None).cast("int")
        for name, n in quotas.items():
            limit = F.when(F.col("difficulty") == name, n).otherwise(limit)
        bad = bad.withColumn("_n", F.row_number().over(Window.partitionBy("query_id",
            "difficulty").orderBy("rank"))).filter(limit.isNull() | (F.col("_n") <= limit)).drop("_n")
    asked = examples.select(F.col("id").alias("query_id"), "query")
    return bad.join(asked, "query_id").select("query_id", "query", "positive_chunk_id", F.col("chunk_id").alias("negative_chunk_id"),
        F.col("rank").alias("negative_rank"), F.lit(miner).alias("miner"), "difficulty")


def count_by(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """(column, rows) for every one of values, also those that do not occur."""
    full = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return F.broadcast(full).join(df.groupBy(column).agg(F.count("*").alias("rows")), column, "left").na.fill(0, ["rows"])


def apply_reviews(rows: DataFrame, require_complete: bool = True) -> tuple[DataFrame, DataFrame]:
    """(kept triplets, one row of REVIEW_SUMMARY figures); a blank decision is pending.

    ValueError for repeated ids (compared without outer white space), unknown decisions, accepted rows with empty
    fields, or an unfinished review.
    """
    decided = F.when(F.col("review_decision") == "", None).otherwise(F.col("review_decision"))
    d = rows.withColumns({"_d": F.coalesce(decided, F.lit("pending")), "_id": strip(F.col("review_id")), "_q": strip(F.coalesce("query", F.lit("")))})
    lack = F.exists(F.array(*[F.col(c).isNull() | (F.col(c).cast("string") == "") for c in FIELDS]), lambda x: x)
    kept = F.col("_d") == "valid_negative"
    seen = d.agg(F.count_if(~F.col("_d").isin(*DECISIONS)).alias("unknown"), F.count_if(kept & lack).alias("holes"),
        F.count_if(F.col("_d").isin("pending", "uncertain")).alias("open")).first()
    twice = d.filter("_id <> ''").groupBy("_id").agg(F.count("*").alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate review_id {twice[0]['_id']}")
    if seen["unknown"] or seen["holes"]:
        raise ValueError(f"{seen['unknown']} unknown decisions, {seen['holes']} accepted rows with empty fields")
    if require_complete and seen["open"]:
        raise ValueError(f"{seen['open']} rows are not decided")
    asked = F.when(F.col("_q") != "", F.col("_q"))
    levels = d.filter(kept).groupBy("difficulty").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("difficulty", "n")))).alias("difficulty_counts"))
    figures = d.agg(F.count("*").alias("rows"), *[F.count_if(F.col("_d") == x).alias(x) for x in DECISIONS],
        F.count_if(~kept).alias("rejected_triplets"), F.countDistinct(asked).alias("queries"),
        F.countDistinct(F.when(kept, asked)).alias("queries_retained"))
    figures = figures.withColumn("retained_triplets", F.col("valid_negative")).join(F.broadcast(levels))
    return d.filter(kept).select(*FIELDS), figures.select(*REVIEW_SUMMARY)


def pair_rows(triplets: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query, text, low, high): every distinct query and text with the range of its labels; low <> high is a conflict."""
    sides = F.array(F.struct(F.col("positive_chunk_id").alias("chunk_id"), F.lit(1.0).alias("label")),
        F.struct(F.col("negative_chunk_id").alias("chunk_id"), F.lit(0.0).alias("label")))
    long = triplets.select(strip(F.col("query")).alias("query"), F.explode(sides).alias("s")).select("query", "s.*")
    return long.join(chunks.select("chunk_id", "text"), "chunk_id").groupBy("query", "text").agg(F.min("label").alias("low"),
        F.max("label").alias("high"))


def reranker_pairs(triplets: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query, text, label); ValueError for empty fields, unknown chunks and a text that is both wanted and not."""
    blank = lambda c: F.length(strip(F.coalesce(c, F.lit("")))) == 0
    if triplets.filter(blank(F.col("query")) | blank(F.col("positive_chunk_id")) | blank(F.col("negative_chunk_id"))).limit(1).count():
        raise ValueError("a triplet lacks its query or a chunk")
    ids = triplets.select(F.explode(F.array("positive_chunk_id", "negative_chunk_id")).alias("chunk_id"))
    lost = ids.join(chunks, "chunk_id", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"unknown chunk {lost[0]['chunk_id']}")
    pairs = pair_rows(triplets, chunks)
    torn = pairs.filter("low <> high").limit(1).collect()
    if torn:
        raise ValueError(f"conflicting labels for query {torn[0]['query']!r}")
    return pairs.select("query", "text", F.col("low").alias("label"))


def training_steps(rows: int, batch_size: int, epochs: int) -> tuple[int, int]:
    """(steps, warm-up steps) of a cross-encoder run."""
    if rows < 1 or batch_size < 1 or epochs < 1:
        raise ValueError("rows, batch_size and epochs must be at least 1")
    steps = math.ceil(rows / batch_size) * epochs
    return steps, max(1, math.ceil(0.1 * steps))


def train_cross_encoder(pairs: DataFrame, model: str, out: str, *, epochs: int = 1, batch_size: int = 8, learning_rate: float = 2e-5,
        seed: int = 42, device: str | None = None,
                        local_files_only: bool = False, library=None) -> dict:
    """Train a pair model on the driver and save it, with its settings, in the folder out.

    The optional packages torch and sentence-transformers do the work (ImportError with a hint where they are missing);
    library stands in for them: (fit(rows, settings) -> saves a model). ValueError for no pairs and settings below 1.
    """
    if learning_rate <= 0:
        raise ValueError("learning_rate must be above 0")
    training_steps(1, batch_size, epochs)
    fit = library or _fit_cross_encoder()
    rows = [(r["query"], r["text"], float(r["label"])) for r in pairs.select("query", "text", "label").orderBy("query", "label",
        "text").toLocalIterator()]
    steps, warm = training_steps(len(rows), batch_size, epochs)
    settings = {"model": model, "pairs": len(rows), "batch_size": batch_size, "epochs": epochs, "learning_rate": learning_rate, "seed": seed,
        "training_steps": steps, "warmup_steps": warm, "output_dir": out,
                "device": device, "local_files_only": local_files_only}
    Path(out).mkdir(parents=True, exist_ok=True)
    settings["device"] = fit(rows, settings)
    Path(out, "training.json").write_text(json.dumps(settings, ensure_ascii=False, indent=2), encoding="utf-8")
    return settings


def _fit_cross_encoder():
    """fit(rows, settings) by the optional packages; gives back the device it ran on."""
    try:
        import random

        import sentence_transformers as st
        import torch
        from torch.utils.data import DataLoader
    except ImportError as e:
        raise ImportError("training needs the optional packages torch and sentence-transformers") from e

    def fit(rows: list[tuple[str, str, float]], settings: dict) -> str:
        random.seed(settings["seed"])
        order = torch.manual_seed(settings["seed"])
        network = st.CrossEncoder(settings["model"], num_labels=1, device=settings["device"], local_files_only=settings["local_files_only"])
        data = DataLoader([st.InputExample(texts=[q, t], label=x) for q, t, x in rows], batch_size=settings["batch_size"], shuffle=True,
            generator=order)
        run = getattr(network, "old_fit", network.fit)  # newer versions keep the loop over a loader under this name
        run(train_dataloader=data, epochs=settings["epochs"], warmup_steps=settings["warmup_steps"],
            optimizer_params={"lr": settings["learning_rate"]}, output_path=settings["output_dir"], save_best_model=False)
        network.save(settings["output_dir"])
        return str(network.device)

    return fit


def numbered(triplets: DataFrame) -> DataFrame:
    """triplets with idx from 0 without gaps, in the order they are read."""
    parted = settled(triplets.withColumns({"_m": F.monotonically_increasing_id(), "_p": F.spark_partition_id()}))
    sizes = parted.groupBy("_p").agg(F.count("*").alias("n"))
    before = sizes.select("_p", (F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0))).alias("_before"))
    own = F.col("_m") - F.shiftleft(F.col("_p").cast("bigint"), 33)
    return parted.join(F.broadcast(before), "_p").withColumn("idx", F.col("_before") + own).drop("_m", "_p", "_before")


def missing_chunks(triplets: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id) of the chunks that triplets name and the corpus lacks."""
    named = triplets.select(F.explode(F.array("positive_chunk_id", "negative_chunk_id")).alias("chunk_id")).distinct()
    return named.join(chunks.select("chunk_id"), "chunk_id", "left_anti")


def negative_pack(triplets: DataFrame, chunks: DataFrame) -> DataFrame:
    """Triplets (with ordinal idx from 0) joined to both chunks, as rows to review; a row that lacks a chunk is left out."""
    side = lambda n: chunks.select(F.col("chunk_id").alias(f"{n}_chunk_id"),
        F.struct("chunk_id", "document_id", "page_start", "page_end", "section", "text").alias(n))
    out = triplets.join(side("positive"), "positive_chunk_id").join(side("negative"), "negative_chunk_id")
    return out.withColumns({"review_id": F.format_string("negative-%04d", F.col("idx") + 1), "review_decision": F.lit("pending"),
        "review_note": F.lit("")})


def review_pack(examples: DataFrame, chunks: DataFrame, rendered: DataFrame | None = None) -> DataFrame:
    """Each example with the evidence pages to look at: source, text, image and whether the page exists."""
    pages = chunks.filter("level = 'page' and page_start = page_end").select("document_id", F.col("page_start").alias("page"),
        F.col("text").alias("page_text"), F.col("metadata.source_name").alias("source_name"))
    wants = examples.select("id", "query", "document_id", F.explode_outer(F.array_sort(F.array_distinct("relevant_pages"))).alias("page"))
    out = wants.join(pages.dropDuplicates(["document_id", "page"]), ["document_id", "page"], "left")
    if rendered is not None:
        out = out.join(rendered.select("document_id", F.col("page_number").alias("page"), "image_path").dropDuplicates(["document_id", "page"]),
            ["document_id", "page"], "left")
    return out.withColumn("missing", F.col("page_text").isNull())


def example_evidence(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, document_id, documents, chunk_ids, missing): page chunks behind candidates (id, source_name, relevant_pages).

    documents counts the documents that a source name leads to, missing the pages that have no chunk.
    """
    level = F.col("level") == "page"
    of_page = chunks.filter(level).select(F.col("metadata.source_name").alias("source_name"), F.col("page_start").alias("page"),
        F.col("document_id").alias("d"), "chunk_id")
    wants = candidates.select("id", "source_name", F.explode(F.array_distinct("relevant_pages")).alias("page"))
    found = wants.join(of_page, ["source_name", "page"], "left").groupBy("id")
    return found.agg(F.min("d").alias("document_id"), F.countDistinct("d").alias("documents"),
        F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"), F.count_if(F.col("d").isNull()).alias("missing"))


def build_examples(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """candidates with document_id, relevant_chunk_ids and pair_id (second part of the id); ValueError where evidence is missing or not unique."""
    found = example_evidence(candidates, chunks)
    bad = found.filter("missing > 0 or documents <> 1").orderBy("id").limit(1).collect()
    if bad:
        raise ValueError(f"example {bad[0]['id']}: {bad[0]['missing']} pages without a chunk, {bad[0]['documents']} documents")
    own = found.select("id", "document_id", F.col("chunk_ids").alias("relevant_chunk_ids"), F.get(F.split("id", "-"), F.lit(1)).alias("pair_id"))
    return candidates.drop("document_id", "relevant_chunk_ids", "pair_id").join(own, "id")


def render_summary(rendered: DataFrame) -> DataFrame:
    return rendered.agg(F.count("*").alias("pages"), F.count_if("requires_vision").alias("requires_vision"))


__all__ = ["apply_reviews", "build_examples", "count_by", "difficulty", "example_evidence", "hard_negatives", "missing_chunks", "negative_pack",
    "numbered", "pair_rows", "positives", "render_summary", "reranker_pairs", "review_pack", "train_cross_encoder", "training_steps"]
