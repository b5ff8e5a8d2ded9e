"""The queries of the nine problems, each over whole tables and whole texts with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatework.llm import crosssplit, groupsplit, ivfpq, leaks, mixing, neardup, quality, repeated_lines, split
from slatework.operators.dense import cosine_top_k, unit
from slatework.runtime import settled, table

PAGE_LIMIT, PASSAGE_LIMIT, OVERLAP = 2000, 500, 50
#: Vocabulary of the mixture's tokenizer; a parameter, read in place.
VOCABULARY = os.environ.get("SLATEWORK_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
PASSAGE = "level is null or level = 'passage'"


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines repeated within their source: in 5 documents and a fifth of the source's documents at least."""
    pages = table(spark, folder, "course_pages")
    return repeated_lines.flag_repeated_lines(pages, repeated_lines.find_repeated_lines(pages))


def _boilerplate(pages: DataFrame) -> DataFrame:
    """Repeated lines that stand in 5 different documents, republished ones being one, and came on 2 days at least."""
    return repeated_lines.find_repeated_lines(pages, min_clusters=5, min_days=2)


def p1_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    """Every page with its source's boilerplate lines taken out; the lines of a republished story stay."""
    pages = table(spark, folder, "course_pages")
    out = repeated_lines.strip_repeated_lines(pages.dropDuplicates(["document_id", "page_number"]), _boilerplate(pages))
    return out.select("document_id", F.col("page_number").cast("bigint").alias("page_number"), "text",
        F.col("n_removed").cast("bigint").alias("n_removed"))


def p1_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """How many lines of each source are boilerplate, and in how many clusters of documents and on how many days."""
    found = _boilerplate(table(spark, folder, "course_pages"))
    return found.groupBy("source", "n_source_documents").agg(F.count("*").alias("lines"), F.max("n_clusters").alias("most_clusters"),
        F.max("n_days").alias("most_days"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks one of which is among the 5 most similar others of the other, at cosine 0.85 or more."""
    near = ivfpq.most_similar(table(spark, folder, "chunk_embedding_cache"), min_similarity=0.85, recall=1.0)
    return near.select(F.least("id", "other").alias("chunk_id_a"), F.greatest("id", "other").alias("chunk_id_b")).distinct()


def p2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 most similar others of every usable vector, whatever their similarity."""
    return ivfpq.most_similar(table(spark, folder, "chunk_embedding_cache")).withColumnsRenamed({"id": "chunk_id", "other": "other_chunk_id"})


def p2_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Whether p2_neighbours holds 95 % of the true 5 nearest others of every 50th vector (by hash), against all rows."""
    v = ivfpq.usable(table(spark, folder, "chunk_embedding_cache"), "chunk_id", "embedding", 64).select("id",
        unit(F.col("embedding")).alias("embedding"))
    v = settled(v)
    asked = v.filter(F.pmod(F.xxhash64("id"), F.lit(50)) == 0).select(F.col("id").alias("query_id"), "embedding")
    line = Window.partitionBy("query_id").orderBy("rank")
    true = cosine_top_k(asked, v, 6, row_id="id", digits=6).filter("query_id <> id").withColumn("n", F.row_number().over(line)).filter("n <= 5")
    got = p2_neighbours(spark, folder).select(F.col("chunk_id").alias("query_id"), F.col("other_chunk_id").alias("id"), F.lit(1).alias("hit"))
    return true.join(got, ["query_id", "id"], "left").agg(F.lit(0.95).alias("wanted"),
        F.coalesce(F.avg(F.coalesce("hit", F.lit(0))) >= 0.95, F.lit(True)).alias("reached"))


def _oversized(spark: SparkSession, folder: str, with_text: bool) -> DataFrame:
    pages = table(spark, folder, "course_pages").withColumn("_item", F.concat_ws("#", "document_id", F.col("page_number").cast("string")))
    pages = pages.withColumns({"page_start": F.col("page_number"), "page_end": F.col("page_number")})
    chunks = table(spark, folder, "course_chunks").filter(PASSAGE)
    if with_text:  # one row of an item is cut; only oversized ones are exchanged for that
        pages = pages.filter(F.length("text") > PAGE_LIMIT).dropDuplicates(["_item"])
        chunks = chunks.filter(F.length("text") > PASSAGE_LIMIT).dropDuplicates(["chunk_id"])
    a = split.split_oversized(pages, "_item", "text", PAGE_LIMIT, OVERLAP, keep=("page_start", "page_end"),
        with_text=with_text).withColumn("item_kind", F.lit("page"))
    b = split.split_oversized(chunks, "chunk_id", "text", PASSAGE_LIMIT, OVERLAP, keep=("page_start", "page_end"),
        with_text=with_text).withColumn("item_kind", F.lit("chunk"))
    return a.unionByName(b)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """How each oversized page and passage is cut."""
    return _oversized(spark, folder, False).filter("piece_no = 1").select("item_kind", "item_id", F.col("item_cut").alias("cut")).distinct()


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces themselves, in order, with their place in the item and the pages they come from."""
    return _oversized(spark, folder, True)


def p3_token_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of more than 512 tokens of a public tokenizer, in pieces with 32 tokens of overlap."""
    pages = table(spark, folder, "course_pages").withColumn("_item", F.concat_ws("#", "document_id", F.col("page_number").cast("string")))
    pages = pages.filter(F.octet_length("text") > 512).dropDuplicates(["_item"])
    out = split.split_oversized(pages, "_item", "text", 512, 32, with_text=False, vocabulary=VOCABULARY)
    return out.select("item_id", "piece_no", "piece_start", "piece_end", "tokens", "overlap", "piece_cut")


def p3_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces that break a rule of p3_pieces: too long, too much overlap, a hole, another text than their place says, no end."""
    pieces = settled(p3_pieces(spark, folder))
    line = Window.partitionBy("item_kind", "item_id").orderBy("piece_no")
    limit = F.when(F.col("item_kind") == "page", PAGE_LIMIT).otherwise(PASSAGE_LIMIT)
    before = F.lag("piece_end").over(line)
    pages = table(spark, folder, "course_pages").select(F.lit("page").alias("item_kind"),
        F.concat_ws("#", "document_id", F.col("page_number").cast("string")).alias("item_id"), "text")
    items = pages.unionByName(table(spark, folder, "course_chunks").filter(PASSAGE).select(F.lit("chunk").alias("item_kind"),
        F.col("chunk_id").alias("item_id"), "text")).dropDuplicates(["item_kind", "item_id"])
    p = pieces.withColumns({"_before": before,
        "_last": F.lead("piece_no").over(line).isNull()}).join(items.filter(F.length("text") > PASSAGE_LIMIT), ["item_kind", "item_id"])
    wrong = [F.when(F.length("piece_text") > limit, "too long"), F.when(F.coalesce(F.col("_before") - F.col("piece_start"), F.lit(0)) > OVERLAP,
        "overlap"), F.when(F.col("piece_start") > F.coalesce("_before", F.lit(0)), "hole"),
             F.when(F.col("piece_text") != F.substr("text", (F.col("piece_start") + 1).cast("int"),
             (F.col("piece_end") - F.col("piece_start")).cast("int")), "other text"),
             F.when(F.col("_last") & (F.col("piece_end") != F.length("text")), "no end")]
    return p.select("item_kind", "item_id", F.explode(F.array_compact(F.array(*wrong))).alias("fault"))


def _passage_links(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return neardup.similar_texts(table(spark, folder, "course_chunks").filter(PASSAGE), "chunk_id", "text", min_weighted=0.54, exact_min=0.6)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of passages that are the same but for small edits."""
    return neardup.record_pairs(*_passage_links(spark, folder)).select(F.col("record_a").alias("chunk_id_a"), F.col("record_b").alias("chunk_id_b"))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each passage with such a partner: its group, its number of linked other texts, and copies."""
    links, members = _passage_links(spark, folder)
    return neardup.record_groups(settled(links), settled(members)).withColumnRenamed("record_id", "chunk_id")


def p4_page_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The pages of those groups: one row per group and page."""
    chunks = table(spark, folder, "course_chunks").filter(PASSAGE).select("chunk_id", "document_id",
        F.explode(F.sequence(F.col("page_start").cast("bigint"), F.col("page_end").cast("bigint"))).alias("page_number")).distinct()
    pages = p4_groups(spark, folder).join(chunks, "chunk_id").groupBy("group_id", "document_id", "page_number")
    return pages.agg(F.countDistinct("chunk_id").alias("passages"))


def _split_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    return crosssplit.cross_split_pairs(table(spark, folder, "public_course_eval_reviewed"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Questions of dev or test that stand, exactly or almost, in train."""
    return _split_overlaps(spark, folder).select(F.least("eval_id", "train_id").alias("id_a"),
        F.greatest("eval_id", "train_id").alias("id_b")).distinct()


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """How many questions of each split and source overlap with train, and in how many pairs."""
    pairs = _split_overlaps(spark, folder)
    about = table(spark, folder, "public_course_eval_reviewed").dropDuplicates(["id"]).select(F.col("id").alias("eval_id"),
        F.col("courseware_source").alias("source"))
    by = pairs.join(about, "eval_id").groupBy(F.col("eval_split").alias("split"), "source")
    return by.agg(F.countDistinct("eval_id").alias("questions"), F.count("*").alias("pairs"), F.count("similarity").alias("by_text"),
        F.count_if("same_pages").alias("by_pages"), F.max("containment").alias("most_contained"))


def _question_groups(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "public_course_eval_reviewed")
    keys = {"document": F.when(F.trim("document_id") != "", F.col("document_id")), "pair": crosssplit.clean_name(F.col("pair_id"))}
    return rows, settled(groupsplit.components(rows, "id", keys))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The questions of every group of tied questions that now stands in more than one split."""
    rows, groups = _question_groups(spark, folder)
    now = rows.select("id", crosssplit.clean_name(F.col("split")).alias("split"))
    torn = groups.join(now, "id").groupBy("group_id").agg(F.min("split").alias("low"),
        F.max("split").alias("high")).filter("low <> high").select("group_id")
    return groups.join(torn, "group_id").select("group_id", "id")


def p6_assigned(spark: SparkSession, folder: str) -> DataFrame:
    """A split for every question, 8 to 1 to 1, with tied questions together."""
    _, groups = _question_groups(spark, folder)
    return groupsplit.assign_splits(groups, {"train": 0.8, "dev": 0.1, "test": 0.1})


def p6_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Questions and keys that break a rule of p6_assigned: no split or several, or a shared key in several splits."""
    rows = table(spark, folder, "public_course_eval_reviewed").select("id", "document_id", "pair_id").dropDuplicates(["id"])
    got = settled(p6_assigned(spark, folder))
    each = rows.select("id").join(got, "id",
        "left").groupBy("id").agg(F.count("split").alias("n")).filter("n <> 1").select(F.lit("question").alias("kind"), F.col("id").alias("key"))
    for kind, key in (("document", F.when(F.trim("document_id") != "", F.col("document_id"))), ("pair", crosssplit.clean_name(F.col("pair_id")))):
        torn = rows.select("id", key.alias("key")).filter("key is not null").join(got.select("id", "split"),
            "id").groupBy("key").agg(F.min("split").alias("a"), F.max("split").alias("b")).filter("a <> b")
        each = each.unionByName(torn.select(F.lit(kind).alias("kind"), "key"))
    return each


def p6_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Questions, groups and share of each split of p6_assigned."""
    by = p6_assigned(spark, folder).groupBy("split").agg(F.count("*").alias("questions"), F.countDistinct("group_id").alias("groups"))
    total = by.agg(F.sum("questions").alias("total"))
    return by.join(F.broadcast(total)).select("split", "questions", "groups", (F.col("questions") / F.col("total")).alias("share"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold at least 12 consecutive words of a held-out item."""
    found = leaks.find_leaks(table(spark, folder, "documents"), table(spark, folder, "heldout_items"), min_tile=12, min_longest=12)
    return found.select("doc_id", "item_id").distinct()


def p7_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose tiles of 5 words and more cover half of an item, in whatever order."""
    return leaks.find_leaks(table(spark, folder, "documents"), table(spark, folder, "heldout_items"), min_tile=5,
        min_coverage=0.5).dropDuplicates(["doc_id", "item_id"])


def _mixture(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix_sources(mixing.token_counts(table(spark, folder, "documents"), VOCABULARY), table(spark, folder, "mix_targets"))


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture: documents and how often each is used."""
    return _mixture(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of every source of mix_targets in the mixture."""
    return _mixture(spark, folder)[1]


def p8_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that break a rule of the mixture: too many repeats, or a share off its target (of the sources with documents).

    Documents are never cut, so a share may be off by 0.01 or by the largest documents of the mixture's sources.
    """
    mixture, shares = _mixture(spark, folder)
    caps = table(spark, folder, "mix_targets").groupBy("source").agg(F.max("max_repeats").alias("cap"))
    repeats = mixture.join(F.broadcast(caps), "source", "left").filter(F.coalesce(F.col("repeats") > F.col("cap"), F.lit(True)))
    whole = shares.filter("documents > 0").agg(F.sum("target_share").alias("whole"), F.sum("mixed_tokens").alias("all"))
    grain = mixture.groupBy("source").agg(F.max("n_tokens").alias("n")).agg(F.sum("n").alias("grain"))
    want = F.when(F.col("documents") > 0, F.col("target_share") / F.col("whole")).otherwise(0.0)
    least = F.greatest(F.lit(0.01), F.coalesce(F.col("grain") / F.col("all"), F.lit(0.0)))
    off = shares.join(F.broadcast(whole)).join(F.broadcast(grain)).filter(F.abs(F.col("actual_share") - want) > least)
    each = repeats.select("source", F.lit("repeats").alias("fault")).distinct()
    return each.unionByName(off.select("source", F.lit("share").alias("fault")))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents most of whose characters are list entries, table cells or junk."""
    return quality.find_junk(*quality.judge(table(spark, folder, "documents"), table(spark, folder, "doc_labels"))).select("doc_id").distinct()


def p9_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's statistics, distance from prose and each statistic's part in it."""
    scored, _ = quality.judge(table(spark, folder, "documents"), table(spark, folder, "doc_labels"))
    return scored


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}
