"""Section, page and passage chunks of prepared pages, and the check of their hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slatework.functions import text as X
from slatework.runtime import settled


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, name: str, width: int = 4096) -> DataFrame:
    """df with name: the sum of value over the rows of the same keys before it by order (numbers).

    In two levels: sums of stretches of width, then rows within their stretch, so no task holds the rows of a hot key.
    """
    cut = df.withColumn("_stretch", F.floor(F.col(order) / width))
    per = cut.groupBy(*keys, "_stretch").agg(F.sum(value).alias("_sum"))
    line = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_stretch").alias("_of_stretch"),
        F.coalesce(F.sum("_sum").over(line), F.lit(0)).alias("_earlier"))
    same = F.col("_stretch") == F.col("_of_stretch")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    inner = Window.partitionBy(*keys, "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(per, same)
    return out.withColumn(name, F.col("_earlier") + F.col("_inner")).drop("_stretch", "_inner", "_earlier", "_of_stretch",
        *[f"_of_{k}" for k in keys])


def sections(pages: DataFrame) -> DataFrame:
    """pages with section_no (from 1), section (its title) and section_page: a running sum of starts within each document.

    The first page of a document starts none. Sums and first pages are combined before they are exchanged; no task
    holds the pages of a hot document.
    """
    broken = F.coalesce(F.col("section_break"), F.lit(False)) if "section_break" in pages.columns else F.lit(False)
    p = pages.withColumn("_head", X.heading(F.col("title"), F.coalesce("text", F.lit(""))))
    p = settled(p.withColumn("_start", (broken | X.starts_section(F.col("_head"))).cast("int")))
    first = p.groupBy(F.col("document_id").alias("_doc")).agg(F.min("page_number").alias("_first"))
    p = p.join(first, F.col("document_id").eqNullSafe(F.col("_doc"))).withColumn("_start",
        F.when(F.col("page_number") > F.col("_first"), F.col("_start")).otherwise(0)).drop("_doc", "_first")
    p = running_sum(p, ["document_id"], "page_number", "_start", "_before").withColumn("section_no",
        (F.col("_before") + F.col("_start") + 1).cast("int"))
    head = p.groupBy(F.col("document_id").alias("_doc"), F.col("section_no").alias("_no")).agg(F.min_by(F.coalesce("_head", F.lit("")),
        "page_number").alias("_title"), F.min("page_number").alias("section_page"))
    p = p.join(head, F.col("document_id").eqNullSafe(F.col("_doc")) & (F.col("section_no") == F.col("_no")))
    other = F.when(F.col("section_no") == 1, F.col("document_id")).otherwise(F.concat(F.lit("Section "), F.col("section_no").cast("string")))
    return p.withColumn("section", F.coalesce(F.nullif("_title", F.lit("")), other)).drop("_head", "_start", "_before", "_doc", "_no", "_title")


def chunk_pages(pages: DataFrame, max_chars: int = 500, overlap_sentences: int = 1, max_section_chars: int = 2000) -> DataFrame:
    """Chunks of all three levels (CHUNK columns) of prepared pages.

    Pages are cut into windows once; the three levels read that. Of a section's pages only the texts that can reach
    into its first max_section_chars characters are gathered.
    """
    p = sections(pages)
    out_flag = F.coalesce(F.col("text_retrieval_excluded"), F.lit(False)) if "text_retrieval_excluded" in pages.columns else F.lit(False)
    text = F.coalesce("text", F.lit(""))
    p = p.withColumns({"_excluded": out_flag, "_text": text, "_sec": X.stable_id("sec", F.col("document_id"), F.col("section_page"),
        F.col("section")), "_page": X.stable_id("page", F.col("document_id"), F.col("page_number"))})
    p = p.withColumn("_win", F.when(F.col("_excluded"), F.array().cast("array<string>")).otherwise(X.windows(X.sentences(F.col("_text")), max_chars,
        overlap_sentences)))
    p = p.withColumn("_ids", F.transform("_win", lambda w, i: X.stable_id("chk", F.col("document_id"), F.col("page_number"), i, w)))
    solid = F.when(p["_excluded"], 0).otherwise(F.length(X.strip(p["_text"])))
    p = running_sum(p.withColumn("_solid", solid), ["document_id", "section_no"], "page_number", "_solid", "_before")
    p = settled(p.select("document_id", "page_number", "title", "section", "_excluded", "_text", "_sec", "_page", "_win", "_ids", "_solid",
        "_before", F.col("metadata.source_name").alias("_source")))
    none = F.lit(None)

    def meta(**known):
        kinds = {"source_name": "string", "source_title": "string", "window": "int", "page_count": "int", "retrievable_page_count": "int",
            "truncated": "boolean", "text_retrieval_excluded": "boolean"}
        return F.struct(*[known.get(k, none).cast(t).alias(k) for k, t in kinds.items()])

    source, good = F.col("_source"), F.col("_solid") > 0
    per = p.groupBy("document_id", "_sec", "section").agg(
        F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end"), F.count("*").alias("n"), F.count_if(good).alias("good"),
        F.min_by(source, "page_number").alias("source"),
        F.array_sort(F.collect_list(F.struct("page_number", "_page", F.when(good & (F.col("_before") <= max_section_chars),
        F.col("_text")).alias("t")))).alias("all"))
    body = F.array_join(F.array_compact(F.transform("all", lambda x: x["t"])), "\n\n")
    full = X.strip(F.concat(F.col("section"), F.lit("\n"), body))
    no_ids = F.array().cast("array<string>")
    section_rows = per.withColumn("full", full).select(
        F.col("_sec").alias("chunk_id"), "document_id", "page_start", "page_end", X.truncated(F.col("full"), max_section_chars).alias("text"),
        "section", none.cast("string").alias("parent_id"),
        F.lit("section").alias("level"), F.transform("all", lambda x: x["_page"]).alias("child_ids"),
        meta(source_name=F.col("source"), page_count=F.col("n"), retrievable_page_count=F.col("good"),
        truncated=F.length("full") > max_section_chars).alias("metadata"))
    ends = [F.col("page_number").alias("page_start"), F.col("page_number").alias("page_end")]
    page_rows = p.select(F.col("_page").alias("chunk_id"), "document_id", *ends, F.col("_text").alias("text"), "section",
        F.col("_sec").alias("parent_id"), F.lit("page").alias("level"), F.col("_ids").alias("child_ids"),
                         meta(source_name=source, source_title=F.col("title"),
                         text_retrieval_excluded=F.col("_excluded")).alias("metadata"))
    passage_rows = p.select("*", F.posexplode(F.arrays_zip(F.col("_ids").alias("id"), F.col("_win").alias("t"))).alias("w", "x")).select(
        F.col("x.id").alias("chunk_id"), "document_id", *ends, F.col("x.t").alias("text"), "section", F.col("_page").alias("parent_id"),
        F.lit("passage").alias("level"), no_ids.alias("child_ids"),
        meta(source_name=source, source_title=F.col("title"), window=F.col("w")).alias("metadata"))
    return section_rows.unionByName(page_rows).unionByName(passage_rows)


def hierarchy_errors(chunks: DataFrame) -> DataFrame:
    """(chunk_id, error) of every broken link; empty if the hierarchy is sound. Of a parent's faults the first is told."""
    c = chunks.select("chunk_id", "document_id", "page_start", "page_end", "parent_id",
        F.coalesce("child_ids", F.array().cast("array<string>")).alias("child_ids"))
    twice = c.groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1").select("chunk_id", F.lit("id_repeated").alias("error"))
    one = c.dropDuplicates(["chunk_id"])
    up = one.select(F.col("chunk_id").alias("parent_id"), F.col("document_id").alias("d"), F.col("page_start").alias("s"),
        F.col("page_end").alias("e"), F.col("child_ids").alias("k"))
    kept = (F.col("d") == F.col("document_id")) & (F.col("s") <= F.col("page_start")) & (F.col("e") >= F.col("page_end"))
    fault = F.when(F.col("d").isNull(), "parent_unknown").when(~F.array_contains("k", F.col("chunk_id")), "parent_lacks_child").when(~kept,
        "range_beyond_parent")
    upward = one.filter("parent_id <> ''").join(up, "parent_id", "left").select("chunk_id", fault.alias("error")).filter("error is not null")
    down = one.select("chunk_id", F.explode("child_ids").alias("child")).join(one.select(F.col("chunk_id").alias("child"),
        F.col("parent_id").alias("back"), F.lit(True).alias("there")), "child", "left")
    lost = down.filter("there is null").select("chunk_id", F.lit("child_unknown").alias("error"))
    loose = down.filter(F.col("there") & ~F.col("back").eqNullSafe(F.col("chunk_id"))).select(F.col("child").alias("chunk_id"),
        F.lit("child_has_other_parent").alias("error"))
    return twice.unionByName(upward).unionByName(lost).unionByName(loose)
