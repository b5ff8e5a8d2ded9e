"""Lines repeated across the documents of one source.

Duplicate documents are collapsed first: documents of a source with the same set of line keys form one cluster
(order-free fingerprint: xor, sum and count of line hashes, so no document is ever gathered). Each line is then
counted once per cluster; weighting a cluster by its documents gives the exact number of distinct documents beside
the number of clusters and of publication days, so a republished article is not mistaken for boilerplate.

Shuffled are only (source, document, 64-bit line hash) rows, combined before the exchange. The repeated lines are
joined back by hash; they are broadcast only when counted to be few.

With limits on clusters and days a story that is republished in many documents keeps its lines: its documents are one
cluster. Lines that are taken out are judged by these counts (p1_cleaned); where a count of documents is asked for
(p1_found) the limits are put on documents.

Defined cases: null text counts as no lines; rows with null source or document are ignored; repeated rows and ties
change nothing (all counts are distinct counts); an empty table gives an empty result; other columns, whatever
their names, are not touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatework.runtime import need, settled, small


def line_key(line):
    """Lower-cased letters only."""
    return F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")


def _lines(pages: DataFrame, source: str, document: str, text: str, *keep: str) -> DataFrame:
    """_src, _doc, keep..., _pos (from 0), _line, _k (hash of the key) of every line that has letters."""
    parts = pages.filter(F.col(source).isNotNull() & F.col(document).isNotNull()).select(
        F.col(source).alias("_src"), F.col(document).alias("_doc"), *[F.col(c).alias(f"_keep_{c}") for c in keep],
        F.posexplode(F.split(F.col(text), "\n", -1)).alias("_pos", "_line"))
    keyed = parts.withColumn("_key", line_key(F.col("_line"))).filter(F.col("_key") != "")
    return keyed.withColumn("_k", F.xxhash64("_key")).drop("_key")


def find_repeated_lines(pages: DataFrame, *, source: str = "source_id", document: str = "document_id", text: str = "text",
        published: str = "ingested_at",
                        min_documents: int = 5, min_share: float = 0.2, min_clusters: int = 1, min_days: int = 1) -> DataFrame:
    """(source, line_hash, n_documents, n_clusters, n_days, n_source_documents) of the lines repeated in a source.

    min_documents and min_share (of the source's documents) count distinct documents; min_clusters and min_days
    count after republished documents are collapsed.
    """
    need(pages, source, document, text, published)
    lines = _lines(pages, source, document, text, published)
    once = settled(lines.groupBy("_src", "_doc", "_k").agg(F.min(F.to_date(f"_keep_{published}")).alias("_day")))
    docs = once.groupBy("_src", "_doc").agg(F.bit_xor("_k").alias("_x"), F.sum(F.col("_k").bitwiseAND(F.lit(0xFFFFFFFF))).alias("_s"),
        F.count("*").alias("_n"))
    clusters = docs.groupBy("_src", "_x", "_s", "_n").agg(F.min("_doc").alias("_doc"), F.count("*").alias("_w"))
    per_day = once.join(clusters.select("_src", "_doc", "_w"), ["_src", "_doc"]).groupBy("_src", "_k", "_day").agg(F.sum("_w").alias("_w"),
        F.count("*").alias("_c"))
    counted = per_day.groupBy("_src", "_k").agg(F.sum("_w").alias("n_documents"), F.sum("_c").alias("n_clusters"), F.count("_day").alias("n_days"))
    totals = pages.filter(F.col(source).isNotNull()).groupBy(F.col(source).alias("_src"), F.col(document).alias("_doc")).agg(F.lit(1).alias("_one"))
    totals = totals.groupBy("_src").agg(F.count("_doc").alias("n_source_documents"))
    held = counted.filter((F.col("n_documents") >= min_documents) & (F.col("n_clusters") >= min_clusters) & (F.col("n_days") >= min_days)).join(totals, "_src")
    held = held.filter(F.col("n_documents") >= F.col("n_source_documents") * F.lit(min_share) - F.lit(1e-9))
    return held.select(F.col("_src").alias("source"), F.col("_k").alias("line_hash"), "n_documents", "n_clusters", "n_days", "n_source_documents")


def flag_repeated_lines(pages: DataFrame, repeated: DataFrame, *, page: str = "page_number", source: str = "source_id",
        document: str = "document_id", text: str = "text") -> DataFrame:
    """(document_id, page_number, line_no from 1), one row per repeated line of a page."""
    few = small(repeated.select(F.col("source").alias("_src"), F.col("line_hash").alias("_k")))
    hits = _lines(pages, source, document, text, page).join(few, ["_src", "_k"])
    return hits.select(F.col("_doc").alias("document_id"), F.col(f"_keep_{page}").cast("bigint").alias("page_number"),
        (F.col("_pos") + 1).cast("bigint").alias("line_no")).distinct()


def strip_repeated_lines(pages: DataFrame, repeated: DataFrame, *, source: str = "source_id", text: str = "text") -> DataFrame:
    """pages with the repeated lines taken out of text and their number in a new column n_removed.

    Lines are judged in place, page by page, against the set of hashes of the page's source; texts are not exchanged
    where the sets together were measured to be small. A line of the set stands in a share s of the source's
    documents at least, so a set has no more lines than 1 / s documents have on average.
    """
    sets = small(repeated.groupBy(F.col("source").alias("_src")).agg(F.collect_set("line_hash").alias("_gone")))
    lines = F.split(F.col(text), "\n", -1)
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("_gone"), F.xxhash64(line_key(x))), F.lit(False)))
    out = pages.join(sets, pages[source] == F.col("_src"), "left").drop("_src")
    out = out.withColumn("_kept", F.when(F.col("_gone").isNotNull(), kept))
    removed = F.when(F.col("_kept").isNotNull(), F.size(lines) - F.size("_kept")).otherwise(0)
    return out.withColumn("n_removed", F.coalesce(removed, F.lit(0))).withColumn(text,
        F.coalesce(F.array_join("_kept", "\n"), F.col(text))).drop("_kept", "_gone")
