"""BM25 over settled token hashes: passages are searched as postings, question by question, k rows stay.

The index is one table of token hashes per passage, made once. Document frequencies are one combined count per term.
A search sends the terms of the questions (bounded slices) to the workers; each task turns its passages into postings
of the asked terms, sums them per question and keeps k rows of it, so pairs of questions and passages never leave it.
Only k rows per question and task are exchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slatework.functions.text import mixed_tokens
from slatework.operators.pages import without_low_value
from slatework.runtime import mapped_arrow, settled

LEVEL_WEIGHTS = {"section": 0.65, "page": 0.85, "passage": 1.0}
#: Questions whose rows leave a worker at a time, passages of a task, and passages whose postings are summed at a time.
BLOCK, SLICE, PART = 512, 1 << 17, 1 << 16
#: Terms in one of DENSE passages are also held as rows; the share of a question's k-th best score that may wait.
DENSE, LATE = 64, 0.5


def top_k(scored: DataFrame, k: int, *order: Column, by: str = "query_id") -> DataFrame:
    """The first k rows of each query by order, with rank from 1 (the window's group limit keeps k a partition)."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


class _Postings:
    """Postings of some passages, numbered in order of their ids: each term's passages and what a match gains.

    A search is exact. The most frequent terms of a question wait; what they can add to any passage at most is known,
    so only passages that come that near to the k-th best are completed with them.
    """

    def __init__(self, n: int, term: np.ndarray, passage: np.ndarray, gain: np.ndarray, terms: int):
        """One posting, in any order, for each term (below terms) and passage (below n) that meet."""
        self.blocks = min(2048, 1 << (n // 16).bit_length())
        self.room = -(-n // (8 * self.blocks)) * 8 * self.blocks
        order = np.argsort(term.astype(np.int64) * n + passage)
        self.passage, self.gain = passage[order].astype(np.int64), gain[order]
        self.count = np.bincount(term, minlength=terms)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.most = np.zeros(terms)
        some = np.flatnonzero(self.count)
        if len(some):
            self.most[some] = np.maximum.reduceat(self.gain, self.first[some])
        often = some[self.count[some] * DENSE >= n]
        self.dense = {}
        for t in often[np.argsort(-self.count[often], kind="stable")][: 2 * DENSE].tolist():
            self.dense[t] = row = np.zeros(self.room)
            row[self.passage[self.first[t] : self.first[t + 1]]] = self.gain[self.first[t] : self.first[t + 1]]

    def _floor(self, sums: np.ndarray, rest: list, k: int) -> float:
        """At most the k-th best score: the least of k passages that are good before the rest is added."""
        if self.blocks < 2 * k:
            return float(np.partition(sums, -k)[-k]) if len(sums) >= k else 0.0
        table = sums.reshape(-1, self.blocks)
        top = np.argpartition(table.max(0), -k)[-k:]
        best = table[:, top].argmax(0) * self.blocks + top
        score = sums[best]
        for t, w in rest:
            score += w * self.dense[t][best]
        return float(score.min())

    def search(self, terms: np.ndarray, weight: np.ndarray, k: int, digits: int | None, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(passages, scores) of the k best above floor; scores are rounded before they are ranked, equals go by number."""
        here = self.count[terms] > 0
        terms, weight = terms[here], weight[here]
        slack = 1e-9 if digits is None else 10.0**-digits
        order = np.argsort(-self.count[terms], kind="stable")
        terms, weight = terms[order], weight[order]
        reach = np.cumsum(weight * self.most[terms])
        if not len(terms) or reach[-1] <= floor - slack:
            return np.empty(0, np.int64), np.empty(0)
        may = LATE * floor if floor else LATE / 4 * reach[-1]
        late = 0  # so many of the most frequent terms wait
        for t in terms[: min(len(terms) - 1, int(np.searchsorted(reach, may, "right")))].tolist():
            if t not in self.dense:
                break
            late += 1
        rest = list(zip(terms[:late].tolist(), weight[:late].tolist()))
        a, b = self.first[terms[late:]], self.first[terms[late:] + 1]
        spans = list(zip(a.tolist(), b.tolist()))
        gain = np.concatenate([self.gain[x:y] for x, y in spans])
        gain *= np.repeat(weight[late:], b - a)
        sums = np.bincount(np.concatenate([self.passage[x:y] for x, y in spans]), gain, self.room)
        known = floor
        if not known:
            floor = self._floor(sums, rest, k)
        if rest and floor - reach[late - 1] <= slack:
            for t, w in rest:
                sums += w * self.dense[t]
            rest, late = [], 0
            floor = known or self._floor(sums, rest, k)
        fit = sums >= max(floor - slack - (reach[late - 1] if late else 0.0), 1e-300)
        at = (np.flatnonzero(fit.view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()  # eight at a time, as few fit
        at = at[fit[at]]
        score = sums[at]
        for t, w in rest:
            score += w * self.dense[t][at]
        if digits is not None:
            score = np.round(score, digits)
        good = np.flatnonzero(score > known)
        at, score = at[good], score[good]
        keep = np.argsort(-score, kind="stable")[:k]
        return at[keep], score[keep]

    def search_among(self, passages: np.ndarray, terms: np.ndarray, weight: np.ndarray, k: int, digits: int | None,
            floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """As search, of the given passages only (in order)."""
        sums = np.zeros(self.room)
        for t, w in zip(terms.tolist(), weight.tolist()):
            a, b = self.first[t], self.first[t + 1]
            sums[self.passage[a:b]] += w * self.gain[a:b]
        score = sums[passages] if digits is None else np.round(sums[passages], digits)
        good = np.flatnonzero(score > floor)
        keep = good[np.argsort(-score[good], kind="stable")[:k]]
        return passages[keep], score[keep]


@dataclass
class Bm25Index:
    """tokens(chunk_id, page_start, page_end, level, length, terms: hashes), settled; n counts all chunks, average_length those kept."""

    tokens: DataFrame
    n: int
    average_length: float
    k1: float = 1.5
    b: float = 0.75
    level_weights: dict[str, float] | None = None

    @classmethod
    def build(cls, chunks: DataFrame, k1: float = 1.5, b: float = 0.75, level_weights: dict[str, float] | None = None,
            exclude_low_value: bool = True) -> Bm25Index:
        """n counts all chunks passed in, the rest only those kept, as low-value chunks are left out of the index.

        A chunk without tokens counts in n and the average and is never found; an empty corpus finds nothing.
        """
        kept = F.lit(True) if not exclude_low_value else ~F.coalesce("metadata.text_retrieval_excluded", F.lit(False))
        terms = F.when(kept, F.coalesce(F.transform(mixed_tokens(F.col("text")), lambda t: F.xxhash64(t)), F.array().cast("array<bigint>")))
        pages = [c for c in ("page_start", "page_end") if c in chunks.columns]
        tokens = settled(chunks.select("chunk_id", *pages, F.coalesce("level", F.lit("passage")).alias("level"), terms.alias("terms")).withColumn("length",
            F.size("terms")))
        r = tokens.agg(F.count("*").alias("n"), F.avg(F.when(F.col("terms").isNotNull(), F.col("length"))).alias("a")).first()
        return cls(tokens.filter("terms is not null"), r["n"], r["a"] or 0.0, k1, b, level_weights)

    def flat(self, k1: float, b: float) -> Bm25Index:
        """The same tokens under other parameters."""
        return Bm25Index(self.tokens, self.n, self.average_length, k1, b, self.level_weights)

    def _weighted(self, queries: DataFrame) -> DataFrame:
        """(query_id, term, w): a term's idf, as often as it stands in the query; terms of no passage have none."""
        terms = queries.select("query_id", F.explode(mixed_tokens(F.col("query"))).alias("t")).groupBy("query_id",
            F.xxhash64("t").alias("term")).agg(F.count("*").alias("qtf"))
        terms = settled(terms)
        df = self.tokens.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        df = df.join(terms.select("term").distinct(), "term", "left_semi")
        return settled(terms.join(df, "term").select("query_id", "term",
            (F.col("qtf") * F.ln(1 + (F.lit(self.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("w")))

    def search(self, queries: DataFrame, k: int = 5, digits: int | None = None, slice_terms: int = 2_000_000) -> DataFrame:
        """(query_id, chunk_id, score, rank). A term that stands twice in a query counts twice; equals go by chunk_id.

        digits rounds the score before ranking (for comparisons). The workers hold at most about slice_terms query
        terms at a time; more are worked off in further scans of the tokens.
        """
        if k < 1:
            return queries.select("query_id", F.lit("").alias("chunk_id"), F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
        terms = self._weighted(queries)
        parts = -(-terms.count() // slice_terms) or 1
        out = None
        for part in range(parts):
            found = self._scan(terms.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part), k, digits)
            out = found if out is None else out.unionByName(found)
        return top_k(out, k, F.desc("score"), F.col("chunk_id")).select("query_id", "chunk_id", "score", "rank")

    def first_on_pages(self, wants: DataFrame, queries: DataFrame, digits: int | None = None, slice_terms: int = 2_000_000) -> DataFrame:
        """(query_id, chunk_id, score): of the passages that cover one of a query's wanted (query_id, page), the best above 0.

        Pairs of queries and passages stay in the workers, however many passages cover a page.
        """
        pages = settled(wants.groupBy("query_id").agg(F.collect_set("page").alias("pages")))
        terms = self._weighted(queries.join(pages, "query_id", "left_semi"))
        parts = -(-terms.count() // slice_terms) or 1
        out = None
        for part in range(parts):
            mine = F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part
            found = self._scan(terms.filter(mine), 1, digits, pages.filter(mine))
            out = found if out is None else out.unionByName(found)
        return top_k(out, 1, F.desc("score"), F.col("chunk_id")).select("query_id", "chunk_id", "score")

    def _parts(self) -> int:
        """Tasks of at most about SLICE passages, a whole number of them for each core, but none of few passages."""
        cores = self.tokens.sparkSession.sparkContext.defaultParallelism
        return max(1, min(cores * -(-self.n // (SLICE * cores)), -(-self.n // (SLICE // 64 or 1))))

    def _scan(self, terms: DataFrame, k: int, digits: int | None, wanted: DataFrame | None = None) -> DataFrame:
        held = terms.toArrow()
        coded = held["query_id"].combine_chunks().dictionary_encode()
        names, question = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        vocab, number = np.unique(held["term"].to_numpy(), return_inverse=True)
        order = np.argsort(question, kind="stable")
        first = np.searchsorted(question[order], np.arange(len(names) + 1))
        pages = None
        if wanted is not None:
            pages = {r["query_id"]: np.array(r["pages"]) for r in wanted.collect()}
            pages = [pages[x] for x in names.to_pylist()]
        known = self.tokens.sparkSession.sparkContext.broadcast((names, first, number[order].astype(np.int32),
            held["w"].to_numpy()[order], vocab))
        k1, b, average, levels = self.k1, self.b, self.average_length, self.level_weights or LEVEL_WEIGHTS

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, first, number, weight, vocab = known.value
            ids, parts, spans, n = [], [], [], 0
            for batch in batches:
                if not len(vocab) or not batch.num_rows:
                    continue
                ids.append(batch.column("chunk_id"))
                lists, length = batch.column("terms"), batch.column("length").to_numpy().astype(float)
                level = np.array([levels.get(x, 1.0) for x in batch.column("level").to_pylist()])
                all_terms, m = lists.flatten().to_numpy(), batch.num_rows
                at = np.searchsorted(vocab, all_terms).clip(0, len(vocab) - 1)
                mine = vocab[at] == all_terms
                key, tf = np.unique(at[mine] * m + np.repeat(np.arange(m), np.diff(lists.offsets.to_numpy()))[mine], return_counts=True)
                term, passage = key // m, key % m
                gain = tf * (k1 + 1) / (tf + k1 * (1 - b + (b * length[passage] / average if average else 0.0))) * level[passage]
                if pages is not None:
                    ends = [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("page_start", "page_end")]
                    spans.append(np.sort(np.stack(ends, 1) + 0 * ends[0][:, None] + 0 * ends[1][:, None], 1))  # a null makes both NaN
                parts.append((term.astype(np.int32), (n + passage).astype(np.int32), gain))
                n += m
            if not n:
                return
            found = pa.concat_arrays([x.cast(pa.string()) for x in ids])
            order = pc.sort_indices(found).to_numpy()
            place = np.empty(n, np.int32)
            place[order] = np.arange(n, dtype=np.int32)
            term, passage, gain = (np.concatenate(x) for x in zip(*parts))
            passage = place[passage]
            del parts
            spans = np.concatenate(spans)[order] if pages is not None else None
            best, score = np.zeros((len(names), k), np.int32), np.zeros((len(names), k))  # a score of 0 is none
            for low in range(0, n, PART):  # in order of the ids: of equals, those of an earlier part go first
                mine = np.flatnonzero((passage >= low) & (passage < low + PART))
                postings = _Postings(min(PART, n - low), term[mine], passage[mine] - low, gain[mine], len(vocab))
                for q in range(len(names)):
                    asked = number[first[q] : first[q + 1]], weight[first[q] : first[q + 1]], k, digits, score[q, -1]
                    if pages is None:
                        at, new = postings.search(*asked)
                    else:
                        start, end = spans[low : low + PART, 0], spans[low : low + PART, 1]
                        at, new = postings.search_among(np.flatnonzero(np.any([(start <= p) & (p <= end) for p in pages[q]], axis=0)), *asked)
                    if len(at):
                        both = np.concatenate([score[q], new])
                        keep = np.argsort(-both, kind="stable")[:k]
                        best[q], score[q] = np.concatenate([best[q], at + low])[keep], both[keep]
            del term, passage, gain
            for low in range(0, len(names), BLOCK):
                row, rank = np.nonzero(score[low : low + BLOCK] > 0)
                row += low
                yield pa.RecordBatch.from_arrays([names.take(pa.array(row)), found.take(pa.array(order[best[row, rank]])),
                    pa.array(score[row, rank])], names=["query_id", "chunk_id", "score"])

        kind = terms.schema["query_id"].dataType.simpleString()
        more = ("page_start", "page_end") if wanted is not None else ()
        tokens = self.tokens.select("chunk_id", *more, "level", "length", "terms").coalesce(self._parts())
        return mapped_arrow(tokens, work, f"query_id {kind}, chunk_id string, score double")

    def scored(self, pairs: DataFrame, queries: DataFrame) -> DataFrame:
        """(query_id, chunk_id, score) of the given pairs whose score is above 0; a pair costs one join, nothing is ranked."""
        asked = self._weighted(queries).groupBy("query_id").agg(F.collect_list(F.struct("term", "w")).alias("q"))
        both = pairs.select("query_id", "chunk_id").distinct().join(asked, "query_id").join(self.tokens, "chunk_id")
        norm = F.lit(1 - self.b) + (self.b / self.average_length if self.average_length else 0.0) * F.col("length")

        def gain(x):
            tf = F.size(F.filter("terms", lambda t: t == x["term"]))
            return x["w"] * tf * (self.k1 + 1) / (tf + self.k1 * norm)

        weight = F.lit(1.0)
        for level, w in (self.level_weights or LEVEL_WEIGHTS).items():
            weight = F.when(F.col("level") == level, w).otherwise(weight)
        return both.select("query_id", "chunk_id", (F.aggregate("q", F.lit(0.0), lambda a,
            x: a + gain(x)) * weight).alias("score")).filter("score > 0")


def term_statistics(chunks: DataFrame) -> DataFrame:
    """(term, df, idf) of every term of the chunks that are not of low value; idf counts all chunks."""
    n = chunks.agg(F.count("*").alias("n"))
    df = without_low_value(chunks).select(F.explode(F.array_distinct(mixed_tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n)).select("term", "df", F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
