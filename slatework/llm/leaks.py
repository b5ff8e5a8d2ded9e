"""Evaluation texts leaking into training text: greedy string tiling.

The items are a fixed, checked-small side. Their words get numbers, every run of min_tile words a rolling
(Karp-Rabin) hash, and each document is scanned once for these seeds, whole batches at a time. Only a document with
a seed is compared with the items of that seed: longest non-overlapping matches are marked first, again and again,
until none of min_tile words is left, so reordered passages are all found. Matches are compared word by word, so a
hash collision cannot make one.

One pass over the documents, no shuffle. Items beyond items_chars characters are worked off in slices, each broadcast
by itself (documents are then scanned once per slice), so what is broadcast stays bounded.

Words are runs of letters and digits of the lower-cased text; each of U+4E00 to U+9FFF is a word of its own.

Defined cases: null or empty texts match nothing; an item shorter than min_tile words cannot match; items with null
id are ignored; repeated items count once (the first text by order wins); repeated documents give repeated rows.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatework.runtime import mapped

WORD = re.compile(r"[一-鿿]|[^\W_一-鿿]+")
_BASE = np.uint64(0x100000001B3)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for i in range(n):
        h = h * _BASE + ids[i : len(ids) - n + 1 + i]
    return h


def tiles(a: list[int], b: list[int], least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in a, start in b, length), longest first, none overlapping in a or in b."""
    where: dict[tuple[int, ...], list[int]] = {}
    for j in range(len(b) - least + 1):
        where.setdefault(tuple(b[j : j + least]), []).append(j)
    heap = []
    for i in range(len(a) - least + 1):
        for j in where.get(tuple(a[i : i + least]), ()):
            if i and j and a[i - 1] == b[j - 1] and a[i - 1]:
                continue  # inside a longer match
            k = least
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and a[i + k]:
                k += 1
            heapq.heappush(heap, (-k, i, j))
    used_a, used_b, out = bytearray(len(a)), bytearray(len(b)), []
    while heap:
        k, i, j = heapq.heappop(heap)
        k = -k
        free = [not (used_a[i + x] or used_b[j + x]) for x in range(k)]
        if all(free):
            out.append((i, j, k))
            used_a[i : i + k] = b"\1" * k
            used_b[j : j + k] = b"\1" * k
            continue
        x = 0
        while x < k:  # what is left of it goes back
            y = x
            while y < k and free[y]:
                y += 1
            if y - x >= least:
                heapq.heappush(heap, (-(y - x), i + x, j + x))
            x = y + 1
    return out


class _Items:
    def __init__(self, rows: list[tuple[int, str]], least: int):
        self.numbers: dict[str, int] = {}
        self.bodies, self.ids = [], []
        for item, text in rows:
            self.ids.append(item)
            self.bodies.append([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text)])
        parts = [rolling(np.array(b, np.uint64), least) for b in self.bodies]
        many = np.array([len(p) for p in parts], np.int64)
        seeds = np.concatenate([*parts, np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(parts), dtype=np.int32), many)
        start = (np.arange(len(seeds)) - np.repeat(np.cumsum(many) - many, many)).astype(np.int32)
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner, self.start = seeds[order], owner[order].astype(np.int64), start[order].astype(np.int64)
        self.sizes = np.array([len(b) for b in self.bodies], np.int64)

    def candidates(self, document: np.ndarray, low: np.ndarray, high: np.ndarray, least: int, min_longest: int,
            min_coverage: float) -> list[tuple[int, int]]:
        """(document, item) of the hits whose seeds could cover enough: n distinct seeds cover n * least words at most."""
        many = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        pair = np.repeat(document, many) * len(self.bodies) + self.owner[at]
        longest = int(self.sizes.max(initial=0)) + 1
        key = np.unique(pair * longest + self.start[at]) // longest
        pair, n = np.unique(key, return_counts=True)
        item = pair % len(self.bodies)
        enough = n * least >= np.maximum(min_longest, min_coverage * self.sizes[item])
        return list(zip((pair[enough] // len(self.bodies)).tolist(), item[enough].tolist()))


def _scan(docs: DataFrame, rows: list[tuple[int, str]], doc_id: str, text: str, least: int, min_longest: int, min_coverage: float) -> DataFrame:
    kind = docs.schema[doc_id].dataType.simpleString()
    item_kind = "bigint" if all(isinstance(i, int) for i, _ in rows) else "string"
    known = docs.sparkSession.sparkContext.broadcast(_Items(rows, least))
    schema = f"doc_id {kind}, item_id {item_kind}, longest bigint, tiles bigint, covered bigint, item_words bigint, coverage double"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        it = known.value
        for pdf in batches:
            number = it.numbers.get
            bodies = [[number(w, 0) for w in words(t)] for t in pdf["_text"]]
            ends = np.cumsum([len(b) + 1 for b in bodies])
            flat = np.array([x for b in bodies for x in (*b, 0)], np.uint64)
            h = rolling(flat, least)
            zeros = np.concatenate([[0], np.cumsum(flat == 0)])
            h_ok = np.flatnonzero(zeros[least:] == zeros[: max(0, len(zeros) - least)])
            lo, hi = np.searchsorted(it.seeds, h[h_ok], "left"), np.searchsorted(it.seeds, h[h_ok], "right")
            hit = hi > lo
            found = it.candidates(np.searchsorted(ends, h_ok[hit], "right"), lo[hit], hi[hit], least, min_longest, min_coverage) if hit.any() else []
            out = []
            for d, k in found:
                body = it.bodies[k]
                t = tiles(bodies[d], body, least)
                longest, covered = max((x[2] for x in t), default=0), sum(x[2] for x in t)
                if longest >= min_longest and covered >= min_coverage * len(body):
                    out.append((pdf["_doc"].iloc[d], it.ids[k], longest, len(t), covered, len(body), covered / len(body)))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "longest", "tiles", "covered", "item_words", "coverage"])

    return mapped(docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).filter("_doc is not null and _text <> ''"), work, schema)


def find_leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
               min_tile: int = 12, min_longest: int = 0, min_coverage: float = 0.0, items_chars: int = 8_000_000) -> DataFrame:
    """(doc_id, item_id, longest, tiles, covered, item_words, coverage) of every document and item that share a tile.

    longest: words of the longest tile; covered: words of the item inside tiles; coverage: their share of the item.
    """
    held = items.select(F.col(item_id).alias("i"),
        F.col(item_text).alias("t")).filter("i is not null and t <> ''").groupBy("i").agg(F.min("t").alias("t"))
    total = held.agg(F.sum(F.length("t"))).first()[0] or 0
    slices = -(-total // items_chars) or 1
    result = None
    for k in range(slices):
        part = held if slices == 1 else held.filter(F.pmod(F.xxhash64("i"), F.lit(slices)) == k)
        found = _scan(docs, [(r[0], r[1]) for r in part.orderBy("i").collect()], doc_id, text, min_tile, min_longest, min_coverage)
        result = found if result is None else result.unionByName(found)
    return result
