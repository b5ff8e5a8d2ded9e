"""Near-duplicate records: consistent weighted samples of TF-IDF shingles, banded, verified.

1. Census (one pass): every record's fingerprint and number of distinct shingles, and the document frequencies of
   shingles in a fixed number of counters (map-side sums; what reaches the driver does not grow with the data). A
   counter's chance load is shingles per record / 65,536 of all records at every size, so frequencies above about 1 %
   are told at any size; rarer shingles all have the highest weight. A shingle is itself a 32-bit number everywhere
   else; the counter decides nothing but its weight.
2. Weights are IDF scaled to [1, 1.25] in 4 steps; presence counts, not occurrences. Strong IDF loses pairs of a
   family that makes up a large share of all records, whose common shingles then weigh little; under this scale a
   pair of plain Jaccard J has weighted Jaccard J / (J + 1.25 (1 - J)) at least, 0.545 at 0.6, whatever the frequencies.
3. Samples: under improved consistent weighted sampling (Ioffe 2010) the value a of an element of constant weight w
   is exponential with rate w and fixed by (element, function), so it is drawn by inversion from one hash of both.
   Within a weight step the smallest hash wins, so a record costs one minimum per step and function and one
   comparison of the steps. SAMPLES of them give BANDS bands of ROWS each (random groups, every sample in several).
4. Exchange: a band key (32 bits and a target) per record and band goes out in packed blocks, each record once per
   block with its fingerprint, size and a sketch of 128 bits. A target sorts its keys; records that meet there are paired,
   pairs that size or sketch rule out are dropped (a pair of weighted Jaccard 0.6 is lost so with a chance of 0.00004,
   one of 0.545 with 0.001), the others leave.
5. Keys expected to be hot (from a fixed fraction of the records; the sample only routes, it decides nothing) and
   buckets above BLOCK members are worked off as pairs of blocks of bounded size, spread over tasks, where only
   verified pairs leave a task.
6. Verification on the texts by plain shingle Jaccard, where asked for, and by weighted Jaccard.

Records are known by the fingerprint of their bare text, so exact copies are one record and never meet in a bucket.

Defined cases: null texts and texts with fewer than min_chars letters and digits take no part; a null id is ignored;
a repeated id counts once; copies are linked through their common fingerprint; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatework.llm._grams import bare, distinct, grams, mix
from slatework.operators.graph import connected_components
from slatework.runtime import mapped, mapped_arrow, need, settled, ship, small

SHINGLE, BUCKETS, BLOCK = 4, 1 << 16, 64
SAMPLES, ROWS, BANDS = 256, 6, 150
#: The steps of the weights and their upper ends as shares of all records.
WEIGHTS = np.array([1.25, 1.25 - 0.25 / 3, 1.25 - 0.5 / 3, 1.0])
FREQUENT = (0.01, 0.05, 0.2)
#: Least agreement of two sketches of 128 bits; a pair of weighted Jaccard 0.6 agrees in 102 bits, give or take 4.5.
AGREE = 84


def elements(hashes: np.ndarray) -> np.ndarray:
    """Counter numbers of the (shingle, occurrence) elements of a text, sorted by shingle; chance repeats stay in."""
    s = np.sort(hashes.astype(np.uint16))
    if len(s) > 1:
        same = s[1:] == s[:-1]
        if same.any():
            at = np.arange(len(s))
            nth = at - np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), at, 0))
            s = s + (nth * 40503).astype(np.uint16)
    return s


def document_frequencies(bodies: DataFrame) -> tuple[np.ndarray, int]:
    """(texts per counter, texts) over all rows of bodies (fp, body).

    A text counts once however often it comes and however the rows are split, so a hot group of copies does not make
    its shingles common.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for pdf in batches:
            texts = pdf["body"].tolist()
            n += len(texts)
            parts = []
            for h in grams(texts, SHINGLE):
                e = np.sort(elements(h))
                parts.append(e[np.concatenate([[True], e[1:] != e[:-1]])] if len(e) else e)
            if parts:
                total += np.bincount(np.concatenate(parts), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(total[at], n)})

    rows = mapped(bodies.select("fp", "body").dropDuplicates(["fp"]), work,
        "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS, np.int64)
    real = rows[rows["bucket"] >= 0]
    df[real["bucket"].to_numpy(np.int64)] = real["n"].to_numpy(np.int64)
    return df, int(rows.loc[rows["bucket"] < 0, "n"].sum())


def shingles(texts: list[str]) -> list[np.ndarray]:
    """The distinct shingles of each text as numbers of 32 bits, in small batches that stay in the cache."""
    return [distinct(h.astype(np.uint32)) for low in range(0, len(texts), 64) for h in grams(texts[low : low + 64], SHINGLE)]


def fingerprint(body: str) -> int:
    return xxhash.xxh64_intdigest(body.encode("utf-8", "surrogatepass")) - (1 << 63)


class Sampler:
    """Samples and band keys; the same everywhere for one seed."""

    def __init__(self, step_of: np.ndarray, seed: int, samples: int, rows: int, bands: int):
        rng = np.random.default_rng(seed)
        self.step_of, self.samples = step_of, samples
        self.a = rng.integers(0, 1 << 32, samples, np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, samples, np.uint32)
        self.factors = rng.integers(0, 1 << 63, rows, np.uint64) | np.uint64(1)
        groups = [rng.permutation(samples)[: samples // rows * rows].reshape(-1, rows) for _ in range(-(-bands * rows // samples) + 1)]
        self.bands = np.concatenate(groups)[:bands]

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        low = np.full((len(sets), len(WEIGHTS), self.samples), 0xFFFFFFFF, np.uint32)
        room = np.empty((min(2048, max(map(len, sets), default=0)), self.samples), np.uint32)
        for i, x in enumerate(sets):
            step = self.step_of[x & np.uint32(BUCKETS - 1)]
            x = x[np.argsort(step, kind="stable")]
            end = np.bincount(step, minlength=len(WEIGHTS)).cumsum().tolist()
            at = 0
            for w, stop in enumerate(end):
                while at < stop:
                    some = x[at : min(stop, at + 2048), None]
                    got = np.multiply(some, self.a, out=room[: len(some)])
                    np.bitwise_xor(got, self.b, out=got)
                    np.minimum(low[i, w], got.min(0), out=low[i, w])
                    at += len(some)
        uniform = (low >> np.uint32(8)).astype(np.float32) * np.float32(2.0**-24)  # below 1
        won = (np.log(np.float32(1) - uniform) / -WEIGHTS.astype(np.float32)[:, None]).argmin(1)
        return np.take_along_axis(low, won[:, None], 1)[:, 0] ^ (won.astype(np.uint32) * np.uint32(0x9E3779B1))

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """(records x bands) keys of 64 bits."""
        out = np.empty((len(signatures), len(self.bands)), np.uint64)
        for low in range(0, len(out), 64):  # stays in the cache
            key = np.arange(len(self.bands), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            for r in range(self.bands.shape[1]):
                key = key + signatures[low : low + 64, self.bands[:, r]] * self.factors[r]
            out[low : low + 64] = mix(key)
        return out

    @staticmethod
    def sketches(signatures: np.ndarray) -> np.ndarray:
        """(records x 2) 64 bits each, one bit of each of the first 128 samples."""
        bits = (mix(signatures[:, :128].astype(np.uint64)) >> np.uint64(20)).astype(np.uint8) & 1
        return np.packbits(bits, axis=1).view(np.uint64)


def _texts(records: DataFrame, record_id: str, text: str) -> DataFrame:
    need(records, record_id, text)
    own = records.select(F.col(record_id).cast("string").alias("_id"), F.col(text).cast("string").alias("_text"))
    return own.filter((F.length("_text") >= SHINGLE) & F.col("_id").isNotNull())


def _bodies(batch: pa.RecordBatch, least: int) -> tuple[list[str], list[str]]:
    got = [(i, b) for i, b in zip(batch.column("_id").to_pylist(), map(bare, batch.column("_text").to_pylist())) if len(b) >= least]
    return [i for i, _ in got], [b for _, b in got]


def _census(texts: DataFrame, least: int) -> DataFrame:
    """(record_id, fp, n) of every record; rows without record_id are counters: fp their number, n the records."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, schema = np.zeros(BUCKETS, np.int64), pa.schema([("record_id", pa.string()), ("fp", pa.int64()), ("n", pa.int64())])
        for batch in batches:
            ids, bodies = _bodies(batch, least)
            sets = shingles(bodies)
            for low in range(0, len(sets), 256):
                # Shingles of one record that share a counter count twice; the load is even, so ranks do not change.
                count += np.bincount(np.concatenate(sets[low : low + 256]) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(map(fingerprint, bodies), pa.int64()),
                pa.array(map(len, sets), pa.int64())], schema=schema)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.string()), pa.array(at), pa.array(count[at])], schema=schema)

    return mapped_arrow(texts, work, "record_id string, fp bigint, n bigint")


def weight_steps(frequencies: np.ndarray, records: int) -> np.ndarray:
    """The weight step of every counter."""
    return np.searchsorted(np.array(FREQUENT) * max(1, records), frequencies, "right").astype(np.uint8)


def _new_texts(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[tuple[list[int], list[str]]]:
    """Fingerprints and bodies, up to 1,024 at a time, without the copies that one task sees."""
    seen: set[int] = set()
    fps, bodies = [], []
    for batch in batches:
        for b in _bodies(batch, least)[1]:
            if (f := fingerprint(b)) not in seen:
                seen.add(f)
                fps.append(f)
                bodies.append(b)
            if len(bodies) == 1024:
                yield fps, bodies
                fps, bodies = [], []
        if len(seen) > 1_000_000:
            seen.clear()
    if bodies:
        yield fps, bodies


def _signed(texts: DataFrame, least: int, sampler, hot=None) -> DataFrame:
    """(key, fp) rows of all bands; of hot keys only where hot (a broadcast sorted array) is given."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fps, bodies in _new_texts(batches, least):
            keys = sampler.value.keys(sampler.value.signatures(shingles(bodies)))
            fp, flat = np.repeat(np.array(fps, np.int64), keys.shape[1]), keys.ravel()
            if hot is not None:
                own = _among(flat, hot.value)
                fp, flat = fp[own], flat[own]
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(fp)], names=["key", "fp"])

    return mapped_arrow(texts, work, "key bigint, fp bigint")


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.searchsorted(known, keys).clip(0, len(known) - 1)] == keys


PACKED = pa.schema([("target", pa.int32()), ("fp", pa.binary()), ("sketch", pa.binary()), ("n", pa.binary()), ("many", pa.binary()),
    ("keys", pa.binary())])


def _packed(texts: DataFrame, least: int, sampler, hot, targets: int) -> DataFrame:
    """Band keys in blocks of one target each: the records of a block, how many keys each has there, and the keys."""

    def block(held: list) -> Iterator[pa.RecordBatch]:
        fp, sketch, n, keys = (np.concatenate(x) for x in zip(*held))
        flat, record = keys.ravel(), np.repeat(np.arange(len(fp)), keys.shape[1])
        if len(hot.value):
            own = ~_among(flat, hot.value)
            flat, record = flat[own], record[own]
        target = ((flat >> np.uint64(32)) % np.uint64(targets)).astype(np.uint32 if targets > 65535 else np.uint16)
        order = np.argsort(target, kind="stable")
        flat, record, target = flat[order].astype(np.uint32), record[order], target[order]
        ends = np.flatnonzero(np.diff(target, append=target[-1:] + 1)) + 1 if len(target) else []
        rows, at = [], 0
        for end in ends:
            who, many = np.unique(record[at:end], return_counts=True)
            rows.append((int(target[at]), fp[who].tobytes(), sketch[who].tobytes(), n[who].tobytes(), many.astype(np.uint16).tobytes(),
                flat[at:end].tobytes()))
            at = end
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), PACKED.types)],
            schema=PACKED) if rows else pa.RecordBatch.from_pylist([], PACKED)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for fps, bodies in _new_texts(batches, least):
            sets = shingles(bodies)
            signatures = sampler.value.signatures(sets)
            held.append((np.array(fps, np.int64), Sampler.sketches(signatures), np.array([min(len(x), 65535) for x in sets], np.uint16),
                sampler.value.keys(signatures)))
            if len(held) == 16:
                yield from block(held)
                held = []
        if held:
            yield from block(held)

    return mapped_arrow(texts, work, "target int, fp binary, sketch binary, n binary, many binary, keys binary")


def _meetings(packed: DataFrame, targets: int, least_ratio: float, agree: int, block: int) -> DataFrame:
    """(a, b, size): pairs of fingerprints that meet and may be similar (size null); members b of a bucket a above block."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("size", pa.int64())])

    def meet(rows: list) -> Iterator[pa.RecordBatch]:
        fp, sketch, n, many, keys = (np.concatenate([np.frombuffer(r[i], t) for r in rows]) for i,
            t in enumerate((np.int64, np.uint64, np.uint16, np.uint16, np.uint32)))
        known, first, number = np.unique(fp, return_index=True, return_inverse=True)
        sketch, n = sketch.reshape(-1, 2)[first], n[first].astype(np.int64)
        entry = distinct((keys.astype(np.uint64) << np.uint64(32)) | np.repeat(number, many).astype(np.uint64))
        key, who = entry >> np.uint64(32), (entry & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start = np.flatnonzero(np.diff(key, prepend=key[:1] + 1))
        size = np.diff(np.append(start, len(key)))
        pairs, big = [np.empty(0, np.uint64)], []
        for s in np.unique(size[(size > 1) & (size <= block)]).tolist():
            runs = who[start[size == s][:, None] + np.arange(s)]
            i, j = np.triu_indices(s, 1)
            for low in range(0, len(runs), max(1, (1 << 20) // len(i))):
                some = runs[low : low + max(1, (1 << 20) // len(i))]
                x, y = some[:, i].ravel(), some[:, j].ravel()
                # Sizes are cut at 65,535, where the smaller one decides nothing.
                near = (np.minimum(n[x], n[y]) >= least_ratio * np.maximum(n[x], n[y])) | (np.minimum(n[x], n[y]) >= 65535 * least_ratio)
                x, y = x[near], y[near]
                near = 128 - np.bitwise_count(sketch[x] ^ sketch[y]).sum(1, dtype=np.int16) >= agree
                pairs.append((x[near].astype(np.uint64) << np.uint64(32)) | y[near].astype(np.uint64))
        for at, s in zip(start[size > block].tolist(), size[size > block].tolist()):
            own = known[who[at : at + s]]
            big.append((np.full(s, np.bitwise_xor.reduce(mix(own.view(np.uint64))).view(np.int64)), own, np.full(s, s)))
        met = distinct(np.concatenate(pairs))
        a, b = known[(met >> np.uint64(32)).astype(np.int64)], known[(met & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], schema=schema)
        if big:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*big)], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(row[0], []).append(row[1:])
        for rows in held.values():
            yield from meet(rows)

    return mapped_arrow(packed.repartitionById(targets, "target"), work, "a bigint, b bigint, size bigint")


class _Verify:
    """Both similarities of text pairs, by 64-bit hashes of shingles; what was made of the texts seen last is kept."""

    def __init__(self, step_of: np.ndarray, min_weighted: float, exact_min: float | None):
        self.weight_of, self.min_weighted, self.exact_min = WEIGHTS[step_of], min_weighted, exact_min
        self.sets: dict[str, np.ndarray] = {}

    def prepare(self, texts: list[str]) -> None:
        new = [t for t in dict.fromkeys(texts) if t not in self.sets]
        if len(self.sets) + len(new) > 4096:
            self.sets.clear()
            new = list(dict.fromkeys(texts))
        for low in range(0, len(new), 64):
            self.sets.update(zip(new[low : low + 64], map(distinct, grams(new[low : low + 64], SHINGLE))))

    def likely(self, left: list[str], right: list[str]) -> np.ndarray:
        """Which of all pairs can reach exact_min, by common hashes counted as products of matrices."""
        if self.exact_min is None:
            return np.ones((len(left), len(right)), bool)
        sets = [self.sets[t] for t in (*left, *right)]
        sizes = np.array([len(x) for x in sets])
        names, col = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        both = np.zeros((len(left), len(right)))
        for low in range(0, len(names), 8192):  # in slices: bounded memory
            at = (col >= low) & (col < low + 8192)
            part = np.zeros((len(sets), min(8192, len(names) - low)), np.float32)
            part[row[at], col[at] - low] = 1
            both += part[: len(left)] @ part[len(left) :].T
        return both >= (self.exact_min - 0.01) * (sizes[: len(left), None] + sizes[None, len(left) :] - both)

    def _weight(self, shingles: np.ndarray) -> float:
        return float(self.weight_of[(shingles & np.uint64(BUCKETS - 1)).astype(np.int64)].sum())

    def __call__(self, a: str, b: str) -> tuple[float, float] | None:
        """(weighted, exact) of two prepared texts, or None if one is too low."""
        x, y = self.sets[a], self.sets[b]
        x, y = (x, y) if len(x) <= len(y) else (y, x)
        if self.exact_min is not None and len(x) < self.exact_min * len(y):
            return None
        common = x[y[np.searchsorted(y, x).clip(0, len(y) - 1)] == x]
        exact = len(common) / (len(x) + len(y) - len(common))
        if self.exact_min is not None and exact < self.exact_min:
            return None
        both = self._weight(common)
        weighted = both / (self._weight(x) + self._weight(y) - both)
        return (weighted, exact) if weighted >= self.min_weighted else None


def similar_texts(records: DataFrame, record_id: str, text: str, *, min_weighted: float = 0.5, min_chars: int = 100, exact_min: float | None = None,
                  samples: int = SAMPLES, rows: int = ROWS, bands: int = BANDS, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(links, members).

    links(fp_a, fp_b, weighted, exact): pairs of different texts, fp_a < fp_b, of weighted Jaccard at least
    min_weighted and, if exact_min is given, of plain shingle Jaccard at least that. members(fp, record_id): the
    fingerprint of every record that takes part.
    """
    texts, least, block = _texts(records, record_id, text), max(min_chars, SHINGLE), BLOCK
    spark = texts.sparkSession
    census = settled(_census(texts, least))
    members = census.filter("record_id is not null").select("fp", "record_id").distinct()
    counts = census.filter("record_id is null").groupBy("fp").agg(F.sum("n").alias("n")).toPandas()
    frequencies = np.zeros(BUCKETS, np.int64)
    frequencies[counts["fp"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    n = census.filter("record_id is not null").count()
    step_of = weight_steps(frequencies, n)
    sampler, steps = spark.sparkContext.broadcast(Sampler(step_of, seed, samples, rows, bands)), spark.sparkContext.broadcast(step_of)
    # Routing only. A hot key has about 512 records, or one in 10,000, so there are 10,000 a band at most.
    probe = _signed(texts.filter(F.pmod(F.xxhash64("_id"), F.lit(64)) == 0), least, sampler)
    hot = probe.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= max(8, n // 640_000)).toPandas()
    held = spark.sparkContext.broadcast(np.sort(hot["key"].to_numpy(np.int64).view(np.uint64)))
    targets = max(spark.sparkContext.defaultParallelism, -(-n * bands // 6_000_000))
    ratio = exact_min if exact_min is not None else min_weighted / WEIGHTS[0]
    # The sketch was made for a similarity of 0.6; below that it decides nothing.
    agree = AGREE if (exact_min or 0) >= 0.6 or min_weighted >= 0.54 else 0
    met = settled(_meetings(_packed(texts, least, sampler, held, targets), targets, ratio, agree, block))
    pairs = met.filter("size is null").select(F.col("a").alias("fp_a"), F.col("b").alias("fp_b")).distinct()
    big = met.filter("size is not null").select(F.col("a").alias("key"), F.col("b").alias("fp"), F.col("size").alias("expected"))
    if len(hot):
        expected = small(spark.createDataFrame([(int(k), int(m) * 64) for k, m in zip(hot["key"], hot["n"])], "key bigint, expected bigint"))
        big = big.unionByName(_signed(texts, least, sampler, held).distinct().join(expected, "key").select("key", "fp", "expected"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        verify = _Verify(steps.value, min_weighted, exact_min)
        for pdf in batches:
            out = []
            for low in range(0, len(pdf), 512):
                part = pdf[low : low + 512]
                verify.prepare([*part["body_a"], *part["body_b"]])
                out += [(x, y, *j) for x, y, a, b in zip(part["fp_a"], part["fp_b"], part["body_a"], part["body_b"]) if (j := verify(a, b))]
            yield pd.DataFrame(out, columns=["fp_a", "fp_b", "weighted", "exact"])

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fps, own in _new_texts(batches, least):
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(own, pa.string())], names=["fp", "body"])

    wanted = small(pairs.select(F.explode(F.array("fp_a", "fp_b")).alias("fp")).distinct())
    every = mapped_arrow(texts, bodies, "fp bigint, body string")
    text_of = every.join(wanted, "fp", "left_semi").dropDuplicates(["fp"])
    first = text_of.withColumnsRenamed({"fp": "fp_a", "body": "body_a"})
    second = text_of.withColumnsRenamed({"fp": "fp_b", "body": "body_b"})
    schema = "fp_a bigint, fp_b bigint, weighted double, exact double"
    links = mapped(pairs.join(first, "fp_a").join(second, "fp_b"), check, schema)
    if len(hot) or met.filter("size is not null").limit(1).count():
        links = links.unionByName(_by_blocks(big.distinct(), every.dropDuplicates(["fp"]), lambda: _Verify(steps.value, min_weighted, exact_min),
            schema)).dropDuplicates(["fp_a", "fp_b"])
    return links, members


def _by_blocks(big: DataFrame, text_of: DataFrame, verifier, schema: str) -> DataFrame:
    """All verified pairs of big buckets: blocks of about 256 members, one task group per pair of blocks.

    Every member carries its big buckets (as many as there are bands at most), and a pair is compared in the first of
    those that both are in alone.
    """
    every = big.groupBy("fp").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    blocks = big.withColumn("nb", F.greatest(F.lit(1), F.ceil(F.col("expected") / 256)).cast("int")).withColumn("b",
        F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int"))
    met = blocks.select("key", "fp", "b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o")).select("key", "fp", "b",
        F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    ship(big.sparkSession)
    full = met.join(every.join(text_of, "fp"), "fp")

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        verify, key = verifier(), pdf["key"].iloc[0]
        i, j = pdf["i"].iloc[0], pdf["j"].iloc[0]
        left, right = pdf[pdf["b"] == i], pdf[pdf["b"] == j]
        out = []
        if not len(left) or not len(right):
            return pd.DataFrame(out, columns=["fp_a", "fp_b", "weighted", "exact"])
        earlier = [[k for k in keys if k < key] for keys in (*left["keys"], *right["keys"])]
        names = {k: n for n, k in enumerate(dict.fromkeys(k for keys in earlier for k in keys))}
        inside = np.zeros((len(earlier), len(names) or 1), np.float32)
        for n, keys in enumerate(earlier):
            inside[n, [names[k] for k in keys]] = 1
        new = inside[: len(left)] @ inside[len(left) :].T == 0
        if not new.any():
            return pd.DataFrame(out, columns=["fp_a", "fp_b", "weighted", "exact"])
        rows, columns = new.any(1), new.any(0)
        left, right, new = left[rows], right[columns], new[np.ix_(rows, columns)]
        verify.prepare([*left["body"], *right["body"]])
        xs, ys, a, b = left["fp"].tolist(), right["fp"].tolist(), left["body"].tolist(), right["body"].tolist()
        for m, n in zip(*np.nonzero(new & verify.likely(a, b))):
            x, y = xs[m], ys[n]
            if (x < y or (i != j and x != y)) and (got := verify(a[m], b[n])):
                out.append((min(x, y), max(x, y), *got))
        return pd.DataFrame(out, columns=["fp_a", "fp_b", "weighted", "exact"])

    return full.groupBy("key", "i", "j").applyInPandas(within, schema)


def record_pairs(links: DataFrame, members: DataFrame, max_copies: int = 256) -> DataFrame:
    """(record_a, record_b, exact), a < b: every pair of records whose texts are linked or the same.

    A text with more than max_copies copies is not expanded into all pairs: its smallest record stands for it in the
    links to other texts, and each further copy has one pair with that record, which carries the membership.
    """
    sized = members.groupBy("fp").agg(F.count("*").alias("n"), F.min("record_id").alias("low"))
    known = settled(members.join(sized, "fp"))
    stand = known.filter((F.col("n") <= max_copies) | (F.col("record_id") == F.col("low"))).select("fp", "record_id")
    a, b = stand.select(F.col("fp").alias("fp_a"), F.col("record_id").alias("x")), stand.select(F.col("fp").alias("fp_b"),
        F.col("record_id").alias("y"))
    across = links.join(a, "fp_a").join(b, "fp_b").select("x", "y", "exact")
    few = known.filter(F.col("n").between(2, max_copies))
    same = few.select("fp", F.col("record_id").alias("x")).join(few.select("fp", F.col("record_id").alias("y")), "fp").filter("x < y").select("x",
        "y", F.lit(1.0).alias("exact"))
    star = known.filter((F.col("n") > max_copies) & (F.col("record_id") != F.col("low"))).select(F.col("low").alias("x"),
        F.col("record_id").alias("y"), F.lit(1.0).alias("exact"))
    both = across.unionByName(same).unionByName(star)
    return both.select(F.least("x", "y").alias("record_a"), F.greatest("x", "y").alias("record_b"), "exact").distinct()


def record_groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """(record_id, group_id, n_links, n_copies), one row per record that is linked to another text or has copies.

    group_id is the smallest record id of the class; n_links counts linked other texts, n_copies records of its own
    text. Copies are not expanded into pairs.
    """
    held = settled(links.select("fp_a", "fp_b"))
    per_text = members.groupBy("fp").agg(F.min("record_id").alias("low"), F.count("*").alias("n_copies"))
    degree = held.select(F.col("fp_a").alias("fp")).unionAll(held.select("fp_b")).groupBy("fp").agg(F.count("*").alias("n_links"))
    classes = connected_components(held, "fp_a", "fp_b").select(F.col("node").alias("fp"), "component")
    texts = per_text.join(degree, "fp", "left").join(classes, "fp", "left").filter("n_links is not null or n_copies > 1").withColumn("component",
        F.coalesce("component", "fp"))
    texts = settled(texts)
    names = texts.groupBy("component").agg(F.min("low").alias("group_id"))
    return texts.join(names, "component").join(members, "fp").select("record_id", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        "n_copies")
