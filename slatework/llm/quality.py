"""Per-document text quality statistics and robust Mahalanobis distance from the prose of the document's language.

Statistics are figures of a document by itself (one pass, no shuffle). Ratios enter the distance as square roots and
word length as a logarithm, which makes their spread in prose even.

Location and covariance of a language's prose are fitted in two steps. The raters' labels (a bounded sample: at most
max_labels rows) give the start: medians of labelled prose by language, one covariance of the deviations from them,
and the limit that separates the labels best (F1; in the middle, on a log scale, of the widest best stretch). Then
mean and covariance are taken anew from all documents of the language within the limit, and the limit again from the
labels, `steps` times; each step is a map-side sum of 1 + d + d^2 numbers per language, nothing else reaches the
driver. A statistic's contribution is its term z_i (S^-1 z)_i; contributions sum to the squared distance.

A document is no prose if its distance lies beyond the limit; nothing else decides.

Languages are told from the text itself, since labels are missing or wrong in places.

Defined cases: null, empty and white-space texts have no statistics and are never found; repeated rows give repeated
rows; unknown, null and contradictory labels are left out of the fit; a language with fewer than 5 labelled prose
documents starts from the medians of all its documents; without labelled prose medians and median deviations of all
documents are the start; without labels of both kinds the limit is the 0.999 quantile of chi-squared; a language with
fewer documents within the limit than 3 times the statistics keeps its start.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatework.runtime import mapped, need, settled

#: Frequent function words and characters.
COMMON = {
    "en": "the a an of to in and or but is are was were be it its this that these those for with on by at as from not no than then so if when why how which what who each there have has had do does can we you they he she because while whether into only".split(),
    "de": "der die das den dem des ein eine einer eines einem einen und oder aber ist sind war waren sein wird werden es dies diese dieser für mit auf von zu im in am an als auch nicht nur so wenn dann warum wie was wer jede jeder jedes hat haben sich aus bei durch nach wir man damit es gibt weil".split(),
    "zh": list("的了是在和与则而也不当时候如果因此那么为什么我们它这种可以由再被把或但都有一个就对从到会"),
}
STATS = ("log_words", "word_length", "symbol_ratio", "digit_ratio", "ending_share", "common_share", "prose_share", "log_line", "distinct_share",
    "mark_ratio")
_COMMON = {k: frozenset(v) for k, v in COMMON.items()}
_LATIN = _COMMON["en"] | _COMMON["de"]
_WORD = re.compile(r"[一-鿿]|[^\W\d_一-鿿]+(?:['’][^\W\d_]+)*")
_HAN = re.compile(r"[一-鿿]+")
_END = re.compile(r"[.!?。！？…][\"'”’)\]]*$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*")
_BLOCK, _SPACES, _DIGITS = re.compile(r"\n[^\S\n]*\n"), re.compile(r"\s+"), re.compile(r"\d+")
_ITEM = re.compile(r"^\s*(?:[-*•·‣–—]|\(?\d{1,3}[.):]|[a-zA-Z][.)])\s+")
#: What wrong decoding leaves behind.
_BROKEN = re.compile("[\u00a1-\u00bf\u00c2\u00c3\u00e2\u0153\u20ac\ufffd]")
_CELL = re.compile(r"\t|\s\|\s|^\||\|$|;|=")


def plain(text: str) -> str:
    t = html.unescape(text).replace("﻿", "").replace("\r\n", "\n").replace("\r", "\n").replace(" ", " ").replace("　", " ")
    return t.strip()


def language(words: list[str], han: int) -> str:
    if han * 3 > len(words):
        return "zh"
    en, de = sum([w in _COMMON["en"] for w in words]), sum([w in _COMMON["de"] for w in words])
    return "de" if de > en else "en"


def _solid(text: str) -> int:
    return len("".join(text.split()))


def sentence_chars(text: str) -> int:
    """Characters that stand in sentences: enough words, some of them common (more where the end mark is lost), few marks of cells."""
    total = 0
    for block in _BLOCK.split(text):
        parts, run = [], []
        for line in block.split("\n"):
            if _ITEM.match(line) and len(_WORD.findall(line)) < (8 if _END.search(line.rstrip()) else 12):
                parts.append("\n".join(run))
                run = []
            else:
                run.append(line)
        parts.append("\n".join(run))
        for s in [x for part in parts for x in _SENTENCE.split(part.strip())]:
            if not s:
                continue
            w = _WORD.findall(s.lower())
            n = len(w)
            ended = _END.search(s) is not None
            han = n and "一" <= w[n // 2] <= "鿿"
            if n < (7 if han else 5) or (not ended and n < 12):
                continue
            common = _COMMON["zh"] if han else _LATIN
            size = _solid(s)
            if (sum([x in common for x in w]) >= (0.1 if ended else 0.2) * n and sum(map(len, w)) >= 0.5 * size and s.count("\n") <= max(2,
                    len(s) / 25)
                    and len(_BROKEN.findall(s)) <= 1 + 0.03 * size and len(set(w)) >= 0.5 * min(n,
                        40) and len(_CELL.findall(s)) <= 2 + n // 12):
                total += size
    return total


def statistics(text: str) -> tuple[str, list[float]]:
    t = plain(text)
    words = _WORD.findall(t.lower())
    han = sum(map(len, _HAN.findall(t)))
    lang = language(words, han)
    lines = [x.strip() for x in t.split("\n") if x.strip()]
    solid = max(1, _solid(t))
    letters = sum(map(len, words))
    digits = sum(map(len, _DIGITS.findall(t)))
    n = max(1, len(words))
    return lang, [
        math.log1p(len(words)), letters / n, max(0.0, 1 - (letters + digits) / solid), digits / solid,
        sum(bool(_END.search(x)) for x in lines) / max(1, len(lines)),
        sum([w in _COMMON[lang] for w in words]) / n, sentence_chars(t) / solid, math.log1p(sum(map(len, lines)) / max(1, len(lines))),
        min(1.0, len(set(words)) / math.sqrt(n) / 8), len(_CELL.findall(t)) / n,
    ]


def text_statistics(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, language, STATS...) of every document with text."""
    need(documents, doc_id, text)
    own = documents.select(F.col(doc_id).alias("doc_id"),
        F.col(text).alias("_text")).filter(F.col("doc_id").isNotNull() & F.col("_text").rlike(r"(?U)\S"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [statistics(t) for t in pdf["_text"]]
            out = pd.DataFrame([x for _, x in got], columns=list(STATS), dtype=float)
            out.insert(0, "language", [x for x, _ in got])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    kind = own.schema["doc_id"].dataType.simpleString()
    return mapped(own, work, f"doc_id {kind}, language string, " + ", ".join(f"{s} double" for s in STATS))


#: How a statistic enters the distance.
_ROOT, _LOG = [STATS.index(n) for n in ("symbol_ratio", "digit_ratio", "mark_ratio")], STATS.index("word_length")


def scaled(x: np.ndarray) -> np.ndarray:
    z = np.array(x, float)
    z[:, _ROOT] = np.sqrt(z[:, _ROOT])
    z[:, _LOG] = np.log(z[:, _LOG] + 0.1)
    return z


class Shape:
    """Location and inverse covariance of one language's prose, over scaled statistics."""

    def __init__(self, mean: np.ndarray, cov: np.ndarray):
        self.mean = mean
        self.inverse = np.linalg.inv(cov + np.diag(np.full(len(mean), 1e-4)))

    def contributions(self, x: np.ndarray) -> np.ndarray:
        z = scaled(x) - self.mean
        return z * (z @ self.inverse)


def _wilson(p: float, d: int) -> float:
    """Quantile of chi-squared with d degrees by Wilson and Hilferty; p is 0.975 or 0.999."""
    return d * (1 - 2 / (9 * d) + {0.975: 1.95996, 0.999: 3.09023}[p] * math.sqrt(2 / (9 * d))) ** 3


def labelled(stats: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", label: str = "label", max_labels: int = 20_000) -> pd.DataFrame:
    """Statistics of at most max_labels labelled documents, chosen by hash, and whether they are prose."""
    own = labels.select(F.col(doc_id).alias("doc_id"),
        F.lower(F.trim(F.col(label))).alias("label")).filter("label in ('prose', 'list', 'table', 'junk')").groupBy("doc_id")
    own = own.agg(F.min(F.col("label") == "prose").alias("low"),
        F.max(F.col("label") == "prose").alias("high")).filter("low = high").orderBy(F.xxhash64("doc_id")).limit(max_labels)
    rows = stats.join(F.broadcast(own.select("doc_id", F.col("low").alias("prose"))), "doc_id").dropDuplicates(["doc_id"])
    return rows.select("language", "prose", *STATS).toPandas()


def distances(rows: pd.DataFrame, shapes: dict[str, Shape]) -> np.ndarray:
    x, out = rows[list(STATS)].to_numpy(float), np.zeros(len(rows))
    for g in rows["language"].unique():
        at = (rows["language"] == g).to_numpy()
        out[at] = shapes[g].contributions(x[at]).sum(1)
    return out


def best_limit(distance: np.ndarray, prose: np.ndarray) -> float:
    """The distance that separates prose from the rest best."""
    base = _wilson(0.999, len(STATS))
    if prose.all() or not prose.any():
        return base
    cuts = np.unique(np.concatenate([[base], distance[distance > 0]]))
    order = np.sort(distance)
    bad = np.sort(distance[~prose])
    said = len(order) - np.searchsorted(order, cuts, "right")
    hit = len(bad) - np.searchsorted(bad, cuts, "right")
    f1 = 2 * hit / (said + len(bad))
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    above = np.append(cuts[1:], cuts[-1])
    at = best[np.argmax(above[best] / cuts[best])]
    return float(np.sqrt(cuts[at] * above[at]))


def _start(stats: DataFrame, rows: pd.DataFrame) -> dict[str, Shape]:
    middle = stats.groupBy("language").agg(*[F.percentile_approx(s, 0.5, 1000).alias(s) for s in STATS]).collect()
    medians = {r["language"]: scaled(np.array([[r[s] for s in STATS]], float))[0] for r in middle}
    good = rows[rows["prose"].astype(bool)]
    for g, part in good.groupby("language"):
        if len(part) >= 5:
            medians[g] = np.median(scaled(part[list(STATS)].to_numpy(float)), axis=0)
    if len(good):
        away = np.concatenate([scaled(part[list(STATS)].to_numpy(float)) - medians[g] for g, part in good.groupby("language")])
        cov = np.cov(away.T) if len(away) > 3 * len(STATS) else np.diag(np.maximum(1.4826 * np.median(np.abs(away), axis=0), 0.05) ** 2)
        return {g: Shape(m, cov) for g, m in medians.items()}
    named = stats.join(F.broadcast(stats.sparkSession.createDataFrame([(k, [float(v) for v in m]) for k, m in medians.items()],
        "language string, m array<double>")), "language") if medians else stats.limit(0)
    value = lambda i, s: F.sqrt(s) if i in _ROOT else F.log(F.col(s) + 0.1) if i == _LOG else F.col(s)
    off = [F.percentile_approx(F.abs(value(i, s) - F.get("m", F.lit(i))), 0.5, 1000).alias(s) for i, s in enumerate(STATS)] if medians else []
    spread = {r["language"]: np.maximum(1.4826 * np.array([r[s] for s in STATS]),
        0.05) for r in named.groupBy("language").agg(*off).collect()} if medians else {}
    return {g: Shape(m, np.diag(spread[g] ** 2)) for g, m in medians.items()}


def fit_prose(stats: DataFrame, rows: pd.DataFrame, steps: int = 2) -> tuple[dict[str, Shape], float]:
    """(the prose shape of every language, the limit), from all documents and the labelled rows."""
    d = len(STATS)
    shapes = _start(stats, rows)
    prose = rows["prose"].to_numpy(bool)
    limit = best_limit(distances(rows, shapes), prose)
    named = stats.select("language", *STATS)
    for _ in range(steps if shapes else 0):
        now, within = shapes, limit

        def sums(batches: Iterator[pd.DataFrame], now=now, within=within) -> Iterator[pd.DataFrame]:
            held: dict[str, np.ndarray] = {}
            for pdf in batches:
                for g, part in pdf.groupby("language"):
                    x = part[list(STATS)].to_numpy(float)
                    x = scaled(x[now[g].contributions(x).sum(1) <= within])
                    one = np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
                    held[g] = held[g] + one if g in held else one
            if held:
                yield pd.DataFrame([(g, i, v) for g, a in held.items() for i, v in enumerate(a)], columns=["g", "i", "v"])

        total = {g: np.zeros(1 + d + d * d) for g in shapes}
        for r in mapped(named, sums, "g string, i int, v double").groupBy("g", "i").agg(F.sum("v").alias("v")).collect():
            total[r["g"]][r["i"]] = r["v"]
        for g, t in total.items():
            if t[0] > 3 * d:
                mean = t[1 : d + 1] / t[0]
                shapes = shapes | {g: Shape(mean, t[d + 1 :].reshape(d, d) / t[0] - np.outer(mean, mean))}
        limit = best_limit(distances(rows, shapes), prose)
    return shapes, limit


def score_quality(stats: DataFrame, shapes: dict[str, Shape]) -> DataFrame:
    """stats with distance (squared) and contributions (map from statistic to its term)."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema) + ", distance double, contributions map<string,double>"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, terms = pdf[list(STATS)].to_numpy(float), np.zeros((len(pdf), len(STATS)))
            for g in pdf["language"].unique():
                at = (pdf["language"] == g).to_numpy()
                terms[at] = shapes[g].contributions(x[at])
            yield pdf.assign(distance=terms.sum(1), contributions=[dict(zip(STATS, row)) for row in terms.tolist()])

    return mapped(stats, work, schema)


def find_junk(scored: DataFrame, limit: float) -> DataFrame:
    """The scored documents beyond the limit."""
    return scored.filter(F.col("distance") > limit)


def judge(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """(scored documents, limit): statistics, distance and contributions of every document with text."""
    stats = settled(text_statistics(documents))
    shapes, limit = fit_prose(stats, labelled(stats, labels))
    return score_quality(stats, shapes), limit
