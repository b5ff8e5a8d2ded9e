"""Splitting oversized items at natural boundaries.

Sizes are prefix sums of token starts over the characters of an item (one token per code point by default, or the
tokens of a public tokenizer), so the size of any stretch is a difference of two entries. Natural boundaries
(paragraph, line, sentence, white space) are sorted arrays; a piece ends at the last boundary under the limit, found
by binary search, the next piece starts `overlap` tokens before that end, and only where no boundary lies under the
limit is the text cut hard. An overlap is shortened where keeping it whole would force a cut through a stretch that
fits into a piece by itself, so a cut is forced exactly if some stretch without white space and sentence ends is
longer than the limit.

Items are independent: no shuffle, one pass, constant state. Items within the limit never leave the JVM.

Defined cases: null and empty texts and items within the limit give no pieces; a repeated item gives its pieces
again (callers deduplicate by item id); pieces joined without their overlaps are the item, character for character.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slatework.runtime import mapped

ENDERS = ".!?;。！？；"
_SPACE = re.compile(r"\s+")
_LEVELS = (re.compile(r"\n[^\S\n]*\n\s*"), re.compile(r"\n\s*"), re.compile(rf"[{re.escape(ENDERS)}]+[\"'”’)\]]*\s*"), _SPACE)
_EDGE = re.compile(rf"[\s{re.escape(ENDERS)}]")
#: Tried in this order within the second half of a piece; the last two, at any place.
PIECES = T.StructType([
    T.StructField("item_id", T.StringType()), T.StructField("piece_no", T.LongType()), T.StructField("piece_start", T.LongType()),
    T.StructField("piece_end", T.LongType()), T.StructField("tokens", T.LongType()), T.StructField("overlap", T.LongType()),
    T.StructField("piece_cut", T.StringType()), T.StructField("item_cut", T.StringType()), T.StructField("piece_text", T.StringType()),
])


def cut(text: str, limit: int, overlap: int, prefix: np.ndarray | None = None) -> list[tuple[int, int, bool]]:
    """(start, end, hard) of each piece, in order; prefix[i] is the number of tokens that begin before character i."""
    n = len(text)
    p = np.arange(n + 1) if prefix is None else prefix
    levels = [np.array([m.end() for m in rx.finditer(text)], np.int64) for rx in _LEVELS]
    edges = np.array([m.start() for m in _EDGE.finditer(text)], np.int64)
    anywhere = np.unique(np.concatenate([*levels, edges, edges + 1]))

    def reach(s: int) -> int:
        return int(np.searchsorted(p, p[s] + limit, "right")) - 1

    def last(a: np.ndarray, low: int, high: int) -> int:
        i = int(np.searchsorted(a, high, "right")) - 1
        return int(a[i]) if i >= 0 and a[i] > low else -1

    out: list[tuple[int, int, bool]] = []
    start = done = 0
    while True:
        far = max(reach(start), start + 1, done + 1)
        if far >= n:
            out.append((start, n, False))
            return out
        end = next((e for a in levels if (e := last(a, max(done, start + (far - start) // 2), far)) >= 0), -1)
        if end < 0:
            end = last(anywhere, done, far)
        hard = end < 0
        if hard and start < done:
            wide = reach(done)
            if wide >= n or (end := last(anywhere, done, wide)) >= 0:
                end, hard = (n if wide >= n else end), False
                start = min(done, int(np.searchsorted(p, p[end] - limit, "left")))
        end = far if hard else end
        out.append((start, end, hard))
        if end >= n:
            return out
        done = end
        start = max(int(np.searchsorted(p, p[end] - overlap, "left")), start + 1)
        start = min(start, end)


def _token_prefix(text: str, encoding) -> np.ndarray:
    """Prefix sums of token starts; a token that begins inside a character counts at that character."""
    starts = np.zeros(len(text.encode("utf-8", "replace")) + 1, np.int64)
    at = 0
    for piece in encoding.decode_tokens_bytes(encoding.encode_ordinary(text)):
        starts[at] += 1
        at += len(piece)
    widths = np.array([len(c.encode("utf-8", "replace")) for c in text])
    offsets = np.concatenate([[0], np.cumsum(widths)])
    return np.concatenate([[0], np.cumsum(starts)])[offsets]


def load_ranks(path: str):
    """A tiktoken encoding of a public vocabulary file."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def split_oversized(items: DataFrame, item_id: str, text: str, limit: int, overlap: int = 0, *, keep: tuple[str, ...] = (),
                    with_text: bool = True, vocabulary: str | None = None) -> DataFrame:
    """PIECES plus the columns named in keep, of each item above limit.

    vocabulary: path of a .tiktoken vocabulary file; sizes are then its tokens instead of code points.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    own = items.select(F.col(item_id).cast("string").alias("_id"), F.col(text).alias("_text"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    # A token has at least one byte: what has no more bytes than the limit cannot exceed it.
    size = F.length("_text") if vocabulary is None else F.octet_length("_text")
    own = own.filter(size > limit)
    schema = T.StructType([*PIECES.fields, *[T.StructField(c, own.schema[f"_keep_{c}"].dataType) for c in keep]])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = load_ranks(vocabulary) if vocabulary else None
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                body = row[1]
                prefix = _token_prefix(body, encoding) if encoding else None
                if prefix is not None and prefix[-1] <= limit:
                    continue
                pieces = cut(body, limit, overlap, prefix)
                whole = "forced" if any(h for _, _, h in pieces) else "natural"
                done = 0
                for k, (s, e, h) in enumerate(pieces, 1):
                    size_of = (lambda a, b: b - a) if prefix is None else (lambda a, b: int(prefix[b] - prefix[a]))
                    rows.append((row[0], k, s, e, size_of(s, e), size_of(s, done) if k > 1 else 0, "forced" if h else "natural", whole,
                        body[s:e] if with_text else None, *row[2:]))
                    done = e
            yield pd.DataFrame(rows, columns=schema.names)

    return mapped(own, work, schema)
