"""Column functions on text. White space and digits are Unicode's, lines end as Python's splitlines ends them."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from slatework.runtime import ship

WS = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
NL = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"
#: Fixed values that results depend on: end marks, words of a footer, section headings, token patterns.
ENDS = r"[.!?。！？]$"

FOOTER = r"copyright|university|unimelb|lecture|slide|page|<n>\s*/\s*<n>"
SECTION_HAN, SECTION_LATIN = r"^第[0-9一二三四五六七八九十百]+[章节篇单元]", r"(?i)^(chapter|unit|module|part)\s+[0-9ivx]+\b"
LATIN_TOKEN, FORMULA_TOKEN, HAN_RUN = r"[a-z0-9]+(?:[-_.][a-z0-9]+)*", "[\u0370-\u03ff]+|[+*/=^]+", "[\u3400-\u9fff]+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def compact(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+", "")


def lines(c: Column) -> Column:
    """The non-blank lines."""
    return F.filter(F.split(c, NL, -1), lambda x: F.length(strip(x)) > 0)


def repeated_line_form(c: Column) -> Column:
    """Stripped, lower-cased, digit runs as <n>, white-space runs as one space."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"\p{Nd}+", "<n>"), f"{WS}+", " ")


def looks_like_footer(c: Column) -> Column:
    return c.rlike(FOOTER)


def heading(title: Column, text: Column) -> Column:
    """A title of 1 to 100 characters, else a first line that is a Markdown heading or short and without end mark."""
    first = F.coalesce(strip(F.get(lines(text), F.lit(0))), F.lit(""))
    bare = lambda x: F.btrim(x, F.lit("# "))
    fits = first.startswith("#") | (F.length(first).between(1, 60) & ~first.rlike(ENDS))
    return F.when(F.length(title).between(1, 100), bare(title)).when(fits, bare(first))


def starts_section(head: Column) -> Column:
    h = F.btrim(head, F.lit("# "))
    return F.coalesce(h.rlike(SECTION_HAN) | h.rlike(SECTION_LATIN), F.lit(False))


def truncated(text: Column, limit: int) -> Column:
    """At most limit characters; cut after the last sentence or line end if that lies in the second half."""
    head = F.substring(text, 1, limit)
    whole = F.regexp_extract(head, r"(?s)^(.*[。！？.!?\n])", 1)
    return F.when(F.length(text) <= limit, text).otherwise(strip(F.when(F.length(whole) - 1 >= limit // 2, whole).otherwise(head)))


def sentences(text: Column) -> Column:
    parts = F.split(F.regexp_replace(strip(text), r"[ \t]+", " "), rf"(?<=[。！？.!?；;]){WS}*|\n+", -1)
    return F.filter(F.transform(parts, strip), lambda x: F.length(x) > 0)


def window_bounds(sizes: list[int], limit: int, overlap: int) -> list[tuple[int, int]]:
    """[first, after the last) of each window over parts of these sizes; a window holds one part at least."""
    ends, at, out = [0, *accumulate(sizes)], 0, []
    while at < len(sizes):
        after = max(at + 1, bisect_right(ends, ends[at] + limit) - 1)
        out.append((at, after))
        if after == len(sizes):
            break
        at = max(at + 1, after - max(0, overlap))
    return out


def windows(parts: Column, limit: int, overlap: int) -> Column:
    """Greedy windows of sentences, joined by a space. One pass over prefix sums per row, in Arrow batches."""
    ship(SparkSession.active())

    @F.pandas_udf("array<string>")
    def greedy(s: pd.Series) -> pd.Series:
        return s.map(lambda x: [] if x is None else [" ".join(x[a:b]) for a, b in window_bounds([len(t) for t in x], limit, overlap)])

    return greedy(parts)


def mixed_tokens(text: Column) -> Column:
    """Latin words, formula signs and Greek runs, then one- and two-character runs of Han text."""
    low = F.lower(text)
    found = lambda p: F.regexp_extract_all(low, F.lit(p), F.lit(0))
    pairs = lambda r: F.when(F.length(r) > 1, F.transform(F.sequence(F.lit(1), F.length(r) - 1),
        lambda i: F.substr(r, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    han = F.flatten(F.transform(found(HAN_RUN), lambda r: F.concat(F.split(r, ""), pairs(r))))
    return F.concat(found(LATIN_TOKEN), found(FORMULA_TOKEN), han)


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 12))


def content_id(content: Column) -> Column:
    return F.concat(F.lit("doc-"), F.substring(F.sha2(content, 256), 1, 16))
