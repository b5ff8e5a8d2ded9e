"""Sources: course files, JSON lines, chunks, page manifests, caches and source manifests."""

from __future__ import annotations

import io
from collections.abc import Iterator
from pathlib import PurePath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatework import schemas
from slatework.functions import text as X
from slatework.operators.pages import prepare_pages
from slatework.runtime import mapped, need

SUFFIXES = {".pdf": "pdf", ".pptx": "pptx", ".txt": "text", ".md": "text"}


def parser_of(path: str) -> str:
    """pdf, pptx or text, by the lower-cased suffix; ValueError for another one."""
    try:
        return SUFFIXES[PurePath(path).suffix.lower()]
    except KeyError:
        raise ValueError(f"unsupported file type: {path}") from None


def _meta(**known):
    kinds = {f.name: f.dataType for f in schemas.PAGE_META}
    return F.struct(*[known.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])


#: Fixed value: what ends a page of a text file.
PAGE_END = r"(?im)\f|^\s*---\s*page\s*---\s*$"


def pages_of_text(files: DataFrame) -> DataFrame:
    """PAGE rows of text files (path, content): pages end at a form feed or a line '--- page ---' and keep their numbers.

    The title is the first line if it is a Markdown heading, with its marks.
    """
    body = F.regexp_replace(F.decode("content", "UTF-8"), r"\r\n?", "\n")
    parts = files.select(X.content_id(F.col("content")).alias("document_id"), F.element_at(F.split("path", "/"), -1).alias("name"),
        F.posexplode(F.split(body, PAGE_END, -1)).alias("p", "raw"))
    parts = parts.withColumn("text", X.strip(F.col("raw"))).filter(F.length("text") > 0)
    first = X.strip(F.get(X.lines(F.col("text")), F.lit(0)))
    return parts.select("document_id", (F.col("p") + 1).alias("page_number"), "text", F.when(first.startswith("#"), first).alias("title"),
        _meta(parser=F.lit("text"), source_name=F.col("name")).alias("metadata"))


_PARSED = "document_id string, page_number int, text string, title string, width double, height double, rotation int, images int, notes string, parser string, blocks array<struct<type:string,text:string,left:bigint,top:bigint,width:bigint,height:bigint>>, name string"


def _found(get, otherwise=None):
    """What get gives, or otherwise where a file is not sound in this place."""
    try:
        return get()
    except Exception:  # parsers raise whatever their decoders do
        return otherwise


def _pdf_pages(content: bytes) -> Iterator[dict]:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ImportError("reading PDF files needs the optional package pypdf") from e
    for page in PdfReader(io.BytesIO(content)).pages:
        wide, high = (round(float(x), 2) for x in (page.mediabox.width, page.mediabox.height))
        yield {"text": (page.extract_text() or "").strip(), "width": wide, "height": high, "rotation": int(page.get("/Rotate") or 0),
            "images": _found(lambda p=page: len(p.images), 0), "parser": "pypdf"}


def _shape_block(shape) -> dict | None:
    """Kind, text and place of a table or text shape; None for other shapes and empty ones."""
    if getattr(shape, "has_table", False):
        grid = [[cell.text.strip() for cell in row.cells] for row in shape.table.rows]
        kind, text = "table", "\n".join(" | ".join(cells) for cells in grid if any(cells))
    else:
        kind, text = "text", shape.text.strip() if hasattr(shape, "text") else ""
    place = {k: int(getattr(shape, k, None) or 0) for k in ("left", "top", "width", "height")}
    return {"type": kind, "text": text} | place if text else None


def _pptx_pages(content: bytes) -> Iterator[dict]:
    try:
        from pptx import Presentation
        from pptx.enum.shapes import MSO_SHAPE_TYPE
    except ImportError as e:
        raise ImportError("reading PPTX files needs the optional package python-pptx") from e
    for slide in Presentation(io.BytesIO(content)).slides:
        blocks = [b for s in slide.shapes if (b := _shape_block(s))]
        blocks.sort(key=lambda b: (b["top"], b["left"]))
        head = slide.shapes.title
        yield {"text": "\n".join(b["text"] for b in blocks), "title": head.text.strip() if head is not None else None, "blocks": blocks,
            "parser": "python-pptx",
               "images": sum(_found(lambda s=s: s.shape_type == MSO_SHAPE_TYPE.PICTURE, False) for s in slide.shapes),
               "notes": (slide.notes_slide.notes_text_frame.text.strip() or None) if slide.has_notes_slide else None}


def _pages_by(files: DataFrame, parse) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"document_id": i, "name": n, "page_number": k} | p for i, n, c in zip(pdf["document_id"], pdf["name"], pdf["content"]) for k,
                p in enumerate(parse(bytes(c)), 1)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _PARSED.split(", ")])

    named = files.select(X.content_id(F.col("content")).alias("document_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    got = mapped(named, work, _PARSED)
    meta = _meta(parser=F.col("parser"), blocks=F.col("blocks"), source_name=F.col("name"), width_points=F.col("width"),
        height_points=F.col("height"), rotation=F.col("rotation"), image_count=F.col("images"), speaker_notes=F.col("notes"))
    return got.select("document_id", "page_number", "text", "title", meta.alias("metadata"))


def read_course_files(spark: SparkSession, *paths: str, clean: bool | None = None) -> DataFrame:
    """PAGE rows (with the columns of page preparation for PDF and PPTX, or for all if clean) of files or folders.

    ValueError if two files have the same content.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths)).select("path", "content")
    suffix = F.lower(F.regexp_extract("path", r"\.[^./]+$", 0))
    kinds = {parser_of(f"x{r[0]}") for r in files.select(suffix).distinct().limit(100).collect()}
    twice = files.groupBy(F.sha2("content", 256)).agg(F.count("*").alias("n"), F.min("path").alias("a"),
        F.max("path").alias("b")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"the same content twice: {twice[0]['a']} and {twice[0]['b']}")
    out = None
    for kind in sorted(kinds):
        own = files.filter(suffix.isin(*[s for s, k in SUFFIXES.items() if k == kind]))
        pages = pages_of_text(own) if kind == "text" else _pages_by(own, _pdf_pages if kind == "pdf" else _pptx_pages)
        if clean or (clean is None and kind != "text"):
            pages = prepare_pages(pages)
        out = pages if out is None else out.unionByName(pages, allowMissingColumns=True)
    return out


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines by schema; blank lines are skipped, a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of the lines that are not JSON objects."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"),
        F.posexplode(F.split("value", r"\r?\n", -1)).alias("p", "line"))
    parsed = F.try_parse_json("line") if hasattr(F, "try_parse_json") else F.from_json("line", "map<string,string>")
    object_like = F.col("line").rlike(r"^\s*\{") & parsed.isNotNull()
    return text.filter((F.length(F.trim("line")) > 0) & ~object_like).select("path", (F.col("p") + 1).alias("line_no"), "line")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return with_chunk_defaults(read_jsonl(spark, path, schemas.CHUNK))


def with_chunk_defaults(chunks: DataFrame) -> DataFrame:
    """Old rows lack level and child_ids: they are passages without children."""
    return chunks.withColumns({"level": F.coalesce("level", F.lit("passage")), "child_ids": F.coalesce("child_ids", F.array().cast("array<string>"))})


def read_page_manifests(spark: SparkSession, *paths: str) -> DataFrame:
    """RENDERED_PAGE rows of manifests (globs allowed); ValueError if a page stands in them twice."""
    pages = spark.read.schema(schemas.RENDERED_PAGE).option("mode", "FAILFAST").json(list(paths))
    twice = repeated_keys(pages, "document_id", "page_number").limit(1).collect()
    if twice:
        raise ValueError(f"page {twice[0]['page_number']} of {twice[0]['document_id']} stands in the manifests twice")
    return pages


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    need(df, *keys)
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def manifest_files(manifest: DataFrame) -> DataFrame:
    """One row per file of a source manifest; sources and pairs without files, and missing arrays, give none."""
    pairs = manifest.select("source_id", "license", "redistribution", F.explode("pairs").alias("p"))
    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"p.{r}").alias("files")) for r in ("courseware", "review")])
    each = pairs.select("source_id", "license", "redistribution", "p.pair_id", "p.topic", F.explode(roles).alias("r"))
    each = each.select("source_id", "pair_id", "topic", "r.role", "license", "redistribution", F.explode("r.files").alias("f"))
    return each.select("source_id", "pair_id", "topic", "role", F.col("f.filename").alias("filename"), F.col("f.url").alias("url"), "license",
        "redistribution")
