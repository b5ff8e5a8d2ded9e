"""Page images of course files: converters are injected callables, tried in order; the result is a page manifest.

A converter takes (PDF path, folder, dpi) and returns the image files in page order; it raises RuntimeError where it
cannot work. Files are rendered by the tasks of a DataFrame, so the output folder must be shared by all workers.
"""

from __future__ import annotations

import hashlib
import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatework import schemas
from slatework.runtime import mapped

Converter = Callable[[str, str, int], list[str]]
_HEAD = b"\x89PNG\r\n\x1a\n"


def _tool(name: str) -> str:
    found = shutil.which(name)
    if found is None:
        raise RuntimeError(f"the program {name} is not installed")
    return found


def _called(*command: str) -> None:
    done = subprocess.run(command, capture_output=True, text=True, check=False)
    if done.returncode:
        raise RuntimeError(f"{Path(command[0]).name} failed: {done.stderr.strip()[-500:]}")


def by_poppler(pdf: str, folder: str, dpi: int) -> list[str]:
    _called(_tool("pdftoppm"), "-png", "-r", str(dpi), pdf, f"{folder}/p")
    return [str(p) for p in sorted(Path(folder).glob("p-*.png"), key=lambda p: int(p.stem.rsplit("-", 1)[1]))]


def by_mupdf(pdf: str, folder: str, dpi: int) -> list[str]:
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("the package PyMuPDF is not installed") from e
    out = []
    with fitz.open(pdf) as document:
        for n, page in enumerate(document, 1):
            out.append(f"{folder}/m-{n}.png")
            page.get_pixmap(dpi=dpi, alpha=False).save(out[-1])
    return out


def pdf_of(path: str, folder: str) -> str:
    """A PDF made from a PPTX file."""
    _called(_tool("soffice"), "--headless", "--convert-to", "pdf", "--outdir", folder, path)
    made = Path(folder) / f"{Path(path).stem}.pdf"
    if not made.is_file():
        raise RuntimeError(f"no PDF came of {Path(path).name}")
    return str(made)


def png_size(content: bytes) -> tuple[int, int]:
    """(width, height) from the header; ValueError for anything but a PNG file."""
    if content[:8] != _HEAD or content[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    return int.from_bytes(content[16:20], "big"), int.from_bytes(content[20:24], "big")


def render_file(path: str, output: str, dpi: int = 144, converters: Sequence[Converter] = (by_poppler, by_mupdf),
        to_pdf: Callable[[str, str], str] = pdf_of) -> list[dict]:
    """Rows (document_id, page_number, image_path, source_path, width, height, sha256) of one PDF or PPTX file.

    Images are named page-0001.png and on, in a folder named after the file. ValueError for a dpi below 1 or another
    kind of file, FileNotFoundError for none, RuntimeError with all reasons where no converter works.
    """
    source = Path(path)
    if not source.is_file():
        raise FileNotFoundError(path)
    if dpi < 1:
        raise ValueError("dpi must be at least 1")
    if source.suffix.lower() not in (".pdf", ".pptx"):
        raise ValueError(f"only PDF and PPTX files have page images: {source.name}")
    document = "doc-" + hashlib.sha256(source.read_bytes()).hexdigest()[:16]
    reasons = []
    Path(output).mkdir(parents=True, exist_ok=True)
    with tempfile.TemporaryDirectory(prefix=".rendering-", dir=output) as work:  # beside the images, on the shared folder
        pdf = to_pdf(str(source), work) if source.suffix.lower() == ".pptx" else str(source)
        for number, convert in enumerate(converters):
            own = Path(work) / str(number)
            own.mkdir()
            try:
                images = convert(pdf, str(own), dpi)
            except RuntimeError as e:
                reasons.append(str(e))
                continue
            target = Path(output) / source.stem
            target.mkdir(parents=True, exist_ok=True)
            rows = []
            for page, image in enumerate(images, 1):
                content = Path(image).read_bytes()
                width, height = png_size(content)
                place = target / f"page-{page:04d}.png"
                place.write_bytes(content)
                rows.append({"document_id": document, "page_number": page, "image_path": str(place), "source_path": str(source), "width": width,
                    "height": height, "sha256": hashlib.sha256(content).hexdigest()})
            return rows
    raise RuntimeError("; ".join(reasons) or "no converter was given")


def rendered_pages(spark: SparkSession, paths: Sequence[str], output: str, dpi: int = 144, converters: Sequence[Converter] = (by_poppler, by_mupdf),
        to_pdf: Callable[[str, str], str] = pdf_of,
                   judged: DataFrame | None = None) -> DataFrame:
    """RENDERED_PAGE rows, one file a task; judged pages (document_id, page_number, requires_vision, role, visual_risk_score) add their judgement.

    A page without judgement is content that does not require vision, of risk 0.
    """
    files = spark.createDataFrame([(str(p),) for p in paths], "path string").repartition(max(1, len(paths)), "path")
    plain = "document_id string, page_number int, image_path string, source_path string, width int, height int, sha256 string"
    names = [x.split()[0] for x in plain.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                yield pd.DataFrame(render_file(path, output, dpi, converters, to_pdf), columns=names)

    out = mapped(files, work, plain)
    known = ["requires_vision", "role", "visual_risk_score"]
    if judged is not None:
        out = out.join(judged.select("document_id", "page_number", *known), ["document_id", "page_number"], "left")
    else:
        out = out.withColumns({"requires_vision": F.lit(None).cast("boolean"), "role": F.lit(None).cast("string"),
            "visual_risk_score": F.lit(None).cast("double")})
    out = out.withColumns({"requires_vision": F.coalesce("requires_vision", F.lit(False)), "role": F.coalesce("role", F.lit("content")),
        "visual_risk_score": F.coalesce("visual_risk_score", F.lit(0.0))})
    return out.select(*schemas.RENDERED_PAGE.names)
