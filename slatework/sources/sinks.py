"""Sinks: JSON lines, Parquet, reports and review pages."""

from __future__ import annotations

import hashlib
import html
import json
import shutil
from pathlib import Path

from pyspark.sql import DataFrame


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object per line, in a folder of part files; nulls are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def report(experiment: dict, dataset: dict, metrics: DataFrame, path: str | None = None, diagnostics: DataFrame | None = None) -> dict:
    """A report of an experiment (its summary rows are few); written as JSON if path is given.

    Diagnostics, a row per query and system, go line by line into a file beside the report (path with .diagnostics.jsonl);
    the report names it. Without a path they are returned.
    """
    out = {"experiment": experiment, "dataset": dataset, "metrics": {r["question_type"]: {k: v for k,
        v in r.asDict().items() if k != "question_type"} for r in metrics.collect()}}
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
    if diagnostics is not None and path:
        beside = f"{path}.diagnostics.jsonl"
        with open(beside, "w", encoding="utf-8") as lines:
            for r in diagnostics.orderBy("query_id", "system").toLocalIterator():
                lines.write(json.dumps(r.asDict(recursive=True), ensure_ascii=False) + "\n")
        out["query_diagnostics"] = beside
    elif diagnostics is not None:
        out["query_diagnostics"] = [r.asDict(recursive=True) for r in diagnostics.orderBy("query_id", "system").toLocalIterator()]
    if path:
        Path(path).write_text(json.dumps(out, ensure_ascii=False, indent=2), encoding="utf-8")
    return out


def copied_images(rows: DataFrame, folder: str) -> tuple[dict[tuple[str, int], str], int]:
    """({(document_id, page): relative path}, missing): images of review rows copied beside a review page.

    A page whose image is not named or not there counts as missing once.
    """
    places, missing = {}, 0
    for r in rows.select("document_id", "page", "image_path").filter("page is not null").distinct().toLocalIterator():
        source = Path(r["image_path"]) if r["image_path"] else None
        if source is None or not source.is_file():
            missing += 1
            continue
        target = Path(folder) / f"{r['document_id']}-page-{r['page']:04d}{source.suffix.lower()}"
        target.parent.mkdir(parents=True, exist_ok=True)
        shutil.copy2(source, target)
        places[r["document_id"], r["page"]] = f"{target.parent.name}/{target.name}"
    return places, missing


def write_review_page(rows: DataFrame, path: str, title: str, decisions: tuple[str, ...], images: dict[tuple[str, int], str] | None = None) -> dict:
    """One HTML page for people to decide rows on and export them.

    A review set is what people read one by one, so its rows are written one after another and never held together;
    images shows them by (document_id, page).
    """
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    options = "".join(f"<option>{html.escape(d)}</option>" for d in decisions)
    mark, count = hashlib.sha256(), 0
    with open(path, "w", encoding="utf-8") as out:
        out.write(f'<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><button onclick="save()">Export</button><div id="list"></div>\n<script>const rows=[\n')
        for r in rows.toLocalIterator():
            row = r.asDict(recursive=True)
            if images is not None:
                row["image"] = images.get((row["document_id"], row["page"]))
            line = json.dumps(row, ensure_ascii=False, sort_keys=True, default=str).replace("</", "<\\/")
            mark.update(line.encode())
            out.write(f"{line},\n")
            count += 1
        name = mark.hexdigest()[:16]
        out.write(f"""];const box=document.getElementById('list');
for(const row of rows){{const d=document.createElement('section'),pre=document.createElement('pre'),s=document.createElement('select'),n=document.createElement('input');
pre.textContent=JSON.stringify(row,null,1);s.innerHTML='{options}';s.value=row.review_decision||s.value;s.onchange=()=>row.review_decision=s.value;n.placeholder='note';n.onchange=()=>row.review_note=n.value;d.append(pre);
if(row.image){{const i=document.createElement('img');i.src=row.image;i.style.maxWidth='100%';d.append(i)}}d.append(s,n);box.append(d)}}
function save(){{const a=document.createElement('a');a.href=URL.createObjectURL(new Blob([rows.map(r=>JSON.stringify(r)).join('\\n')+'\\n']));a.download='review-{name}.jsonl';a.click()}}</script>""")
    return {"rows": count, "fingerprint": name, "output": path}
