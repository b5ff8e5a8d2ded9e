"""Downloads of the files that a source manifest lists, in parallel tasks, with a report."""

from __future__ import annotations

import hashlib
import urllib.request
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatework.runtime import mapped
from slatework.sources.readers import manifest_files

#: (url) -> (content, content type)
Fetch = Callable[[str], tuple[bytes, str]]
REPORT = "source_id string, pair_id string, topic string, role string, path string, url string, content_type string, bytes bigint, sha256 string, license string, redistribution string"


def by_http(url: str, seconds: int = 60) -> tuple[bytes, str]:
    asked = urllib.request.Request(url, headers={"User-Agent": "slatework"})
    with urllib.request.urlopen(asked, timeout=seconds) as answer:
        return answer.read(), answer.headers.get_content_type()


def downloaded(manifest: DataFrame, root: str, fetch: Fetch = by_http, tasks: int = 8) -> DataFrame:
    """REPORT rows of every file of the manifest, written to root/source/pair/role/filename (root is a shared folder).

    A file named .pdf whose content is no PDF fails the run. The result is lazy: it downloads when it is written.
    """
    names = [x.split()[0] for x in REPORT.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for f in pdf.to_dict("records"):
                content, kind = fetch(f["url"])
                if f["filename"].endswith(".pdf") and content[:4] != b"%PDF":
                    raise ValueError(f"no PDF came from {f['url']}")
                place = Path(root, f["source_id"], f["pair_id"], f["role"], f["filename"])
                place.parent.mkdir(parents=True, exist_ok=True)
                place.write_bytes(content)
                known = {k: f[k] for k in ("source_id", "pair_id", "topic", "role", "url", "license", "redistribution")}
                rows.append(known | {"path": str(place), "content_type": kind, "bytes": len(content), "sha256": hashlib.sha256(content).hexdigest()})
            yield pd.DataFrame(rows, columns=names)

    files = manifest_files(manifest).filter("filename is not null and url is not null").repartition(tasks, F.xxhash64("url"))
    return mapped(files, work, REPORT)
