"""The command line end to end on literal files, with models that are plain functions."""

import json

from slatework import cli

NAMES = ["gradient", "matrix", "kernel", "graph"]


def encoder():
    return lambda texts: [[float(t.lower().count(n)) + 0.01 for n in NAMES] for t in texts]


def pair_model():
    return lambda queries, texts: [float(-len(t)) for t in texts]


def one_page(pdf, folder, dpi):
    """A converter that makes one PNG header of dpi x 1."""
    place = f"{folder}/x.png"
    with open(place, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + dpi.to_bytes(4, "big") + (1).to_bytes(4, "big"))
    return [place]


def no_page(pdf, folder, dpi):
    raise RuntimeError("this one never works")


def fake_fetch(url):
    return (b"%PDF-1.7 x" if "good" in url else b"<html>"), "application/pdf"


def fake_training():
    def fit(rows, settings):
        with open(f"{settings['output_dir']}/weights", "w") as f:
            f.write(str(len(rows)))
        return "cpu"

    return fit


def test_render_download_and_train(spark, tmp_path, capsys):
    def run(*args, code=0):
        assert cli.main([str(a) for a in args], spark) == code
        got = capsys.readouterr()
        return json.loads(got.out) if code == 0 else got.err

    (tmp_path / "a.pdf").write_bytes(b"%PDF one")
    (tmp_path / "b.PDF").write_bytes(b"%PDF two")
    made = run("render-pages", tmp_path / "a.pdf", tmp_path / "b.PDF", "--output", tmp_path / "img", "--dpi", "90", "--converter",
        "tests.test_cli:no_page", "tests.test_cli:one_page")
    assert made["pages"] == 2 and made["requires_vision"] == 0
    page = spark.read.json(made["manifest"]).orderBy("source_path").first()
    assert (page["width"], page["height"], page["page_number"], page["role"]) == (90, 1, 1,
        "content") and page["image_path"].endswith("/a/page-0001.png")
    assert sorted(p.name for p in (tmp_path / "img").iterdir()) == ["a", "b", "manifest"]
    manifest = {"download_root": "x", "sources": [{"source_id": "s", "license": "l", "redistribution": "r",
        "pairs": [{"pair_id": "p", "topic": "t", "courseware": [{"filename": "f.pdf", "url": "http://good/1"}]}, {"pair_id": "none"}]}]}
    (tmp_path / "m.json").write_text(json.dumps(manifest))
    done = run("download", tmp_path / "m.json", "--root", tmp_path / "files", "--fetch", "tests.test_cli:fake_fetch")
    assert done["files"] == 1 and done["bytes"] == 10 and (tmp_path / "files/s/p/courseware/f.pdf").read_bytes() == b"%PDF-1.7 x"
    chunks = [{"chunk_id": n, "document_id": "d", "page_start": 1, "page_end": 1, "text": f"text {n}"} for n in "abc"]
    (tmp_path / "c.jsonl").write_text("".join(json.dumps(r) + "\n" for r in chunks))
    t = [{"query": "q", "positive_chunk_id": "a", "negative_chunk_id": n, "negative_rank": 1, "miner": "m", "difficulty": "hard"} for n in ("b",
        "c", "gone")]
    (tmp_path / "t.jsonl").write_text("".join(json.dumps(r) + "\n" for r in t))
    pack = run("build-negative-review-pack", "--chunks", tmp_path / "c.jsonl", "--triplets", tmp_path / "t.jsonl", "--output", tmp_path / "p.html")
    assert (pack["triplets"], pack["reviewable"], pack["missing_chunks"], pack["difficulties"]) == (3, 2, 1, {"hard": 2})
    (tmp_path / "r.jsonl").write_text("".join(json.dumps(r | {"review_id": f"n{k}", "review_decision": d}) + "\n" for k,
        (r, d) in enumerate(zip(t, ("valid_negative", "valid_negative", "")))))
    assert "not decided" in run("apply-negative-reviews", "--reviews", tmp_path / "r.jsonl", "--output", tmp_path / "kept", code=2)
    kept = run("apply-negative-reviews", "--reviews", tmp_path / "r.jsonl", "--output", tmp_path / "kept", "--allow-incomplete")
    assert (kept["rows"], kept["pending"], kept["retained_triplets"], kept["rejected_triplets"], kept["difficulty_counts"], kept["queries"],
        kept["queries_retained"]) == (3, 1, 2, 1, {"hard": 2}, 1, 1)
    run_info = run("train-reranker", "--chunks", tmp_path / "c.jsonl", "--triplets", tmp_path / "kept", "--model", "m", "--output",
        tmp_path / "model", "--library", "tests.test_cli:fake_training")
    assert (run_info["pairs"], run_info["training_steps"], run_info["warmup_steps"], run_info["device"]) == (3, 1, 1,
        "cpu") and (tmp_path / "model/weights").read_text() == "3"
    assert json.loads((tmp_path / "model/training.json").read_text()) == run_info


def test_ingest_search_evaluate_mine(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/course.txt").write_text("\n--- page ---\n".join(f"# {n.title()} notes\nThe {n} is explained here at length." for n in NAMES))

    def run(*args):
        assert cli.main([str(a) for a in args], spark) == 0, capsys.readouterr().err
        return json.loads(capsys.readouterr().out)

    info = run("ingest", tmp_path / "in", "--output", tmp_path / "chunks", "--plain")
    assert {r["level"]: r["rows"] for r in info["levels"]}["page"] == 4
    doc = spark.read.json(info["documents_output"]).first()["document_id"]
    assert info["documents"] == 1 and run("inspect", tmp_path / "in")["page_count"] == 4
    found = run("search", "--chunks", tmp_path / "chunks", "--query", "kernel", "--levels", "passage")
    assert found[0]["page_start"] == 3
    rows = [{"id": f"q{n}", "query": f"what is the {x}", "document_id": doc, "relevant_pages": [n + 1], "relevant_chunk_ids": [],
        "question_type": "text", "split": ["train", "dev"][n % 2], "annotation_status": "verified"} for n, x in enumerate(NAMES)]
    (tmp_path / "set.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    common = ["--chunks", tmp_path / "chunks", "--dataset", tmp_path / "set.jsonl"]
    assert cli.main([str(a) for a in ("validate-dataset", *common, "--strict")], spark) == 0
    assert {"field": "split", "value": "dev", "examples": 2} in [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    measured = run("evaluate", *common, "--output", tmp_path / "r/report.json")["metrics"]["ALL"]
    assert measured["recall_at_k"] == 1.0 and measured["average_latency_ms"] > 0 and measured["p95_latency_ms"] > 0 and (tmp_path / "r/report.json").exists()
    model = ["--encoder", "tests.test_cli:encoder", "--model-name", "counts"]
    assert run("dense-index", "--chunks", tmp_path / "chunks", *model, "--output", tmp_path / "vec")["chunks"] > 0
    dense = [*common, "--embeddings", tmp_path / "vec", *model]
    assert run("dense-evaluate", *dense, "--split", "dev")["metrics"]["ALL"]["queries"] == 2
    both = run("text-hybrid-evaluate", *dense, "--weights", "bm25=1,dense=3")
    assert both["metrics"]["ALL"]["mrr"] > 0.9 and {d["system"] for d in both["query_diagnostics"]} == {"bm25", "dense", "hybrid"}
    assert run("reranker-evaluate", *dense, "--reranker", "tests.test_cli:pair_model")["metrics"]["ALL"]["queries"] == 2
    mined = run("dense-mine-negatives", *dense, "--quotas", "hard=1,easy=0", "--output", tmp_path / "neg")
    assert {r["difficulty"]: r["rows"] for r in mined["difficulties"]}["hard"] == 2
    assert run("mine-negatives", *common, "--output", tmp_path / "neg2")["triplets"] > 0
    assert run("build-negative-review-pack", "--chunks", tmp_path / "chunks", "--triplets", tmp_path / "neg", "--output",
        tmp_path / "neg.html")["rows"] == 2
    assert run("build-review-pack", *common, "--output", tmp_path / "qa.html")["rows"] == 4
    assert cli.main(["evaluate", *map(str, common), "--split", "test"], spark) == 2 and "no examples" in capsys.readouterr().err
    assert cli.main(["train-reranker", "--chunks", str(tmp_path / "chunks"), "--triplets", str(tmp_path / "neg"), "--model", "m", "--output", "o"],
        spark) == 2
    pages = [{"document_id": doc, "page_number": n + 1, "image_path": f"{x}.png", "sha256": f"h{n}", "requires_vision": n == 0, "role": "content",
        "visual_risk_score": 0.0} for n, x in enumerate(NAMES)]
    (tmp_path / "pages.jsonl").write_text("".join(json.dumps(r) + "\n" for r in pages))
    look = ["--pages", tmp_path / "pages.jsonl", *model]
    assert run("visual-index", *look, "--output", tmp_path / "pv")["pages"] == 4
    seen = ["--page-embeddings", tmp_path / "pv", *look]
    assert run("visual-search", *seen, "--query", "a graph", "--top-k", "1")[0]["page_number"] == 4
    assert run("visual-evaluate", *seen, "--dataset", tmp_path / "set.jsonl")["metrics"]["ALL"]["recall_at_k"] == 1.0
    assert run("hybrid-evaluate", *common, *seen)["metrics"]["ALL"]["recall_at_k"] == 1.0
