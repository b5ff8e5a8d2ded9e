"""Contracts of the core operators on small literal tables."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from slatework import schemas
from slatework.functions import text as X
from slatework.operators import chunking, dense, evaluation, fusion, mining, pages
from slatework.operators.graph import connected_components
from slatework.operators.sparse import Bm25Index
from slatework.sources import readers, sinks

HIT = "query_id string, chunk_id string, score double, rank int"


def meta(**known):
    return tuple(known.get(f.name) for f in schemas.PAGE_META)


def pages_of(spark, rows):
    return spark.createDataFrame([(d, n, t, title, meta(image_count=im, source_name="a.pdf")) for d, n, t, title, im in rows], schemas.PAGE)


def chunks_of(spark, rows):
    """rows: (id, document, start, end, text, level)"""
    return spark.createDataFrame([(i, d, s, e, t, None, None, level, [], (None,) * 7) for i, d, s, e, t, level in rows], schemas.CHUNK)


def examples_of(spark, rows):
    """rows: (id, query, document, pages, chunks, type, split, status)"""
    return spark.createDataFrame([(*r, None) for r in rows], schemas.EXAMPLE)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    got = value(spark, X.mixed_tokens(F.lit("L2 norm λ 梯度下降")))
    assert got == ["l2", "norm", "λ", "梯", "度", "下", "降", "梯度", "度下", "下降"]
    assert value(spark, X.mixed_tokens(F.lit(""))) == []


def test_sentences_and_windows(spark):
    assert value(spark, X.sentences(F.lit("One. Two! 三。四\nfive  \t six"))) == ["One.", "Two!", "三。", "四", "five six"]
    assert X.window_bounds([3, 3, 3], 6, 1) == [(0, 2), (1, 3)]
    assert X.window_bounds([9, 1, 9], 5, 1) == [(0, 1), (1, 2), (2, 3)]
    assert X.window_bounds([], 5, 1) == []


def brute_windows(sizes, limit, overlap):
    out, start = [], 0
    while start < len(sizes):
        end = start + 1
        while end < len(sizes) and sum(sizes[start : end + 1]) <= limit:
            end += 1
        out.append((start, end))
        if end == len(sizes):
            return out
        start = max(start + 1, end - overlap)
    return out


def test_windows_against_brute_force():
    from random import Random

    r = Random(5)
    for _ in range(500):
        sizes = [r.randint(1, 9) for _ in range(r.randint(0, 12))]
        limit, overlap = r.randint(1, 20), r.randint(0, 3)
        assert X.window_bounds(sizes, limit, overlap) == brute_windows(sizes, limit, overlap)


def test_truncation(spark):
    assert value(spark, X.truncated(F.lit("abc. defghij"), 6)) == "abc."
    assert value(spark, X.truncated(F.lit("a. bcdefghij"), 8)) == "a. bcdef"
    assert value(spark, X.truncated(F.lit("short"), 8)) == "short"


def test_footer_removal_and_roles(spark):
    p = pages_of(spark, [("d", n, f"Slide text number {'abc'[n - 1]} is here, quite long enough to stay.\nCourse 2026 {n}", None, 1) for n in (1, 2,
        3)])
    got = {r["page_number"]: r for r in pages.prepare_pages(p).collect()}
    assert all("Course" not in r["text"] and r["removed_lines"] == [f"Course 2026 {n}"] and "Course" in r["raw_text"] for n, r in got.items())
    roles = pages_of(spark, [("d", 1, "", None, 0), ("d", 2, "Part two", None, 1), ("d", 3, "", None, 2), ("d", 4, "Subject to copyright", None, 0),
        ("d", 5, "Plain text.", None, 0)])
    kept = {r["page_number"]: r for r in pages.assess_pages(roles).collect()}
    assert [kept[n]["role"] for n in range(1, 6)] == ["empty", "section_divider", "visual_only", "boilerplate", "content"]
    assert kept[2]["section_break"] and kept[2]["requires_vision"] and kept[5]["text_retrieval_excluded"] is False
    report = pages.parse_report(pages.assess_pages(roles)).first()
    assert report["page_count"] == 5 and report["empty_pages"] == [1, 3] and report["page_roles"]["content"] == 1 and report["text_coverage"] == 0.6


def test_chunks_and_hierarchy(spark):
    p = pages_of(spark, [("d", 1, "Intro text. More of it.", "Chapter 1 Start", 0), ("d", 2, "Second page.", "Other", 0),
        ("d", 3, "第二章 here. End.", "第二章 矩阵", 0)])
    c = chunking.chunk_pages(pages.prepare_pages(p), 12).cache()
    levels = {r["level"]: r["count"] for r in c.groupBy("level").count().collect()}
    assert levels["section"] == 2 and levels["page"] == 3 and levels["passage"] == 5
    assert chunking.hierarchy_errors(c).count() == 0
    s = sorted(c.filter("level = 'section'").collect(), key=lambda r: r["page_start"])
    assert [(x["page_start"], x["page_end"], x["section"]) for x in s] == [(1, 2, "Chapter 1 Start"), (3, 3, "第二章 矩阵")]
    broken = c.withColumn("parent_id", F.when(F.col("level") == "passage", F.lit("nobody")).otherwise(F.col("parent_id")))
    assert {r["error"] for r in chunking.hierarchy_errors(broken).collect()} == {"parent_unknown", "child_has_other_parent"}


def test_running_sums_in_stretches(spark):
    from random import Random

    r = Random(8)
    rows = [(k, n, r.randint(0, 5)) for k in ("a", "b", None) for n in r.sample(range(200), 60)]
    df = spark.createDataFrame(rows, "k string, n int, v int")
    got = {(x["k"], x["n"]): x["before"] for x in chunking.running_sum(df, ["k"], "n", "v", "before", 16).collect()}
    assert got == {(k, n): sum(v for j, m, v in rows if j == k and m < n) for k, n, _ in rows}


def test_section_text_is_the_cut_of_all_its_pages(spark):
    """Only the pages that can reach into the limit are gathered; the text is as if all were."""
    rows = [("d", n, f"  Page {n} text.\nEnd of it here. \n" if n % 4 else " \n", "Chapter 1 One" if n == 1 else "Title", 0) for n in range(1, 40)]
    whole = "Chapter 1 One\n" + "\n\n".join(r[2] for r in rows if r[2].strip())
    for limit in (5, 60, 133, 500, 10_000):
        got = chunking.chunk_pages(pages.assess_pages(pages_of(spark, rows)), 50, 1, limit).filter("level = 'section'").first()
        cut = whole.strip()[:limit]
        at = max(cut.rfind(m) for m in "。！？.!?\n")
        assert got["text"] == (whole.strip() if len(whole.strip()) <= limit else (cut[: at + 1] if at >= limit // 2 else cut).strip()), limit
        assert got["metadata"]["truncated"] == (len(whole.strip()) > limit) and len(got["child_ids"]) == 39


def test_text_pages_keep_their_numbers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# One\nfirst\n--- page ---\n\n--- Page ---\nthird\fforth")
    got = readers.read_course_files(spark, str(tmp_path)).orderBy("page_number").collect()
    assert [(r["page_number"], r["text"], r["title"]) for r in got] == [(1, "# One\nfirst", "# One"), (3, "third", None), (4, "forth", None)]
    (tmp_path / "b.md").write_text((tmp_path / "a.txt").read_text())
    with pytest.raises(ValueError, match="twice"):
        readers.read_course_files(spark, str(tmp_path))
    with pytest.raises(ValueError, match="unsupported"):
        readers.parser_of("x.doc")


def test_bm25(spark):
    c = chunks_of(spark, [("a", "d", 1, 1, "gradient descent", "section"), ("b", "d", 1, 1, "gradient descent", "page"),
        ("c", "d", 1, 1, "gradient descent", "passage"), ("x", "d", 2, 2, "other words", "passage")])
    q = spark.createDataFrame([("q", "Gradient"), ("none", "unseen")], "query_id string, query string")
    got = Bm25Index.build(c).search(q).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["c", "b", "a"] and got[0]["score"] > got[1]["score"] > got[2]["score"] > 0
    assert Bm25Index.build(c).search(q, 0).count() == 0


def test_bm25_against_brute_force(spark, monkeypatch):
    """Sparse and dense products, blocks and slices give the sums of the formula, for rankings and for single pairs."""
    import math
    from random import Random

    from slatework.operators import sparse

    monkeypatch.setattr(sparse, "BLOCK", 7)
    monkeypatch.setattr(sparse, "SLICE", 16)
    r = Random(3)
    words = [chr(97 + n) for n in range(12)]
    texts = {f"c{n:03}": " ".join(r.choice(words[: r.randint(1, 12)]) for _ in range(r.randint(0, 30))) for n in range(90)}
    texts |= {"same1": "a b c", "same2": "a b c"}
    asked = {f"q{n:02}": " ".join(r.choice(words) for _ in range(r.randint(1, 6))) for n in range(25)}
    split = {i: t.split() for i, t in texts.items()}
    average = sum(map(len, split.values())) / len(split)
    df = {w: sum(w in t for t in split.values()) for w in words}
    truth = {}
    for q, text in asked.items():
        for i, t in split.items():
            s = sum(math.log(1 + (len(split) - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / average)) for w in text.split() if w in t)
            if s > 0:
                truth[q, i] = round(s, 6)
    index = Bm25Index.build(chunks_of(spark, [(i, "d", 1, 1, t, "passage") for i, t in texts.items()]).repartition(3))
    q = spark.createDataFrame(list(asked.items()), "query_id string, query string")
    for slices in (2_000_000, 20):
        got = index.search(q, 4, 6, slices).collect()
        for name in asked:
            best = sorted(((-s, i) for (n, i), s in truth.items() if n == name))[:4]
            assert [(x["chunk_id"], x["score"]) for x in sorted(got, key=lambda x: x["rank"]) if x["query_id"] == name] == [(i, -s) for s, i in best]
    pairs = spark.createDataFrame([(q, i) for q in asked for i in texts], "query_id string, chunk_id string")
    assert {(x["query_id"], x["chunk_id"]): round(x["score"], 6) for x in index.scored(pairs, q).collect()} == truth
    assert index.search(q.limit(0), 4).count() == 0 and Bm25Index.build(chunks_of(spark, [])).search(q).count() == 0


def test_bm25_rows_do_not_grow_with_partitions(spark):
    """Tokens in many small partitions are searched by few tasks: each hands on k rows of a question."""
    texts = [(f"c{n:04}", "d", 1, 1, f"word{n % 7} term{n % 11} common {'common ' * (n % 3)}", "passage") for n in range(800)]
    index = Bm25Index.build(chunks_of(spark, texts).repartition(40))
    index.tokens = index.tokens.repartition(40)
    q = spark.createDataFrame([(f"q{n}", f"word{n} term{n} common") for n in range(7)], "query_id string, query string")
    assert index._scan(index._weighted(q), 5, 6).count() <= 7 * 5 * 8
    few = Bm25Index(index.tokens.coalesce(1), index.n, index.average_length)
    assert sorted(index.search(q, 5, 6).collect()) == sorted(few.search(q, 5, 6).collect())


def test_bm25_frequent_terms_that_wait():
    """Passages are completed with the terms left out at first: the same ranks and scores as by all sums, with ties."""
    import numpy as np

    from slatework.operators.sparse import _Postings

    r = np.random.default_rng(5)
    n, terms = 3000, 60
    held = r.random((terms, n)) < np.r_[np.full(6, 0.6), np.full(24, 0.1), np.full(30, 0.004)][:, None]
    gains = np.where(held, r.choice([0.5, 1.0, 1.5], (terms, n)), 0.0)
    t, p = np.nonzero(held)
    mix = r.permutation(len(t))
    postings = _Postings(n, t[mix].astype(np.int32), p[mix].astype(np.int32), gains[t, p][mix], terms)
    for k in (1, 5, 50, 700):
        for _ in range(20):
            asked = r.choice(terms, r.integers(1, 20), replace=False)
            weight = np.where(asked < 6, 0.4, np.where(asked < 30, 2.0, 7.0))
            true = np.round(weight @ gains[asked], 6)
            for floor in (0.0, float(np.sort(true)[-3])):
                want = [i for i in np.argsort(-true, kind="stable")[:k] if true[i] > floor]
                at, score = postings.search(asked, weight, k, 6, floor)
                assert at.tolist() == want and np.allclose(score, true[want], atol=1e-6)


def test_dense_and_caches(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [0.0, 1.0])], "chunk_id string, embedding array<double>")
    q = spark.createDataFrame([("q", [0.0, 1.0])], "query_id string, embedding array<double>")
    got = dense.dense_search(q, dense.checked_unit(rows, "embedding"), 2).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in got] == [("b", 1.0), ("c", 1.0)]
    twice = dense.cosine_top_k(q.union(spark.createDataFrame([("p", [1.0, 0.0])], q.schema)), dense.checked_unit(rows, "embedding"), 1,
        row_id="chunk_id", held_numbers=2).collect()
    assert {(r["query_id"], r["chunk_id"]) for r in twice} == {("q", "b"), ("p", "a")}
    named = spark.createDataFrame([("a|b", 2, [0.0, 1.0]), ("x", 1, [1.0, 0.0])], "document_id string, page_number int, embedding array<double>")
    assert [tuple(r)[1:3] for r in dense.visual_search(q, named, 1).collect()] == [("a|b", 2)]
    pair = spark.createDataFrame([("q", "b")], "query_id string, chunk_id string")
    assert dense.pair_scores(pair, q, dense.checked_unit(rows, "embedding")).first()["score"] == 1.0
    for bad in ([0.0, 0.0], [float("nan"), 1.0], [1.0]):
        with pytest.raises(ValueError):
            dense.checked_unit(rows.unionByName(spark.createDataFrame([("z", bad)], rows.schema)), "embedding")
    texts = chunks_of(spark, [("a", "d", 1, 1, "one", "passage"), ("b", "d", 1, 1, "two", "passage")])
    cache = dense.cache_rows(texts.join(rows, "chunk_id"), "m")
    assert dense.load_cache(texts, cache, "m").count() == 2
    with pytest.raises(ValueError, match="text changed"):
        dense.load_cache(texts.withColumn("text", F.lit("new")), cache)
    with pytest.raises(ValueError, match="missing"):
        dense.load_cache(texts.unionByName(chunks_of(spark, [("n", "d", 1, 1, "x", "passage")])), cache)
    assert dense.cache_header(cache, dense.CHUNK_CACHE) == {"model": "m", "query_prefix": "query: ",
        "document_prefix": "passage: "} and dense.cache_header(cache.limit(0), dense.CHUNK_CACHE) == {}
    for broken in (cache.withColumn("format", F.lit("other")), cache.withColumn("model", F.lit("")), cache.withColumn("model", F.col("chunk_id"))):
        with pytest.raises(ValueError, match="cache"):
            dense.load_cache(texts, broken)
    with pytest.raises(ValueError, match="other model"):
        dense.load_cache(texts, cache, "another")
    seen = spark.createDataFrame([("d", 1, "h", [3.0, 4.0])], "document_id string, page_number int, sha256 string, embedding array<double>")
    assert dense.load_page_cache(seen, dense.page_cache_rows(seen, "m"), "m").first()["embedding"] == [0.6, 0.8]
    with pytest.raises(ValueError, match="kind"):
        dense.load_page_cache(seen, dense.page_cache_rows(seen, "m").withColumn("format", F.lit(dense.CHUNK_CACHE)))
    fake = dense.encoded(texts, "text", lambda: lambda ts: [[float(len(t)), 1.0] for t in ts])
    assert {r["embedding"][0] for r in fake.collect()} == {len("passage: one")}


def test_fusion(spark):
    a = spark.createDataFrame([("q", "x", 1.0, 1), ("q", "y", 0.5, 2)], HIT)
    b = spark.createDataFrame([("q", "y", 1.0, 1), ("q", "z", 0.5, 2)], HIT)
    got = fusion.fuse({"a": a, "b": b}, ["chunk_id"], 3, {"a": 1, "b": 3}, 0).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in got] == [("y", 3.5), ("z", 1.5), ("x", 1.0)]
    assert {r["chunk_id"] for r in fusion.fuse({"a": a, "b": b}, ["chunk_id"], 3, {"b": 0}).collect()} == {"x", "y"}
    for bad in ({"weights": {"c": 1}}, {"weights": {"a": -1}}, {"weights": {"a": 0, "b": 0}}, {"rrf_k": -1}, {"candidates": 0}):
        with pytest.raises(ValueError):
            fusion.fuse({"a": a, "b": b}, ["chunk_id"], **bad)
    with pytest.raises(ValueError):
        fusion.fuse({}, ["chunk_id"])
    tied = fusion.reranked(a.withColumn("s", F.lit(1.0)), "s").orderBy("rank").collect()
    assert [r["chunk_id"] for r in tied] == ["x", "y"]


def test_metrics(spark):
    c = chunks_of(spark, [("a", "d", 1, 1, "t", "passage"), ("b", "e", 1, 2, "t", "passage")])
    e = examples_of(spark, [("1", "q", "d", [1], [], None, "dev", None), ("2", "q", "d", [2], [], "text", "dev", None),
        ("3", "q", None, [2], [], "text", "dev", None)])
    r = spark.createDataFrame([("1", "b", 2.0, 1), ("1", "a", 1.0, 2), ("3", "b", 1.0, 1)], HIT)
    m = {x["query_id"]: x for x in evaluation.query_metrics(e, evaluation.chunk_hits(e, r, c), 2).collect()}
    assert (m["1"]["recall"], m["1"]["precision"], m["1"]["rr"], m["1"]["question_type"]) == (1.0, 0.5, 0.5, "unlabeled")
    assert m["2"]["no_result"] == 1.0 and m["2"]["ndcg"] == 0 and m["3"]["recall"] == 1.0
    s = {x["question_type"]: x for x in evaluation.summary(evaluation.query_metrics(e, evaluation.chunk_hits(e, r, c), 2)).collect()}
    assert s["ALL"]["queries"] == 3 and s["ALL"]["recall_at_k"] == 0.666667 and s["text"]["no_result_rate"] == 0.5
    p = spark.createDataFrame([("1", "d", 1, 1.0, 1), ("3", "d", 2, 1.0, 1)],
        "query_id string, document_id string, page_number int, score double, rank int")
    pm = {x["query_id"]: x["recall"] for x in evaluation.query_metrics(e, evaluation.page_hits(e, p), 2, pages=True).collect()}
    assert pm == {"1": 1.0, "2": 0.0, "3": 0.0}
    with pytest.raises(ValueError):
        evaluation.query_metrics(e, evaluation.chunk_hits(e, r, c), 0)


def test_dataset_checks(spark):
    c = chunks_of(spark, [("a", "d", 1, 2, "t", "passage"), ("b", "e", 1, 1, "t", "passage")])
    e = examples_of(spark, [("1", "q", "d", [1], ["a"], "text", "dev", "verified"), ("1", "Q ", "d", [3], [], "odd", "later", "maybe"),
        ("2", " ", "x", [0], [" "], None, None, None),
                            ("3", "r", "d", [], ["b"], "text", "dev", "verified"), ("4", "s", "d", [], ["zz"], "text", "dev", "verified"),
                            ("5", "t", None, [1], [], "text", "dev", "verified"), (" ", "u", " ", [], [], "text", "dev", "verified")])
    codes = {r["code"] for r in evaluation.dataset_errors(e, c, ("split",)).collect()}
    assert codes == {"duplicate_id", "duplicate_query", "page_not_in_corpus", "question_type", "split", "annotation_status", "query",
        "relevant_pages", "relevant_chunk_ids", "split_missing", "document_not_in_corpus",
                     "chunk_of_other_document", "chunk_not_in_corpus", "pages_need_document", "id", "no_label", "document_id"}
    with pytest.raises(ValueError, match="duplicate_id"):
        evaluation.validate(e, c)
    with pytest.raises(ValueError, match="no examples"):
        evaluation.validate(e.limit(0))
    assert {(r["field"], r["value"]): r["examples"] for r in evaluation.validate(e.limit(1), c).collect()}[("split", "dev")] == 1


def test_mining_and_pairs(spark):
    c = chunks_of(spark, [(f"c{n:02}", "d", n, n, f"text {n}", "passage") for n in range(1, 14)])
    e = examples_of(spark, [("1", " q ", "d", [1], [], "text", "train", "verified")])
    r = spark.createDataFrame([("1", f"c{n:02}", 1.0 / n, n) for n in range(1, 14)], HIT)
    got = mining.hard_negatives(e, r, c, 20, quotas={"hard": 2, "medium": 1, "easy": 1}).orderBy("negative_rank").collect()
    assert [(x["negative_chunk_id"], x["difficulty"], x["positive_chunk_id"]) for x in got] == [("c02", "hard", "c01"), ("c03", "hard", "c01"),
        ("c06", "medium", "c01"), ("c11", "easy", "c01")]
    some = mining.hard_negatives(e, r, c, 20, quotas={"hard": 1}).collect()
    assert sorted(x["negative_rank"] for x in some) == [2, *range(6, 14)]  # what has no quota is not limited
    deep = lambda pairs: pairs.withColumn("score", F.lit(0.25))
    far = mining.hard_negatives(e.withColumn("relevant_pages", F.array(F.lit(13), F.lit(12))), r.filter("rank <= 3"), c, 3, scored=deep).collect()
    assert {x["positive_chunk_id"] for x in far} == {"c12"} and len(far) == 3
    with pytest.raises(ValueError):
        mining.hard_negatives(e, r, c, quotas={"odd": 1})
    t = spark.createDataFrame([("q", "c01", "c02", 1, "m", "hard"), ("q", "c01", "c03", 2, "m", "hard")], schemas.TRIPLET)
    assert mining.reranker_pairs(t, c).count() == 3
    with pytest.raises(ValueError, match="conflicting"):
        mining.reranker_pairs(t.unionByName(spark.createDataFrame([("q", "c02", "c03", 1, "m", "hard")], schemas.TRIPLET)), c)
    with pytest.raises(ValueError, match="unknown chunk"):
        mining.reranker_pairs(t.withColumn("positive_chunk_id", F.lit("zz")), c)
    rows = t.withColumn("review_id", F.concat(F.lit("n"), F.col("negative_rank").cast("string"))).withColumn("review_decision",
        F.when(F.col("negative_rank") == 1, "valid_negative").otherwise("uncertain"))
    with pytest.raises(ValueError, match="not decided"):
        mining.apply_reviews(rows)
    kept, counts = mining.apply_reviews(rows, False)
    figures = counts.first()
    assert kept.count() == 1 and [figures[d] for d in ("rows", *mining.DECISIONS, "queries_retained")] == [2, 1, 0, 1, 0,
        1] and figures["difficulty_counts"] == {"hard": 1}
    assert mining.apply_reviews(rows.withColumn("review_decision", F.lit("")), False)[1].first()["pending"] == 2
    with pytest.raises(ValueError, match="duplicate"):
        mining.apply_reviews(rows.withColumn("review_id", F.when(F.col("negative_rank") == 1, " n").otherwise("n ")), False)
    assert [x["idx"] for x in mining.numbered(t.repartition(3)).orderBy("idx").collect()] == list(range(t.count()))
    assert mining.missing_chunks(t.withColumn("negative_chunk_id", F.lit("zz")), c).collect() == [Row(chunk_id="zz")]
    pack = mining.negative_pack(t.withColumn("idx", F.col("negative_rank") - 1), c)
    assert sorted(x["review_id"] for x in pack.collect()) == ["negative-0001", "negative-0002"]
    assert mining.training_steps(65, 8, 1) == (9, 1)


def test_positives_of_any_document_are_not_paired(spark, monkeypatch):
    """Pages of an example without a document lie in every document: the same triplets without a row for each chunk."""
    c = chunks_of(spark, [(f"c{n:03}", f"d{n % 9}", n % 5, n % 5 + n % 2, f"word{n % 7} common {'more ' * (n % 4)}", "passage") for n in range(120)])
    e = examples_of(spark, [("1", "word3 common", None, [2], [], "t", "train", "v"), ("2", "word1", None, [4, 0], ["c005"], "t", "train", "v"),
        ("3", "unseen more", None, [1, 77], [], "t", "train", "v"), ("4", "word2 common", "d3", [3], ["c011"], "t", "train", "v"),
        ("5", "unseen", None, [1], [], "t", "train", "v"), ("6", "common", None, [], ["c000"], "t", "train", "v")])
    index, asked = Bm25Index.build(c), e.select(F.col("id").alias("query_id"), "query")
    rounded = lambda pairs: index.scored(pairs, asked).withColumn("score", F.round("score", 6))
    found = index.search(asked, 20, 6)
    want = mining.hard_negatives(e, found, c, scored=rounded).collect()
    seen, real = [], mining.positives
    monkeypatch.setattr(mining, "positives", lambda *a: seen.append(real(*a).count()) or real(*a))
    got = mining.hard_negatives(e, found, c, scored=rounded, first_on_pages=lambda w: index.first_on_pages(w, asked, 6)).collect()
    assert sorted(got) == sorted(want) and len(want) > 20 and seen[0] < 20


def test_released_checkpoints(spark):
    import os

    from slatework.runtime import release, settled

    df = settled(spark.range(5))
    where = df._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.isdir(where) and df.count() == 5
    release(df)
    assert not os.path.exists(where)


def test_broadcasts_are_measured_in_bytes(spark):
    from slatework.runtime import small

    few, long = spark.createDataFrame([("a", ["b"], 1)], "s string, t array<string>, n int"), spark.createDataFrame([("x" * 5000, None, 1)],
        "s string, t array<string>, n int")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(small(few, 1000)) and not hinted(small(long, 1000)) and hinted(small(few.limit(0), 1000))


def test_components(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y"), ("c", None), ("z", "z"), ("c", "b")], "u string, v string")
    got = {r["node"]: r["component"] for r in connected_components(e).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    chain = spark.range(200).selectExpr("id as u", "id + 1 as v")
    assert {r["component"] for r in connected_components(chain).collect()} == {0}
    assert connected_components(e.limit(0)).count() == 0


def test_jsonl_and_manifests(spark, tmp_path):
    rows = spark.createDataFrame([("q", None, 1.5)], "query string, text string, label double")
    sinks.write_jsonl(rows, str(tmp_path / "out"))
    assert readers.read_jsonl(spark, str(tmp_path / "out"), schemas.PAIR).collect() == [Row(query="q", text=None, label=1.5)]
    (tmp_path / "bad.jsonl").write_text('{"query": "a"}\n\nnot json\n')
    assert [(r["line_no"], r["line"]) for r in readers.bad_lines(spark, str(tmp_path / "bad.jsonl")).collect()] == [(3, "not json")]
    page = '{"document_id": "d", "page_number": 1}\n'
    (tmp_path / "m1.jsonl").write_text(page)
    assert readers.read_page_manifests(spark, str(tmp_path / "m*.jsonl")).count() == 1
    (tmp_path / "m2.jsonl").write_text(page)
    with pytest.raises(ValueError, match="twice"):
        readers.read_page_manifests(spark, str(tmp_path / "m*.jsonl"))
    info = sinks.write_review_page(rows, str(tmp_path / "r.html"), "Review", mining.DECISIONS)
    assert info["rows"] == 1 and "pending" in (tmp_path / "r.html").read_text()


def test_examples_from_evidence(spark):
    c = chunks_of(spark, [("p1", "d", 1, 1, "t", "page"), ("p2", "d", 2, 2, "t", "page"), ("x1", "e", 1, 1, "t", "page")])
    c = c.withColumn("metadata", c.metadata.withField("source_name", F.when(F.col("document_id") == "d", "a.pdf").otherwise("b.pdf")))
    wants = spark.createDataFrame([("public-set1-001", "q", "a.pdf", [2, 1])],
        "id string, query string, source_name string, relevant_pages array<int>")
    got = mining.build_examples(wants, c).first()
    assert (got["document_id"], got["relevant_chunk_ids"], got["pair_id"]) == ("d", ["p1", "p2"], "set1")
    for bad in (wants.withColumn("relevant_pages", F.array(F.lit(7))), wants.withColumn("source_name", F.lit("none.pdf"))):
        with pytest.raises(ValueError, match="without a chunk"):
            mining.build_examples(bad, c)


def test_streamed_pages(spark, tmp_path):
    from slatework.streaming import ingest

    line = '{"document_id": "d", "page_number": %d, "text": "Some text here.", "ingested_at": "2026-01-0%dT00:00:00Z"}\n'
    (tmp_path / "in").mkdir()
    for n, day in ((1, 1), (2, 2), (1, 2)):
        (tmp_path / f"in/{n}{day}.json").write_text(line % (n, day))
        ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), "30 days").awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["page_number"] for r in got) == [1, 2] and {r["role"] for r in got} == {"content"}
