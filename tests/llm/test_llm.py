"""The training-data operators on small fixtures: brute force, round trips and odd rows."""

import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from slatework.llm import crosssplit, groupsplit, ivfpq, leaks, mixing, neardup, quality, queries, repeated_lines, split
from slatework.llm._grams import bare, grams, jaccard

DAY = [datetime(2026, 1, n) for n in range(1, 29)]
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda omikron sigma tau upsilon phi chi psi omega vector matrix kernel graph tensor".split()


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(n))


# Lines repeated within a source

PAGES = "source_id string, document_id string, page_number int, text string, ingested_at timestamp, value int"


def test_repeated_lines(spark):
    rows = [("s", f"d{n}", 1, f"Own line {'abcdefgh'[n]}{'xyzuvwrt'[n]}\r\nSHARE this!\n\n12 34", DAY[n], n) for n in range(6)]
    rows += [("s", f"d{n}", 2, "share   THIS\nmore", DAY[n], n) for n in range(4)]
    rows += [rows[0], ("s", "d9", 1, None, DAY[0], 0), (None, "d1", 1, "share this", DAY[0], 0), ("s", None, 1, "share this", DAY[0], 0),
        ("t", "e", 1, "share this", DAY[0], 0), ("s", "d8", 1, "", DAY[0], 1)]
    p = spark.createDataFrame(rows, PAGES)
    found = repeated_lines.find_repeated_lines(p)
    got = {tuple(r) for r in repeated_lines.flag_repeated_lines(p, found).collect()}
    assert got == {(f"d{n}", 1, 2) for n in range(6)} | {(f"d{n}", 2, 1) for n in range(4)}
    clean = repeated_lines.strip_repeated_lines(p, found)
    assert clean.filter("source_id = 's' and document_id = 'd0' and page_number = 1").first()["text"] == "Own line ax\r\n\n12 34"
    assert clean.filter("source_id = 't'").first()["text"] == "share this" and clean.columns[:6] == p.columns
    assert clean.filter("document_id = 'd9'").first()["text"] is None
    assert repeated_lines.flag_repeated_lines(p.limit(0), repeated_lines.find_repeated_lines(p.limit(0))).count() == 0


def test_republished_documents_are_one_cluster(spark):
    rows = [("s", f"d{n}", 1, "same story\nsame end", DAY[n], 0) for n in range(6)] + [("s", f"x{n}", 1, f"other {'abcdef'[n]}", DAY[n],
        0) for n in range(3)]
    p = spark.createDataFrame(rows, PAGES)
    assert {(r["n_documents"], r["n_clusters"], r["n_days"]) for r in repeated_lines.find_repeated_lines(p).collect()} == {(6, 1, 1)}
    assert repeated_lines.find_repeated_lines(p, min_clusters=2).count() == 0


# Vectors

def test_vectors_are_not_kept_twice(spark, tmp_path):
    """What stays on disk for a search at a least similarity: keys, and each vector once in half its size."""
    from pathlib import Path

    x = np.random.default_rng(11).normal(size=(2000, 64))
    v = spark.createDataFrame([(f"c{n:05}", row.tolist(), "g") for n, row in enumerate(x)], VEC)
    ivfpq.most_similar(v.limit(1), min_similarity=0.85).count()  # the folder is set
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("part-*"))
    before = size()
    assert ivfpq.most_similar(v, min_similarity=0.85).count() == 0
    assert size() - before < 2000 * 64 * 8 * 1.5


def test_republished_story_keeps_its_text(spark):
    """A story in many documents is one cluster and stays; the line under every document of the source goes."""
    story = "A long story about the bridge.\nIt was opened in spring.\nShare this page"
    rows = [("s", f"r{n}", 1, story, DAY[n], n) for n in range(8)]
    rows += [("s", f"o{n}", 1, f"Own words {'abcdefgh'[n] * 3}.\nshare THIS page", DAY[n], n) for n in range(8)]
    p = spark.createDataFrame(rows, PAGES)
    found = repeated_lines.find_repeated_lines(p, min_clusters=5, min_days=2)
    clean = {r["document_id"]: r["text"] for r in repeated_lines.strip_repeated_lines(p, found).collect()}
    assert all(clean[f"r{n}"] == "A long story about the bridge.\nIt was opened in spring." for n in range(8))
    assert all(clean[f"o{n}"] == f"Own words {'abcdefgh'[n] * 3}." for n in range(8))
    same_day = p.withColumn("ingested_at", F.lit(DAY[0]))
    assert repeated_lines.find_repeated_lines(same_day, min_clusters=5, min_days=2).count() == 0
    none = repeated_lines.strip_repeated_lines(p, found.limit(0)).collect()
    assert {r["n_removed"] for r in none} == {0} and {r["text"] for r in none} >= {story}


VEC = "chunk_id string, embedding array<double>, gid string"


def brute_top(x, ids, k, low):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    out = {}
    for i, name in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != i and s[i, j] >= low), key=lambda j: (-s[i, j], ids[j]))
        out[name] = [ids[j] for j in order[:k]]
    return out


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 64))
    x = centres[rng.integers(0, 40, 1500)] + 0.35 * rng.normal(size=(1500, 64))
    x[700:760] = x[5]  # copies
    ids = [f"c{n:05}" for n in range(1500)]
    rows = [(i, v.tolist(), "g") for i, v in zip(ids, x)]
    bad = [("n", None, "g"), ("z", [0.0] * 64, "g"), ("short", [1.0] * 63, "g"), ("nan", [float("nan")] + [1.0] * 63, "g"),
        ("inf", [float("inf")] + [1.0] * 63, "g"), ("hole", [None] + [1.0] * 63, "g"), (None, [1.0] * 64, "g")]
    v = spark.createDataFrame(rows + bad + rows[:20], VEC)
    truth = brute_top(x, ids, 5, -1.0)
    got: dict[str, list] = {}
    for r in ivfpq.most_similar(v).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["other"])
    hits = sum(len(set(got[i]) & set(truth[i])) for i in ids)
    assert set(got) == set(ids) and all(len(g) == 5 for g in got.values()) and hits >= 0.9 * 5 * len(ids)
    assert got["c00700"] == truth["c00700"] and got["c00005"] == truth["c00005"]  # ties of copies by id
    assert ivfpq.most_similar(v.limit(0)).count() == 0 and ivfpq.most_similar(v.filter("chunk_id = 'c00001'").limit(1)).count() == 0
    blocks = ivfpq.most_similar(v, min_similarity=0.85, block=64).select("id", "other").distinct()
    assert {tuple(r) for r in blocks.collect()} == {tuple(r) for r in ivfpq.most_similar(v, min_similarity=0.85).select("id",
        "other").distinct().collect()}


def test_probes_grow_with_the_lists(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2400, 64)) * np.linspace(1, 0, 64)
    ids = [f"c{n:05}" for n in range(len(x))]
    truth = brute_top(x, ids, 5, -1.0)
    v = spark.createDataFrame([(i, e.tolist()) for i, e in zip(ids, x)], "chunk_id string, embedding array<double>")
    got = ivfpq.most_similar(v, list_size=16).select("id", "other").collect()
    assert sum(o in truth[i] for i, o in got) >= 0.9 * 5 * len(ids)


def test_lists_in_two_levels(spark, monkeypatch):
    """Many lists are fitted cell by cell and searched through the cells."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(60, 64))
    x = centres[rng.integers(0, 60, 3000)] + 0.4 * rng.normal(size=(3000, 64))
    ids = [f"c{n:05}" for n in range(len(x))]
    v = spark.createDataFrame([(i, e.tolist()) for i, e in zip(ids, x)], "chunk_id string, embedding array<double>")
    truth = brute_top(x, ids, 5, -1.0)
    seen = []
    whole = ivfpq.fit_lists
    monkeypatch.setattr(ivfpq, "fit_lists", lambda *a: seen.append(whole(*a)) or seen[-1])
    got = ivfpq.most_similar(v, list_size=12, sample_rows=1000).select("id", "other").collect()
    assert sum(o in truth[i] for i, o in got) >= 0.9 * 5 * len(ids) and len(got) == 5 * len(ids)
    centroids, coarse, cells = seen[0]
    assert len(coarse) < 64 < 125 < len(centroids) <= 300 and (np.diff(cells) >= 0).all()


# Splitting


def test_cuts_cover_and_overlap():
    r = random.Random(1)
    for _ in range(400):
        text = "".join(r.choice("abc def. gh\n\n漢字。 ") for _ in range(r.randint(0, 300))) + "x" * r.choice([0, 0, 45])
        limit, overlap = r.randint(10, 60), r.randint(0, 8)
        pieces = split.cut(text, limit, overlap)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and all(0 < e - s <= limit for s, e, _ in pieces if text)
        back = text[: pieces[0][1]]
        for (_, end, _), (s, e, _) in zip(pieces, pieces[1:]):
            assert s <= end < e and end - s <= overlap
            back += text[end:e]
        assert back == text
        longest = max(map(len, split.re.split(r"[\s.!?;。！？；]", text)))
        assert any(h for _, _, h in pieces) == (longest > limit)


def test_split_oversized(spark):
    rows = [("a", "One sentence here. Another sentence there. " * 10, 3), ("b", None, 1), ("c", "", 1), ("d", "short", 1), ("e", "x" * 1000, 2),
        ("f", " " * 200, 9)]
    items = spark.createDataFrame(rows, "id string, text string, piece_no int")
    got = split.split_oversized(items.withColumn("page_start", F.col("piece_no")), "id", "text", 100, 10, keep=("page_start",)).orderBy("item_id",
        "piece_no").collect()
    assert {r["item_id"] for r in got} == {"a", "e", "f"} and all(r["tokens"] <= 100 for r in got)
    assert {r["item_cut"] for r in got if r["item_id"] == "e"} == {"forced"} and {r["item_cut"] for r in got if r["item_id"] == "a"} == {"natural"}
    assert all(r["page_start"] == 3 for r in got if r["item_id"] == "a") and got[0]["piece_text"].endswith(". ")
    assert split.split_oversized(items.limit(0), "id", "text", 100).count() == 0
    with pytest.raises(ValueError):
        split.split_oversized(items, "id", "text", 10, 10)


def test_split_by_tokens(spark):
    path = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
    body = "Größe 梯度下降。 The matrix of the kernel is small; ümlaut 😀 ends. " * 6
    got = split.split_oversized(spark.createDataFrame([("a", body)], "id string, text string"), "id", "text", 40, 5,
        vocabulary=path).orderBy("piece_no").collect()
    encoding, back = split.load_ranks(path), ""
    for r in got:
        back += body[max(r["piece_start"], len(back)) : r["piece_end"]]
    assert back == body and all(r["tokens"] <= 40 for r in got) and sum(r["tokens"] - r["overlap"] for r in got) == len(encoding.encode_ordinary(body))


# Near-duplicates


def edited(r: random.Random, text: str, n: int) -> str:
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = r.choice(WORDS) + str(r.randint(100, 999))
    return " ".join(w)


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(2)
    texts = [prose(r, 40) for _ in range(120)]
    texts += [edited(r, texts[n], n % 6) for n in range(60)] + [texts[0], texts[0].upper() + "!!"]
    rows = [(f"c{n:03}", t) for n, t in enumerate(texts)]
    plain = [bare(t) for t in texts]
    truth = {(rows[i][0], rows[j][0]) for i in range(len(rows)) for j in range(i + 1, len(rows)) if jaccard(plain[i], plain[j]) >= 0.6}
    odd = [("n", None), ("e", ""), ("s", "short"), (None, texts[0]), rows[0], ("l", "very long " * 20000)]
    t = spark.createDataFrame(rows + odd, "chunk_id string, text string").withColumn("fp", F.lit("x")).withColumn("body", F.lit(1))
    links, members = neardup.similar_texts(t, "chunk_id", "text", exact_min=0.6)
    got = {(a, b) for a, b, _ in neardup.record_pairs(links, members).collect()}
    assert got <= truth and len(got) >= 0.97 * len(truth)
    groups = {x["record_id"]: x for x in neardup.record_groups(links, members).collect()}
    assert groups["c000"]["group_id"] == "c000" and groups["c180"]["group_id"] == "c000" and groups["c000"]["n_copies"] >= 3
    empty = neardup.similar_texts(t.limit(0), "chunk_id", "text")
    assert neardup.record_pairs(*empty).count() == 0 and neardup.record_groups(*empty).count() == 0


def test_hot_bucket_goes_by_blocks(spark, monkeypatch):
    """A family above the block size takes the other way and loses no link."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    r = random.Random(4)
    base = prose(r, 60)
    rows = [(f"c{n:03}", edited(r, base, 1)) for n in range(40)]
    others = [(f"x{n:03}", prose(r, 60)) for n in range(600)]
    plain = [bare(t) for _, t in rows]
    truth = {(rows[i][0], rows[j][0]) for i in range(40) for j in range(i + 1, 40) if jaccard(plain[i], plain[j]) >= 0.6}
    got = neardup.record_pairs(*neardup.similar_texts(spark.createDataFrame(rows + others, "id string, text string"), "id", "text", exact_min=0.6))
    assert {(a, b) for a, b, _ in got.collect()} == truth


def test_family_that_holds_a_third_of_the_rows(spark, tmp_path):
    """Shared shingles of a hot family weigh little; the plain similarity decides all the same."""
    r = random.Random(14)
    base = prose(r, 40)
    rows = [(f"c{n:04}", edited(r, base, r.randint(2, 14))) for n in range(150)] + [(f"x{n:04}", prose(r, 40)) for n in range(300)]
    plain = [bare(t) for _, t in rows[:150]]
    truth = {(rows[i][0], rows[j][0]) for i in range(150) for j in range(i + 1, 150) if jaccard(plain[i], plain[j]) >= 0.6}
    spark.createDataFrame([(*x, "passage") for x in rows],
        "chunk_id string, text string, level string").write.parquet(f"{tmp_path}/course_chunks.parquet")
    got = {tuple(x) for x in queries.p4_found(spark, str(tmp_path)).collect()}
    assert got <= truth and len(truth) > 300 and len(got) >= 0.97 * len(truth)


def test_frequencies_do_not_depend_on_the_split(spark):
    body = spark.createDataFrame([(n % 4, bare(prose(random.Random(n % 4), 20))) for n in range(64)], "fp bigint, body string")
    (a, n), (b, m) = (neardup.document_frequencies(body.repartition(k)) for k in (1, 8))
    assert n == m == 4 and (a == b).all() and a.max() <= 4


def test_elements_are_a_multiset():
    h = grams(["abcdabcdabcd"])[0]
    assert len(neardup.elements(h)) == len(h) and len(set(neardup.elements(h).tolist())) == len(h)
    assert [len(x) for x in grams(["abc", "", "abcd", "abcde"])] == [0, 0, 1, 2]


# Across splits

EVAL = "id string, query string, split string, document_id string, relevant_pages array<int>, body string, fp string"


def test_cross_split_against_brute_force(spark):
    r = random.Random(6)
    rows = [(f"q{n:03}", prose(r, 9), r.choice(["train", " Train", "dev", "TEST ", None, ""]), f"d{n % 17}", [n % 3, None, n % 3] if n % 4 else [],
        "x", "y") for n in range(120)]
    rows += [(f"r{n:03}", edited(r, rows[n][1], n % 4), r.choice(["train", "dev"]), None, None, "x", "y") for n in range(60)]
    rows += [("n1", None, "train", None, None, "x", "y"), ("n2", "", "dev", None, [], "x", "y"), ("n3", "ab", "dev", None, [], "x", "y"),
        ("n4", "ab", "train", None, [], "x", "y"), (None, "ab", "train", None, [], "x", "y"), rows[3]]
    own = {i: (bare(q), (s or "").strip().lower(), d, {p for p in ps or [] if p is not None}) for i, q, s, d, ps, *_ in rows if i}
    truth = {(min(a, b), max(a, b)) for a, (qa, sa, da, pa) in own.items() if sa == "train" for b,
        (qb, sb, db, pb) in own.items() if sb in ("dev", "test") and (jaccard(qa, qb) >= 0.6 or (da and da == db and pa and pa == pb))}
    got = crosssplit.cross_split_pairs(spark.createDataFrame(rows, EVAL)).collect()
    assert {(min(x["eval_id"], x["train_id"]), max(x["eval_id"], x["train_id"])) for x in got} == truth and len(got) == len(truth)
    assert crosssplit.cross_split_pairs(spark.createDataFrame([], EVAL)).count() == 0


def test_parities_bound_what_is_shared():
    r = random.Random(21)
    for _ in range(300):
        a = [r.getrandbits(63) for _ in range(r.randint(0, 400))]
        x, y = np.array(sorted(set(a)), np.uint64), np.array(sorted({*a[: r.randint(0, len(a))],
            *(r.getrandbits(63) for _ in range(r.randint(0, 200)))}), np.uint64)
        apart = sum(int(v).bit_count() for v in (crosssplit.parities(x) ^ crosssplit.parities(y)).view(np.uint64))
        assert len(np.intersect1d(x, y)) * 2 <= len(x) + len(y) - apart


def test_hot_pages_keep_every_pair(spark, monkeypatch):
    """Different questions on the same pages of a document are pairs of their own, however many they are."""
    monkeypatch.setattr(crosssplit, "PART", 64)
    r = random.Random(15)
    rows = [(f"t{n:03}", f"{n} {prose(r, 9)}", "train", "d", [2, 1], "x", "y") for n in range(300)] + [(f"e{n}", f"{n} {prose(r, 9)}", "dev", "d",
        [1, 2, 1], "x", "y") for n in range(3)]
    got = crosssplit.cross_split_pairs(spark.createDataFrame(rows, EVAL)).filter("same_pages").collect()
    assert {(x["eval_id"], x["train_id"]) for x in got} == {(f"e{m}", f"t{n:03}") for m in range(3) for n in range(300)} and len(got) == 900


def test_hot_copies_keep_every_pair(spark, monkeypatch, tmp_path):
    """Each training record with the same text is a pair of its own and counts in the report."""
    monkeypatch.setattr(crosssplit, "PART", 64)
    text = prose(random.Random(16), 9)
    rows = [(f"t{n:03}", text, "train", None, None, "c") for n in range(300)] + [(f"e{n}", text.upper() + "!", "test", None, None,
        "c") for n in range(3)]
    spark.createDataFrame(rows, "id string, query string, split string, document_id string, relevant_pages array<int>, courseware_source string").write.parquet(f"{tmp_path}/public_course_eval_reviewed.parquet")
    got = {tuple(x) for x in queries.p5_found(spark, str(tmp_path)).collect()}
    assert got == {(f"e{m}", f"t{n:03}") for m in range(3) for n in range(300)}
    report = queries.p5_report(spark, str(tmp_path)).collect()
    assert [(x["split"], x["questions"], x["pairs"], x["by_text"], x["by_pages"]) for x in report] == [("test", 3, 900, 900, 0)]


def test_largest_differencing():
    r = random.Random(7)
    for _ in range(30):
        w = [r.randint(1, 50) for _ in range(r.randint(60, 200))]
        sums = [0] * 7
        for b, x in zip(groupsplit.largest_difference(w, 7), w):
            sums[b] += x
        assert sum(sums) == sum(w) and max(sums) - min(sums) <= 2
    assert groupsplit.largest_difference([], 3) == []


def test_groups_stay_together(spark):
    r = random.Random(8)
    rows = [(f"q{n:04}", f"d{r.randint(0, 400)}" if n % 7 else None, f"p{r.randint(0, 900)}" if n % 3 else None,
        "c") for n in range(900)] + [("q0001", None, None, "c"), (None, "d1", "p1", "c")]
    t = spark.createDataFrame(rows, "id string, document_id string, pair_id string, group_id string")
    g = groupsplit.components(t, "id", {"d": F.col("document_id"), "p": F.col("pair_id")})
    out = groupsplit.assign_splits(g, {"train": 0.8, "dev": 0.1, "test": 0.1}, bins=20, shard=60).collect()
    assert len(out) == 900 and len({x["id"] for x in out}) == 900
    of = {x["id"]: x["split"] for x in out}
    for key in (1, 2):
        seen: dict = {}
        for x in rows:
            if x[key] and x[0]:
                assert seen.setdefault(x[key], of[x[0]]) == of[x[0]]
    big = max(g.groupBy("group_id").count().collect(), key=lambda x: x["count"])["count"]
    for name, share in (("train", 0.8), ("dev", 0.1), ("test", 0.1)):
        assert abs(sum(s == name for s in of.values()) / 900 - share) <= max(0.06, big / 900)
    assert groupsplit.assign_splits(g.limit(0), {"train": 1.0}).count() == 0
    with pytest.raises(ValueError):
        groupsplit.assign_splits(g, {"train": 0.5})


# Leaks


def brute_longest(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            best = max(best, k)
    return best


def test_leaks_against_brute_force(spark):
    r = random.Random(9)
    items = [(n, prose(r, 30).replace("7", " ")) for n in range(8)] + [(90, None), (91, "too short"), (92, "漢字はとても長い文です漢字梯度下降法")]
    docs = []
    for n in range(60):
        w = leaks.words(items[n % 8][1])
        cut = r.randint(5, 25)
        docs.append((n, prose(r, 5) + ", " + " - ".join(w[:cut]).upper() + "! " + prose(r, 5)))
    docs += [(100, None), (101, ""), (102, "x漢字はとても長い文です漢字梯度下降法y"), docs[0],
        (103, " ".join(leaks.words(items[0][1])[15:] + ["cut"] + leaks.words(items[0][1])[:15])), (104, "word " * 50000)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("x"))
    i = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit("x"))
    truth = {(k, m) for k, t in docs for m, u in items if brute_longest(leaks.words(t), leaks.words(u)) >= 12 and len(leaks.words(t)) < 1000}
    got = leaks.find_leaks(d, i, min_tile=12)
    assert {(x["doc_id"], x["item_id"]) for x in got.collect()} == truth and (102, 92) in truth
    slices = leaks.find_leaks(d, i, min_tile=12, items_chars=200)
    assert {(x["doc_id"], x["item_id"]) for x in slices.collect()} == truth
    turned = leaks.find_leaks(d, i, min_tile=5, min_coverage=0.95).filter("doc_id = 103").first()
    assert turned["tiles"] == 2 and turned["coverage"] == 1.0
    assert leaks.find_leaks(d.limit(0), i).count() == 0 and leaks.find_leaks(d, i.limit(0)).count() == 0


def test_tiles_do_not_overlap():
    r = random.Random(10)
    for _ in range(200):
        a, b = ([r.randint(1, 4) for _ in range(30)] for _ in range(2))
        got = leaks.tiles(a, b, 3)
        for s in (0, 1):
            used = [x for t in got for x in range(t[s], t[s] + t[2])]
            assert len(used) == len(set(used))
        assert all(a[i : i + k] == b[j : j + k] for i, j, k in got)
        assert max((k for _, _, k in got), default=0) == (best if (best := brute_longest(a, b)) >= 3 else 0)


# Mixing


def brute_seats(weights, seats, caps):
    got = [0] * len(weights)
    for _ in range(seats):
        open_ = [i for i in range(len(weights)) if got[i] < caps[i] and weights[i] > 0]
        if not open_:
            break
        got[max(open_, key=lambda i: (weights[i] / (2 * got[i] + 1), -i))] += 1
    return got


def test_apportionment_against_brute_force():
    r = random.Random(11)
    for _ in range(300):
        w = [r.random() * r.choice([0, 1, 1, 10]) for _ in range(r.randint(1, 7))]
        caps = [r.randint(0, 30) for _ in w]
        seats = r.randint(0, 60)
        assert mixing.sainte_lague(w, seats, caps) == brute_seats(w, seats, caps)
    assert sum(mixing.sainte_lague([0.5, 0.3, 0.2], 10**9)) == 10**9


def test_mixture(spark):
    counts = spark.createDataFrame([(n, "abc"[n % 3], 50 + n % 40) for n in range(3000)] + [(1, "b", 51), (5000, "zz", 9)],
        "doc_id bigint, source string, n_tokens bigint").withColumn("shard", F.lit("x"))
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 4), ("c", 0.1, 1), ("gone", 0.1, 3)],
        "source string, target_share double, max_repeats int")
    mixture, shares = mixing.mix_sources(counts.drop("shard"), targets, block_tokens=256, shard_docs=300)
    got = {r["source"]: r for r in shares.collect()}
    for s, want, cap in (("a", 0.5 / 0.9, 2), ("b", 0.3 / 0.9, 4), ("c", 0.1 / 0.9, 1)):
        assert abs(got[s]["actual_share"] - want) < 0.02 and got[s]["most_repeats"] <= cap
    assert got["gone"]["actual_share"] == 0 and math.isclose(sum(r["actual_share"] for r in got.values()), 1)
    assert mixture.count() == mixture.select("doc_id").distinct().count()
    none, report = mixing.mix_sources(counts.drop("shard").limit(0), targets)
    assert none.count() == 0 and {r["actual_share"] for r in report.collect()} == {0.0}


def test_token_counts(spark):
    d = spark.createDataFrame([(1, "hello world", "a"), (2, None, "a"), (3, "", "a"), (4, "x", None)],
        "doc_id bigint, text string, source string").withColumn("n_tokens", F.lit(9))
    assert [tuple(r) for r in mixing.token_counts(d, "/opt/tokenizers/byte_bpe_multi_50k.tiktoken").collect()][0][:2] == (1, "a")
    assert mixing.token_counts(d, "/opt/tokenizers/byte_bpe_multi_50k.tiktoken").count() == 1


# Quality

PROSE = "In practice, a small kernel rarely improves the linear token, so that each process of the {} stays complex. It is not the surface but the {} which sets the exponent.\n"


def test_quality(spark):
    r = random.Random(12)
    docs = [(n, "".join(PROSE.format(r.choice(WORDS), r.choice(WORDS)) for _ in range(r.randint(2, 6)))) for n in range(300)]
    docs += [(1000 + n, "\n".join(f"{k}. {r.choice(WORDS)} {r.choice(WORDS)}" for k in range(20))) for n in range(20)]
    docs += [(2000 + n, "\n".join("\t".join(str(r.randint(0, 999)) for _ in range(6)) for _ in range(12))) for n in range(20)]
    docs += [(3000, None), (3001, ""), (3002, " \n　"), (3003, "梯"), (3004, "x" * 100000), docs[0]]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("language", F.lit("q")).withColumn("distance", F.lit("q"))
    labels = spark.createDataFrame([(n, " Prose") for n in range(0, 300, 3)] + [(1000 + n, "LIST") for n in range(15)] + [(2000, None), (5, "odd"),
        (6, "prose"), (6, "table")], "doc_id bigint, label string")
    scored, limit = quality.judge(d, labels)
    found = {x["doc_id"] for x in quality.find_junk(scored, limit).collect()}
    assert {1000 + n for n in range(20)} | {2000 + n for n in range(20)} <= found and not found & set(range(300))
    one = scored.filter("doc_id = 1000").first()
    assert math.isclose(sum(one["contributions"].values()), one["distance"], rel_tol=1e-6)
    assert scored.filter("doc_id in (3000, 3001, 3002)").count() == 0
    alone, base = quality.judge(d, labels.limit(0))
    assert base == pytest.approx(29.588, abs=0.3) and quality.find_junk(alone, base).count() >= 40
    assert quality.find_junk(*quality.judge(d.limit(0), labels)).count() == 0


def test_limit_lies_in_the_widest_gap():
    near, far = np.array([1.0, 2, 3, 40]), np.array([900.0, 1000, 2000])
    d, prose = np.concatenate([near, far]), np.array([True] * 4 + [False] * 3)
    assert quality.best_limit(d, prose) == pytest.approx((40 * 900) ** 0.5)
    assert quality.best_limit(d, ~prose & False) == quality.best_limit(d, prose | True) == pytest.approx(29.588, abs=0.3)
