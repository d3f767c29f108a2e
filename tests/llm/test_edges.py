"""Values on awkward rows: nulls, empty and very long texts, ties, repeated rows, empty tables and columns whose names clash."""

import hashlib
from pathlib import Path

import pytest

from sylvaspark.llm import bpe, common, exact_dedup, html_extract, jaccard_join, lm_score, mixing, quality, suffix_dedup, tiff, url_filter
from sylvaspark.sources import stages

LONG = "alpha beta gamma delta " * 8000
BIG = 2**63 - 1
#: Names that the operators use for columns of their own.
CLASH = "target double, _source string, copies int, taken long, source_size long, size long, row string, _row string, hit boolean, digest binary, body binary, sha binary, ref long, missing int, key long, n long, node long, tid long, ids string, media binary, stats string, score double, _text string, _id long, _gone long"
FILL = (1.5, "s", 2, 3, 4, 5, "r", "q", True, bytearray(b"d"), bytearray(b"b"), bytearray(b"s"), 6, 7, 8, 9, 10, 11, "i", bytearray(b"m"), "t", 0.5, "x", 12, 13)
ROWS = [(5, "Same text here", "a"), (5, "Same text here", "a"), (7, "same TEXT here", "b"), (None, "same text here", None), (-BIG - 1, "lone", "a"), (BIG, "lone", "b"), (1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, LONG, "c"), (6, LONG + "tail", "c"), (8, "é́ 漢 🙂 \x00 \x1c", "d")]


@pytest.fixture(scope="module")
def clash(spark):
    return spark.createDataFrame([(*r, *FILL) for r in ROWS], f"doc_id long, text string, source string, {CLASH}").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], f"doc_id long, text string, source string, {CLASH}")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, 9)], "doc_id long, quality int, toxic int")


def bag(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup_at_the_ends_of_long(clash, keep):
    got = exact_dedup.exact_dedup(clash, keep).collect()
    groups = {}
    for d, t, _ in ROWS:
        groups.setdefault("".join(c.lower() if c.isascii() else c for c in t or ""), []).append(d)
    for r in got:
        ids = next(v for t, v in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        known = [i for i in ids if i is not None]
        assert (r["keep_id"], r["group_size"]) == ((min if keep == "min" else max)(known), len(ids))
    assert len(got) == len(ROWS) and sum(r["kept"] for r in got) == len(groups)
    assert {r["keep_id"] for r in got if r["doc_id"] in (BIG, -BIG - 1)} == {-BIG - 1 if keep == "min" else BIG}
    left = exact_dedup.deduplicate(clash, keep)
    assert left.columns == clash.columns and left.count() == len(groups)
    assert all(tuple(r)[3:] == FILL for r in left.collect())


def test_stages_return_the_columns_of_their_input(spark, clash, empty, labels):
    stages = (lambda d: quality.keep_good(d, labels, threshold=-1.0), exact_dedup.deduplicate, lambda d: jaccard_join.keep_one(d, 5, 80, 100), mixing.mix_sources)
    for stage in stages:
        out = stage(clash)
        assert out.schema == clash.schema and out.count() > 0
        assert all(tuple(r)[3:] == FILL for r in out.collect())
        none = stage(empty)
        assert none.columns == empty.columns and none.count() == 0
    assert quality.keep_good(clash, labels, threshold=-1.0).count() == len(ROWS)
    near = {r["doc_id"] for r in jaccard_join.keep_one(clash, 5, 80, 100).collect()}
    assert 6 not in near and {4, 5, None, 1, 2, 3} <= near  # the longer text is linked with the long one; blank ones with nothing


def test_jaccard_values(clash):
    got = bag(tuple(r) for r in jaccard_join.near_groups(clash, 4, 85, 100).collect())
    want = [(5, 1, 5), (5, 1, 5), (7, 1, 5), (None, 1, 5), (-BIG - 1, 1, -BIG - 1), (BIG, 1, -BIG - 1), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 4, 4), (6, 5, 6), (8, 2, 8)]
    assert got == bag(want)


def test_mixing_values_and_clashes(clash, empty):
    rows = mixing.plan(clash).select("doc_id", "size", "source_size", "target", "taken").collect()
    sizes = {s: sum(len((t or "").encode().split()) for _, t, x in ROWS if x == s) for s in ("a", "b", "c", "d", None)}
    assert len(rows) == len(ROWS) and {r["source_size"] for r in rows} == set(sizes.values())
    assert all(r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] for r in rows)
    same = [tuple(r) for r in rows if r["doc_id"] == 5]
    assert same[0] == same[1]
    assert mixing.plan(empty).count() == 0 and mixing.plan(clash).columns.count("target") == 1


def test_bpe_values(clash, empty):
    model = bpe.load(bpe.vocabulary())
    got = bag(tuple(r) for r in bpe.digests(clash, bpe.vocabulary()).collect())
    assert got == bag((d, *model.digest(t or "")) for d, t, _ in ROWS)
    assert model.digest("") == (0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest()) and bpe.digests(empty, bpe.vocabulary()).count() == 0


def test_media_values(clash, empty):
    got = bag((r["doc_id"], r["n_bytes"], r["payload_sha256"]) for r in tiff.media_digests(tiff.to_media(clash)).collect())
    assert got == bag((d, len((t or "").encode()), hashlib.sha256(tiff.padded((t or "").encode())).hexdigest()) for d, t, _ in ROWS)
    assert tiff.media_digests(tiff.to_media(empty)).count() == tiff.to_pages(tiff.to_media(empty)).count() == 0


def test_suffix_values(clash, empty):
    got = {r["doc_id"]: r for r in suffix_dedup.digests(clash).collect()}
    long, tail = got[4], got[6]
    assert long["n_removed"] == len(LONG) - 23 and long["n_spans"] == 1  # one period starts first
    assert tail["n_bytes"] - tail["n_removed"] == 4 and tail["kept_sha256"] == hashlib.sha256(b"tail").hexdigest()
    assert all(got[i]["n_removed"] == 0 for i in (1, 2, 3, 5, 7, 8)) and suffix_dedup.digests(empty).count() == 0


def test_lm_values(clash, empty):
    got = {r["doc_id"]: r for r in lm_score.score(clash).collect()}
    assert got[1]["n_words"] == 0 and got[1]["logprob"] == 0 and got[1]["avg_logprob"] is None
    assert got[5]["n_words"] == 6 and got[4]["n_words"] == 32000 and len(got) == len(ROWS) - 1
    assert lm_score.score(empty).count() == lm_score.score_by_tables(empty).count() == 0


def test_quality_values(clash, empty, labels):
    rows = quality.score(clash, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    by = [r["score"] for r in rows if r["doc_id"] in (1, 2)]
    assert by[0] == by[1] and quality.score(empty, labels).count() == 0
    assert {r["score"] for r in quality.score(clash, labels.limit(0)).collect()} == {quality.DEFAULT}


def test_pages(spark):
    article = "<article>" + "<p>" + "word " * 300 + "</p></article>"
    schema = "page_id long, url string, html string, host string, path string, name string, word string, text string, n_chars long"
    rows = [(1, "http://x.org/a", article), (1, "http://x.org/a", article), (2, None, None), (3, "", ""), (4, "ftp://H/%zz", "<p title=it's>One..</p><p>Two..</p><p title=it's>Three..</p>"), (None, "https://casinopoker.com", "<div class='content no-sidebar'><p>Kept text here.</p></div>"), (5, "u", "<p>" + "<b>" * 3000 + "deep text" + "</b>" * 3000 + "</p><span class=ad>BUY</span>")]
    pages = spark.createDataFrame([(*r, "h", "p", "n", "w", "t", 9) for r in rows], schema)
    got = bag((r["page_id"], r["text"], r["n_chars"]) for r in html_extract.extract_pages(pages).collect())
    word = " ".join(["word"] * 300)
    want = [(1, word), (1, word), (2, ""), (3, ""), (4, "One..\nTwo..\nThree.."), (None, "Kept text here."), (5, "deep text")]
    assert got == bag((i, t, len(t)) for i, t in want)
    assert html_extract.extract_pages(pages.limit(0)).count() == 0
    urls = bag((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages).collect())
    assert urls == bag([(1, "x.org", "/a", None, "allow")] * 2 + [(2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "h", "/%zz", None, "allow"), (None, "casinopoker.com", "", None, "block"), (5, "", "", None, "allow")])
    form = "<form><article><h1>Title</h1><p>" + "text " * 50 + "</p></article><input><div class=comments>Nice</div></form>"
    assert html_extract.extract(form) == "Title\n" + " ".join(["text"] * 50)


def test_densities_are_those_of_the_tree():
    """Characters, tags, link characters and link tags of every node, counted over its subtree by another parser."""
    from html.parser import HTMLParser

    source = "<html><body><div id=a><p>one <a href=x>two</a> three</p><p>four</p></div><div id=b><a href=y>five</a><ul><li>six</li><li><a href=z>seven</a> eight</li></ul></div></body></html>"

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__()
            self.stack, self.nodes = [], []

        def handle_starttag(self, tag, attrs):
            for i in self.stack:
                self.nodes[i][2] += 1
                self.nodes[i][4] += tag == "a"
            self.nodes.append([tag, 0, 0, 0, 0])
            self.stack.append(len(self.nodes) - 1)

        def handle_endtag(self, tag):
            self.stack.pop()

        def handle_data(self, data):
            linked = any(self.nodes[i][0] == "a" for i in self.stack)
            for i in self.stack:
                self.nodes[i][1] += len(data)
                self.nodes[i][3] += len(data) * linked

    tree = Tree()
    tree.feed(source)
    page = html_extract.Page(source)
    assert [list(x) for x in zip(page.tag, page.chars, page.tags, page.link_chars, page.link_tags)][1:] == tree.nodes
    total = {i: sum(page.density(j, 2) for j in range(1, len(page.tag)) if page.parent[j] == i) for i in range(len(page.tag))}
    best = max(total, key=total.get)
    assert best in page.main()


def test_quality_against_brute_force(spark):
    """Kernel, normal equations, pooling and scores, one row at a time in plain Python."""
    import math
    import random
    import zlib

    import numpy as np

    rng = random.Random(12)
    rows, marks = [], []
    for i in range(160):
        good = rng.random() < 0.6
        words = [rng.choice(("the", "report", "of", "results")) for _ in range(rng.randint(5, 40))] if good else [rng.choice(("###", "$$$", "BUY!!")) for _ in range(rng.randint(5, 40))]
        rows.append((i, " ".join(words) + ("." if good else "")))
        if i % 4:
            marks.append((i, int(good) if rng.random() < 0.9 else int(not good)))
    got = {r["doc_id"]: r["score"] for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(marks, "doc_id long, quality int")).collect()}
    kernel = quality.Kernel()
    label, fold = dict(marks), {i: zlib.crc32(str(i).encode()) % 5 for i, _ in rows}
    z = {}
    for i, t in rows:
        x = np.float32(quality.statistics(t.encode())).astype(float)
        z[i] = [round(math.cos(sum(a * b for a, b in zip(x, kernel.w[:, j])) + kernel.b[j]) * 2048) / 2048 for j in range(quality.FEATURES)] + [1.0]
    train = [i for i in label if fold[i] in (1, 2, 3)]
    size = quality.FEATURES + 1
    a, b = [[0.0] * size for _ in range(size)], [0.0] * size
    for i in train:
        for p in range(size):
            b[p] += z[i][p] * label[i]
            for q in range(size):
                a[p][q] += z[i][p] * z[i][q]
    beta = np.linalg.solve(np.array(a) / len(train) + quality.RIDGE * np.eye(size), np.array(b) / len(train))
    at = {i: min(max((float(np.dot(z[i], beta)) + 0.5) / 2 * (quality.BINS - 1), 0), quality.BINS - 1) for i in z}
    bins: dict[int, list[int]] = {}
    for i in label:
        if fold[i] == 4:
            bins.setdefault(int(np.rint(at[i])), []).append(label[i])
    blocks = [[len(v), sum(v), k, k] for k, v in sorted(bins.items())]
    while (bad := next((j for j in range(len(blocks) - 1) if blocks[j][1] * blocks[j + 1][0] >= blocks[j + 1][1] * blocks[j][0]), None)) is not None:
        n, s, first, _ = blocks[bad]
        m, t, _, last = blocks[bad + 1]
        blocks[bad : bad + 2] = [[n + m, s + t, first, last]]
    places, values = [(f + e) / 2 for _, _, f, e in blocks], [(s + 0.5) / (n + 1) for n, s, _, _ in blocks]
    curve = np.interp(range(quality.BINS), places, values)
    for i in z:
        assert got[i] == pytest.approx(float(np.interp(at[i], range(quality.BINS), curve)), abs=2e-3), i


def test_statistics_by_definition():
    text = b"One two two.\n\nTHREE 45 | ok!\nx"
    s = quality.statistics(text)
    words = ["One", "two", "two.", "THREE", "45", "|", "ok!", "x"]
    n = len(text)
    assert s[2] == pytest.approx(len(set(words)) / 8) and s[3] == pytest.approx(1 / 8) and s[4] == 0
    assert s[6] == pytest.approx(min(1, 4 * 3 / n)) and s[8] == pytest.approx(6 / n) and s[9] == pytest.approx(4 * 2 / n) and s[16] == pytest.approx(2 / 8)
    assert s[13] == pytest.approx(2 / 3) and s[14] == 1 and quality.statistics(b"") == [0.0] * 17


def test_stages_have_no_checksum_files(spark):
    """Hadoop starts a process for each file that a task makes, with an executor's memory shown twice."""
    rows = spark.range(0, 100, 1, 4)
    for write in (common.materialize, stages.stage):
        back = write(rows, "plain")
        at = Path(back._written_at.removeprefix("file:"))
        names = [p.name for p in at.iterdir()]
        assert len([n for n in names if n.startswith("part-")]) == 4 and not [n for n in names if n.endswith(".crc")]
        assert sorted(r.id for r in back.collect()) == list(range(100))
        common.release(back)
        assert not [p.name for p in at.iterdir() if p.name.endswith(".crc")]
        assert spark.read.schema("id long").parquet(str(at)).isEmpty()
