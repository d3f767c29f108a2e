"""The training-data operators against brute force, libraries and SQL, and on awkward rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvaspark.llm import bpe, components, exact_dedup, html_extract, jaccard_join, lm_score, mixing, quality, queries, suffix_dedup, tiff, url_filter
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, body string, key long, size long, _row string"
random.seed(11)
BASE = " ".join(f"w{random.randint(0, 400)}" for _ in range(120))
EDIT = BASE.replace(BASE.split()[60], "changed", 1)
ROWS = [
    (1, "Hello  World", "en", "a"), (2, "hello  world", None, "a"), (3, None, "en", "b"), (4, "", "en", None), (5, "   \n\t ", "en", None),
    (6, BASE, "en", "c"), (7, EDIT, "en", "c"), (8, BASE.upper(), "en", "c"), (9, "one two", "en", "c"), (9, "one two", "en", "c"),
    (None, "no identifier", "en", "c"), (None, BASE + " tail", "en", "c"), (10, "x" * 50_000, "en", "d"), (11, "é ü ñ 漢字 🙂 \x00", "fr", "d"), (12, "word " * 20_000, "en", "d"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, None, "b", 7, 3, "r") for r in ROWS], DOC).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(1, 13)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_twin(spark, name):
    assert same(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLE_SQL[name]) is None


def test_awkward_rows_and_empty_tables(spark, docs, empty, labels):
    n = len(ROWS)
    path = bpe.vocabulary()
    assert exact_dedup.exact_dedup(docs).count() == n
    assert jaccard_join.near_groups(docs).count() == n
    assert quality.score(docs, labels).count() == n
    assert bpe.digests(docs, path).count() == n
    assert tiff.media_digests(tiff.to_media(docs)).count() == n
    assert suffix_dedup.digests(docs).count() == n
    assert mixing.plan(docs).count() == n
    assert lm_score.score(docs).count() == 13  # 9 and null repeat
    for f in (exact_dedup.exact_dedup, exact_dedup.deduplicate, jaccard_join.near_groups, jaccard_join.keep_one, suffix_dedup.digests, lm_score.score, mixing.mix_sources, lambda d: quality.score(d, labels), lambda d: quality.keep_good(d, labels.limit(0)), lambda d: bpe.encode(d, path), lambda d: tiff.to_pages(tiff.to_media(d))):
        assert f(empty).count() == 0
    for f in (exact_dedup.deduplicate, jaccard_join.keep_one, mixing.mix_sources, lambda d: quality.keep_good(d, labels)):
        assert f(docs).columns == docs.columns
    assert quality.keep_good(docs, labels.limit(0)).count() == n


def grams(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_groups(rows, k, num, den):
    sets = [grams(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(s), least.get(find(i), d)) for i, ((d, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("k, num, den", [(4, 85, 100), (5, 80, 100)])
def test_jaccard_join_is_exact(spark, docs, k, num, den):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = Counter(tuple(r) for r in jaccard_join.near_groups(docs, k, num, den).collect())
    assert got == brute_groups(rows, k, num, den)
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(60)]
    many, common = [], " ".join(rng.choices(vocabulary, k=30))
    for g in range(12):  # groups of edited copies round the threshold, with a passage that all share
        w = rng.choices(vocabulary, k=rng.randint(3, 140))
        for _ in range(12):
            v = list(w)
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                v[rng.randrange(len(v))] = rng.choice(vocabulary)
            many.append((len(many), " ".join(v) + (" " + common if g % 3 == 0 else "")))
    df = spark.createDataFrame(many, "doc_id long, text string").repartition(5)
    assert Counter(tuple(r) for r in jaccard_join.near_groups(df, k, num, den).collect()) == brute_groups(many, k, num, den)


def test_jaccard_identities(spark, monkeypatch):
    """Words built to collide under a rolling hash, sets that share 64 bits, and sets that equal texts of other words do not have."""
    a = "a"
    for _ in range(11):  # Thue-Morse: 2,048 letters
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, a), (2, b), (3, BASE), (4, "  " + BASE.replace(" ", "\n\t")), (5, "x y z w x y z w x"), (6, "x y z w x y z w x y z w x"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_groups(rows, 4, 85, 100)
    assert Counter(tuple(r) for r in jaccard_join.near_groups(df, 4, 85, 100).collect()) == want
    assert (1, 1, 1) in want and (2, 1, 2) in want and (4, 117, 3) in want
    plain = jaccard_join.identity
    monkeypatch.setattr(jaccard_join, "identity", lambda x, y: (plain(x, y)[0] & 1, plain(x, y)[1]))
    assert Counter(tuple(r) for r in jaccard_join.near_groups(df, 4, 85, 100).collect()) == want
    monkeypatch.setattr(jaccard_join, "identity", lambda x, y: (1, 1))
    with pytest.raises(RuntimeError, match="128 bits"):
        jaccard_join.near_groups(df, 4, 85, 100).count()


def test_jaccard_group_of_many_small_sets(spark):
    """A base text and thousands of copies with a word of their own: linked with the base, not with each other."""
    base = "a b c d e f g h i"
    rows = [(0, base)] + [(i, f"{base} v{i}") for i in range(1, 6001)]
    got = jaccard_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), 4, 85, 100)
    assert [tuple(r) for r in got.groupBy("component_id").count().collect()] == [(0, 6001)]


def test_jaccard_gives_every_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 7)
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(40)]
    rows = []
    for g in range(5):
        w = rng.choices(vocabulary, k=60)
        for _ in range(15):
            v = list(w)
            for _ in range(rng.randint(0, 2)):
                v[rng.randrange(len(v))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(v)))
    sets = {d: frozenset(grams(t, 4)) for d, t in rows}
    nodes, links = jaccard_join.linked_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4, 85, 100)
    of = {r["doc_id"]: r["node"] for r in nodes.collect()}
    some = {n: sets[d] for d, n in of.items()}
    assert len(set(of.values())) == len(set(sets.values()))
    want = {(min(a, b), max(a, b)) for a in some for b in some if a != b and 100 * len(some[a] & some[b]) >= 85 * len(some[a] | some[b])}
    assert {(r["a"], r["b"]) for r in links.collect()} == want


def test_allocation_covers_every_linked_pair():
    spaces = jaccard_join.Spaces(85, 100)
    rng = np.random.default_rng(0)
    none = np.zeros(0, np.uint64), np.zeros(0)
    for n in (6, 7, 13, 40, 111, 300):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            most = int(2 * n * 15 / 185)
            b = np.unique(np.concatenate([rng.choice(a, n - most // 2, replace=False), rng.integers(0, 2**63, most // 2).astype(np.uint64)]))
            if 100 * len(np.intersect1d(a, b)) < 85 * len(np.union1d(a, b)) or len(np.setxor1d(a, b)) == 0:
                continue
            met = False
            for j in set(spaces.of(len(a))) & set(spaces.of(len(b))):
                (sa, pa_), (sb, pb) = (jaccard_join.allocate(x, j, spaces.shape(j), *none) for x in (a, b))
                met |= bool(len(np.intersect1d(sa[pa_], sb)) and len(np.intersect1d(sa, sb[pb])))
            assert met


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in components.components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}


@pytest.mark.parametrize("options", [{}, {"digest_bytes": 1, "memtable_rows": 5}])
def test_exact_dedup_and_collisions(spark, docs, options):
    rows = exact_dedup.exact_dedup(docs, "max", **options).collect()
    groups = defaultdict(list)
    for d, t, *_ in ROWS:
        groups["".join(c.lower() if c.isascii() else c for c in (t or ""))].append(d)
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for d in ids:
            want[d, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows) == want
    assert sum(r["kept"] for r in rows) == len(groups) == exact_dedup.deduplicate(docs, **options).count()


def test_html(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Site</a></header><nav><ul><li><a href=a>Menu</a></ul></nav>
    <div class="cookie-notice">We use cookies</div><div id=content><h1>Head &amp; more</h1><p>First   paragraph with <b>many words in it, and more text to be read<p>Second&nbsp;one, as long as the first was, and with a <a href=x>link</a>.</div>
    <div class="comments"><p>A reader writes a comment that is quite long, longer than most.</div><form><p>Search</form><script>var x = "<p>no</p>";</script><footer>&copy; us</footer></body>"""
    assert html_extract.extract(page) == "Head & more\nFirst paragraph with many words in it, and more text to be read\nSecond one, as long as the first was, and with a link."
    assert [html_extract.extract(x) for x in (None, "", "<script>x", "a &lt; b", "<p>", "<<<>>>")][:4] == ["", "", "", "a < b"]
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", "<div>" * 3000 + "deep")], "page_id long, url string, html string")
    assert {r["page_id"]: r["n_chars"] for r in html_extract.extract_pages(df).collect()}[2] == 0


def test_quality_separates_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = quality.score(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.93 * len(rows)
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels).select("doc_id").collect()}
    good = [r["doc_id"] for r in rows if r["quality"] == 1]
    assert sum(i in kept for i in good) >= 0.95 * len(good)


def test_isotonic():
    n, s = np.array([2, 0, 2, 2]), np.array([1, 0, 0, 2])
    curve = quality.isotonic(n, s)
    assert (np.diff(curve) >= 0).all() and curve[0] == pytest.approx(1.5 / 5)


def test_bpe_equals_the_library(real):
    from tokenizers import Tokenizer

    path = bpe.vocabulary()
    theirs, ours = Tokenizer.from_file(path), bpe.load(path)
    texts = [r["text"] for r in real.collect()] + ["", " ", "A<|endoftext|>b <|startoftext|>", "don't WE'LL 12½", "a" * 700, "ΣΑΣ İ é é", "\x00\x1c \u2003x"]
    for t in texts:
        ids = theirs.encode(t, add_special_tokens=False).ids
        assert ours.encode(t) == ids
        decoded = theirs.decode(ids, skip_special_tokens=False)
        assert ours.decode(ids) == decoded
        assert ours.digest(t) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    word = "thequickbrownfox" * 4
    symbols = [*(ours.part[c] for c in word[:-1]), ours.part[word[-1] + "</w>"]]
    assert ours._scan(list(symbols)) == ours._heap(symbols)
    rng = random.Random(4)
    for _ in range(300):
        w = "".join(rng.choices("aeinrst'é漢", k=rng.randint(1, 90))).encode()
        symbols = [*(ours.first[b] for b in w[:-1]), ours.last[w[-1]]]
        assert ours._scan(list(symbols)) == ours._heap(symbols)


def test_bpe_equals_the_library_at_every_code_point():
    from tokenizers import Tokenizer

    path = bpe.vocabulary()
    theirs, ours = Tokenizer.from_file(path), bpe.load(path)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for form in ("a{}b", "{}{} 1{}'s"):
        for i in range(0, len(points), 100_000):
            texts = [form.replace("{}", c) for c in points[i : i + 100_000]]
            for t, e in zip(texts, theirs.encode_batch(texts, add_special_tokens=False)):
                assert ours.encode(t) == e.ids, ascii(t)
    rng = random.Random(1)
    for _ in range(5_000):  # marks in any order, special tokens, white space of all kinds
        t = "".join(rng.choice(points[:0x3000]) if rng.random() < 0.6 else rng.choice(" abS'sT\u0301ΣI\n\x1c\x85") for _ in range(rng.randint(1, 40)))
        ids = theirs.encode(t, add_special_tokens=False).ids
        assert ours.encode(t) == ids and ours.encode_text(t) == " ".join(map(str, ids))
        assert ours.decode(ids) == ours.decode_text(ours.encode_text(t)) == theirs.decode(ids, skip_special_tokens=False)


def test_bpe_digest_and_pipeline_decode_the_ids(spark, docs):
    import corpus_pipeline

    path = bpe.vocabulary()
    with open(path, encoding="utf-8") as f:
        model = bpe.WordBpe(f.read())
    ids = model.encode("hello world")
    model.names.pop(ids[0])
    model.shown.pop(str(ids[0]))
    assert model.digest("hello world")[2] == hashlib.sha256(model.decode(ids).encode()).hexdigest() != bpe.load(path).digest("hello world")[2]
    got = Counter((r["doc_id"], r["decoded_sha256"]) for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect())
    assert got == Counter((r["doc_id"], r["decoded_sha256"]) for r in bpe.digests(docs, path).collect())


@pytest.mark.parametrize("codec", [tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor, tiled, order", [(1, False, "<"), (2, True, ">"), (2, False, ">"), (1, True, "<")])
def test_tiff_round_trip(codec, predictor, tiled, order):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 256, (37, 200, c), dtype=np.uint8) for c in (1, 3)] + [np.zeros((70, 90, 1), np.uint8)]
    got = list(tiff.read_pages(tiff.write([(p, codec, predictor, tiled) for p in pages], order)))
    assert all((a == b).all() for a, b in zip(got, pages)) and len(got) == 3


def _image_io(spark):
    jvm = spark._jvm
    readers = jvm.javax.imageio.ImageIO.getImageReadersByFormatName("tiff")
    if not readers.hasNext():
        pytest.skip("this Java has no TIFF codec")
    return jvm


def _java_read(jvm, data):
    reader = jvm.javax.imageio.ImageIO.getImageReadersByFormatName("tiff").next()
    reader.setInput(jvm.javax.imageio.ImageIO.createImageInputStream(jvm.java.io.ByteArrayInputStream(data)))
    return [bytes(reader.read(i).getRaster().getDataBuffer().getData()) for i in range(reader.getNumImages(True))]


@pytest.mark.parametrize("codec, predictor, tiled", tiff.FORMS)
def test_another_reader_reads_what_is_written(spark, codec, predictor, tiled):
    jvm, rng = _image_io(spark), np.random.default_rng(2)
    text = (b"the quick brown fox " * 600)[:9216]
    pages = [rng.integers(0, 256, (50, 288), dtype=np.uint8), np.frombuffer(text, np.uint8).reshape(16, 576), np.zeros((40, 160), np.uint8)]
    assert _java_read(jvm, tiff.write([(p, codec, predictor, tiled) for p in pages])) == [p.tobytes() for p in pages]


@pytest.mark.parametrize("compression", ["LZW", "PackBits", "Deflate", "ZLib", None])
def test_what_another_writer_writes_is_read(spark, compression):
    jvm, rng = _image_io(spark), np.random.default_rng(3)
    want = np.concatenate([rng.integers(97, 123, (30, 50), dtype=np.uint8), np.full((30, 50), 7, np.uint8)])
    image = jvm.java.awt.image.BufferedImage(50, 60, 10)
    image.getRaster().setDataElements(0, 0, 50, 60, bytearray(want.tobytes()))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("tiff").next()
    params = writer.getDefaultWriteParam()
    if compression:
        params.setCompressionMode(2)  # explicit
        params.setCompressionType(compression)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), params)
    stream.flush()
    pages = list(tiff.read_pages(bytes(out.toByteArray())))
    assert len(pages) == 1 and (pages[0][:, :, 0] == want).all()


def test_tiff_query_against_independent_digests(spark):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    seen = set()
    for r in queries.op6_media_tiff(spark, SF).collect():
        body = (rows[r["doc_id"]] or "").encode()
        payload = body + b"\xff" * ((-len(body)) % 576 or (576 if not body else 0))
        a = np.frombuffer(payload, np.uint8).reshape(-1, 576).astype(float)
        share = np.bincount(a.astype(int).ravel(), minlength=256) / a.size
        entropy = -sum(p * math.log2(p) for p in share if p)
        dy = np.abs(a[1:] - a[:-1]).mean() if len(a) > 1 else 0.0
        feature = f"pages={-(-len(a) // 64)};width=576;rows={len(a)};mean={a.mean():.4f};std={a.std():.4f};entropy={entropy:.4f};dx={np.abs(a[:, 1:] - a[:, :-1]).mean():.4f};dy={dy:.4f}"
        media = tiff.store(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(media), hashlib.sha256(media).hexdigest(), feature)
        seen.add(zlib.crc32(payload) % len(tiff.FORMS))
    assert len(seen) == len(tiff.FORMS)  # every codec has its share of the table


def test_tiff_pages_and_damage(spark, docs):
    media = tiff.to_media(docs.where("doc_id = 12"))
    pages = tiff.to_pages(media)
    data = b"".join(bytes(r["samples"]) for r in pages.orderBy("page").collect())
    assert data.rstrip(b"\xff") == b"word " * 20_000 and len(data) % 576 == 0
    whole = media.first()["media"]
    bad = spark.createDataFrame([(1, 3, bytearray(b"no tiff")), (2, 0, None), (3, 5, whole[: len(whole) // 2])], "doc_id long, n_bytes long, media binary")
    rows = tiff.to_pages(bad).collect()
    assert {r["doc_id"] for r in rows if r["error"]} == {1, 2, 3} and all(r["samples"] is None for r in rows if r["error"])
    digests = {r["doc_id"]: r for r in tiff.media_digests(bad).collect()}
    assert all(r["feature"].startswith("error=") and r["payload_sha256"] is None for r in digests.values()) and digests[2]["media_bytes"] is None


def test_url_filter(spark):
    urls = {
        "https://a.example.net/en/1": ("example.net/en/", "allow"), "https://example.net/de/": ("net/", "block"), "http://x.example.com/de/1?q": ("example.com/de/", "block"),
        "http://b.ORG/fr/": ("org/fr/", "allow"), "https://cheap-pills.example.com/en/1": (None, "block"), "https://casinowin.example.com/": (None, "block"),
        "https://citylibrary.example.com/en": (None, "allow"), "no scheme": (None, "allow"), None: (None, "allow"), "https://notexample.com/de/": (None, "allow"), "x://h?y": (None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "<title>city library news</title>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(df).collect()}
    assert got == dict(enumerate(urls.values()))
    labelled = url_filter.labelled_names()
    assert len(labelled) < 10_000
    trained = dict(url_filter._without_hosts(spark.createDataFrame([("www.cheap-pills.example.com",), ("citylibrary.org",)], "host string"), [(w, b) for w, b, _ in labelled]))
    assert "cheap pills" not in trained and "city library" not in trained and "free pills" in trained
    assert url_filter.filter_urls(df.limit(0)).count() == 0
    assert url_filter.Segmenter({"cheap": 5, "pills": 5, "chea": 1}).cut("cheappills") == ["cheap", "pills"]


def test_url_model_on_names_held_out():
    odds, prior = url_filter.train()
    cut = url_filter.Segmenter({w: 100 for w in odds if len(w) > 1} | {"the": 1000, "of": 900}).cut
    held = [(w, b) for w, b, out in url_filter.labelled_names() if out]
    right = [(prior + sum(odds.get(x, 0.0) for x in cut(w.replace(" ", ""))) > 0) == b for w, b in held]
    assert len(held) > 1500 and sum(right) > 0.98 * len(held)


def brute_cut(name, cost, unknown):
    """The cheapest of all cuts of a short name."""
    best = None
    for mask in range(2 ** (len(name) - 1)):
        words, at = [], 0
        for i in range(1, len(name)):
            if mask >> (i - 1) & 1:
                words.append(name[at:i])
                at = i
        words.append(name[at:])
        total = sum(cost.get(w, unknown + 2.3 * len(w)) for w in words)
        if best is None or total < best:
            best = total
    return best


def test_viterbi_is_the_cheapest_cut():
    rng = random.Random(2)
    counts = {"".join(rng.choices("abc", k=rng.randint(1, 4))): rng.randint(1, 50) for _ in range(25)}
    s = url_filter.Segmenter(counts)
    for _ in range(60):
        name = "".join(rng.choices("abcd", k=rng.randint(1, 11)))
        words = s.cut(name)
        assert "".join(words) == name
        assert sum(s.cost.get(w, s.unknown + 2.3 * len(w)) for w in words) == pytest.approx(brute_cut(name, s.cost, s.unknown))


def test_url_filter_against_brute_force(spark):
    """Every word of the pages' texts counts, rare and long ones too, and whatever the hosts spell is left out of training."""
    rng = random.Random(4)
    words = [f"{a}{b}{c}q" for a in "bcdfghjk" for b in "aeiou" for c in "lmnprst"] + ["longest" * 6]
    texts = [" ".join(["the"] * 200 + ["win"] * 40 + rng.choices(words, k=3700) + (["winnipeg"] if i < 2 else [])) for i in range(50)]
    urls = ["https://winnipeg.example.com/", "https://winnipeg.example.com/", "https://winnipegs-win.example.com/Winnipeg/x1", None, "http://" + "longest" * 6 + "casinospins.org/spam/", "http://freebets.com"]
    df = spark.createDataFrame([(i, urls[i] if i < 6 else "http://a.com", f"<title>{t}</title><script>var hidden</script><p class=x>") for i, t in enumerate(texts)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(df.repartition(3)).collect()}
    spelt = {"a", "winnipeg", "winnipegswin", "longest" * 6 + "casinospins", "freebets", "example", "com", "org"}
    odds, prior = url_filter.train([(w, b) for w, b, held in url_filter.labelled_names() if not held and w.replace(" ", "") not in spelt])
    full = Counter(w for t in texts for w in t.split())
    labelled = [w for w in odds if len(w) > 1]
    strong = max(full.values()) // 10
    counts = {**full, **dict.fromkeys(labelled, strong)}
    cut = url_filter.Segmenter(counts, sum(n for w, n in full.items() if w not in labelled) + strong * len(labelled) + 1).cut
    for i in range(50):
        host, path = (url_filter.re.match(r"[^:]*://([^/?#]*)([^?#]*)", urls[i] or "x://").groups()) if i < 6 and urls[i] else (("a.com", "") if i >= 6 else ("", ""))
        score = prior + sum(odds.get(w, 0.0) for n in url_filter.names_of(host, path) for w in cut(n))
        assert got[i]["score"] == pytest.approx(score), i
        assert got[i]["verdict"] == ("block" if score > 0 else "allow")
    assert got[0]["verdict"] == "allow" and got[4]["verdict"] == got[5]["verdict"] == "block"


def brute_repeats(rows, length=100):
    first = {}
    for d, b in rows:
        for j in range(len(b) - length + 1):
            first.setdefault(b[j : j + length], []).append((d, j))
    out = {}
    for d, b in rows:
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            if min(first[b[j : j + length]]) < (d, j):
                gone[j : j + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[d] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_is_exact(spark):
    rng = random.Random(7)
    piece = lambda n: "".join(rng.choices("abcdefgh é\n", k=n))
    shared = [piece(rng.randint(90, 260)) for _ in range(6)]
    texts = [piece(rng.randint(0, 150)) + rng.choice(shared)[rng.randint(0, 30) :] + piece(rng.randint(0, 90)) + rng.choice(shared) for _ in range(60)]
    texts += ["ab" * 200, "c" * 350, texts[3], texts[3], texts[3] + "!", "", "short", "ab" * 90 + "x"]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = suffix_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == brute_repeats([(d, t.encode()) for d, t in rows])


def test_suffix_dedup_of_hot_anchors_and_shared_digests(spark, monkeypatch):
    rng = random.Random(17)
    piece = lambda n: "".join(rng.choices("abcdef ", k=n))
    passage = piece(180)
    rows = [(i, piece(rng.randint(0, 60)) + passage[: rng.randint(120, 180)] + piece(rng.randint(0, 60)) + (passage if i % 7 == 0 else "")) for i in range(70)]
    rows += [(100, rows[3][1]), (101, "q" * 300), (102, "q" * 250)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_repeats([(d, t.encode()) for d, t in rows])
    monkeypatch.setattr(suffix_dedup, "HOT", 20)
    assert {r[0]: tuple(r[1:]) for r in suffix_dedup.digests(df).collect()} == want
    plain = suffix_dedup._identified
    monkeypatch.setattr(suffix_dedup, "_identified", lambda *x: plain(*x).withColumn("one", F.lit(5).cast("long")))
    assert {r[0]: tuple(r[1:]) for r in suffix_dedup.digests(df).collect()} == want


def test_merged_intervals_are_the_equal_windows(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD", 60)
    rng = random.Random(5)
    for _ in range(10):
        texts = [bytes(rng.choices(b"ab", k=rng.randint(1, 60))) for _ in range(rng.randint(1, 12))]
        text, start, interval = suffix_dedup.windows(texts, 8)
        seen = defaultdict(set)
        for t, s, v in zip(text, start, interval):
            seen[int(v)].add(texts[t][s : s + 8])
        assert all(len(x) == 1 for x in seen.values())
        assert len(seen) == len({t[i : i + 8] for t in texts for i in range(len(t) - 7)})


def brute_common(a, b, depth):
    return next((i for i in range(depth) if a[i] != b[i]), depth)


@pytest.mark.parametrize("letters, longest, depth", [(b"ab", 60, 8), (b"abcdefgh", 180, 100), (bytes(range(256)), 40_000, 100), (b"xyz", 90, 10)])
def test_merge_orders_windows_and_takes_no_other_along(letters, longest, depth):
    rng = random.Random(len(letters))
    texts = [bytes(rng.choices(letters, k=rng.randint(longest // 2, longest))) for _ in range(7)]
    texts += [texts[0], texts[1][5:], texts[2] + texts[3][: longest // 3], b"a" * (depth - 1), b"\x00" * depth, b"\xff" * (depth + 3), b""]
    place, common = suffix_dedup.merge([suffix_dedup.Shard(texts[a : a + 5], depth) for a in range(0, len(texts), 5)], depth)
    joined = b"".join(t + b"\0" for t in texts)
    at, want = 0, []
    for t in texts:
        want += range(at, at + max(0, len(t) - depth + 1))
        at += len(t) + 1
    assert sorted(place.tolist()) == want
    found = [joined[p : p + depth] for p in place.tolist()]
    assert found == sorted(found)
    exact = [0] + [brute_common(a, b, depth) for a, b in zip(found, found[1:])]
    assert all(e - 4 < c <= e for c, e in zip(common.tolist(), exact)) and [c == depth for c in common.tolist()] == [e == depth for e in exact]


def test_search_sorts_few_times_what_it_reads(monkeypatch):
    rng = random.Random(3)
    texts = [bytes(rng.choices(b"abcdefghijklmnop ", k=rng.randint(100, 170))) for _ in range(400)]
    texts += [t[10:] for t in texts[::2]]
    sizes, plain = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, *a, **k: sizes.append(len(x)) or plain(x, *a, **k))
    suffix_dedup.windows(texts)
    assert sum(sizes) < 20 * sum(len(t) + 1 for t in texts)  # 31 when the merge took every suffix along, 11 with windows alone


def brute_scores(rows):
    texts = [(d, (t or "").split()) for d, t in rows]
    one, two = Counter(w for _, ws in texts for w in ws), Counter(p for _, ws in texts for p in zip(ws, ws[1:]))
    total, out = sum(one.values()), {}
    for d, ws in texts:
        s = [one[w] / total if i == 0 else two[ws[i - 1], w] / one[ws[i - 1]] if two[ws[i - 1], w] >= 2 else 0.4 * one[w] / total for i, w in enumerate(ws)]
        missed = sum(two[p] < 2 for p in zip(ws, ws[1:]))
        n, m, units = out.get(d, (0, 0, 0))
        out[d] = (n + len(ws), m + missed, units + sum(round(float(np.log(x)) * 1e6) for x in s))
    return out


@pytest.mark.parametrize("most", [3, 40, 1_000_000])
def test_lm_score_keeps_every_word(spark, most):
    rng = random.Random(most)
    rows = [(i // 2 if i % 5 else None, " ".join(f"w{int(rng.paretovariate(0.6)) % 900}" for _ in range(rng.randint(0, 60)))) for i in range(80)]
    rows += [(900, "rare pair rare pair"), (901, "lone"), (902, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for share in (lm_score.HOT_SHARE, 0.01, 2.0):  # all, some and no bigrams are hot
        got = lm_score.score(df, most=most, hot_share=share).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_backoff"], round(r["logprob"] * 1e6)) for r in got} == brute_scores(rows)
    got = lm_score.score_by_tables(df, order=2).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_backoff"], round(r["logprob"] * 1e6)) for r in got} == brute_scores(rows)


def test_lm_score_of_order_three(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices("abcde", k=rng.randint(0, 30)))) for i in range(40)] + [(40, None), (41, "a")]
    seen = Counter(tuple(ws[i : i + k]) for _, t in rows for ws in [(t or "").split()] for k in (1, 2, 3) for i in range(len(ws) - k + 1))
    total = sum(n for g, n in seen.items() if len(g) == 1)

    def s(gram):
        if len(gram) == 1:
            return seen[gram] / total, False
        if seen[gram] >= 2:
            return seen[gram] / seen[gram[:-1]], False
        return 0.4 * s(gram[1:])[0], True

    want = {}
    for d, t in rows:
        ws = (t or "").split()
        scores = [s(tuple(ws[max(0, i - 2) : i + 1])) for i in range(len(ws))]
        want[d] = (len(ws), sum(m for _, m in scores), sum(round(math.log(x) * 1e6) for x, _ in scores))
    got = lm_score.score_by_tables(spark.createDataFrame(rows, "doc_id long, text string"), order=3).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_backoff"]) for r in got} == {d: w[:2] for d, w in want.items()}
    assert all(abs(r["logprob"] * 1e6 - want[r["doc_id"]][2]) <= 1 + want[r["doc_id"]][0] for r in got)


def test_lm_score_of_more_than_a_million_words(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.3, 3000) % 500_000)) for i in range(400)]
    got = lm_score.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_backoff"], round(r["logprob"] * 1e6)) for r in got} == brute_scores(rows)


def test_mixing(spark, docs):
    t = mixing.targets(spark.createDataFrame([("a", 10), ("b", 1000), ("c", 100), (None, 0)], "source string, source_size long")).collect()
    by = {r["source"]: r["target"] for r in t}
    assert by["a"] == 30 and by["c"] == 300 and by["b"] == pytest.approx(780) and by[None] == 0
    plan = mixing.plan(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = plan.groupBy("source", "target").agg(F.sum("taken").alias("taken"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect()
    assert all(r["over"] <= 0 for r in rows)
    assert sum(abs(r["taken"] - r["target"]) for r in rows) < 0.15 * sum(r["target"] for r in rows)
    assert sorted(map(str, plan.select("doc_id", "taken").collect())) == sorted(map(str, plan.select("doc_id", "taken").collect()))


def test_pipeline_keeps_one_of_each(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = quality.keep_good(docs, labels)
    rows = sorted({("".join(c.lower() if c.isascii() else c for c in r["text"])): r["doc_id"] for r in good.orderBy(F.desc("doc_id")).collect()}.items(), key=lambda x: x[1])
    sets, left = [(d, grams(t, 5)) for t, d in rows], []
    groups = brute_groups([(d, t) for t, d in rows], 5, 80, 100)
    left = {d for d, _, c in groups if d == c}
    taken = Counter()
    for r in mixing.plan(docs.where(F.col("doc_id").isin([*left]))).collect():
        taken[r["doc_id"]] += r["copies"]
    got = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect())
    assert got == +taken and len(sets) >= len(left)
