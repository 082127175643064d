"""Search, archives, pages, components and the pipeline."""

import base64
import hashlib
import html as htmllib
import io
import random
import re
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpuslens.llm import components, html_text, queries, topk, warc_zip
from corpuslens.llm.common import file_at
from corpuslens.session import fresh_path

VECTORS = "vec_id long, embedding array<float>, label int"


# --- 2


def test_top_k_against_all_products(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).round(2).tolist(), 1) for i in range(300)]
    rows += [(300 + i, [0.5] * 6, 1) for i in range(40)]  # equal vectors tie
    rows += [(400, None, 1), (401, [], 1), (402, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (403, [float("nan")] * 6, 1), (404, [float("inf")] * 6, 1)]
    rows += [(405, [1.0] * 4, 1), (406, [2.0] * 4, 1), (None, [1.0] * 6, 1), (50, rows[50][1], 2)]
    vectors = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit(0)).repartition(4)
    asked = vectors.where("vec_id % 50 = 0 or vec_id = 405")
    got = {}
    for r in topk.top_k(vectors, asked, 5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    usable = [(i, np.floor(256 * np.array(v, np.float32).astype(np.float64))) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    want = {}
    for i, v in {i: v for i, v in usable if i % 50 == 0 or i == 405}.items():
        best = sorted((-int(v @ w), j) for j, w in usable if j != i and len(w) == len(v))[:5]
        want[i] = [(n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert {q: sorted(v) for q, v in got.items()} == {q: v for q, v in want.items() if v}
    assert topk.top_k(vectors.limit(0), asked, 5).count() == 0 and topk.top_k(vectors, asked.limit(0), 5).count() == 0


def test_top_k_with_large_numbers(spark):
    rows = [(0, [1e15, 3.0], 1), (1, [1e15, 1.0], 1), (2, [1e15, 2.0], 1), (3, [-1e15, 1.0], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [(r["vec_id"], r["score"]) for r in topk.top_k(vectors, vectors.where("vec_id = 0"), 3).orderBy("rank").collect()]
    exact = {j: sum(int(256 * a) * int(256 * b) for a, b in zip(rows[0][1], v, strict=True)) for j, v, _ in rows}
    held = {j: max(-(2**63), min(2**63 - 1, s)) for j, s in exact.items()}
    assert got == [(j, held[j]) for j in sorted((1, 2, 3), key=lambda j: (-held[j], j))]


# --- 3


@pytest.fixture
def odd_pages(spark):
    rows = [
        (1, "http://a/1", "<p>same</p>"), (5, "http://a/5", "<p>same</p>"), (3, None, "<p>same</p>"), (2, "http://b\r\nX: y", "other é"), (4, "u", None), (6, "u", ""),
        (None, "n", "<p>same</p>"), (7, "long", "x" * 3_000_000), (8, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (9, "u", "unique"), (9, "u", "unique"),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)


@pytest.mark.parametrize("min_bytes", [0, 6])
def test_archives_round_trip(odd_pages, min_bytes):
    listed = warc_zip.write_packages(odd_pages, min_bytes)
    rows = warc_zip.read_packages(listed).collect()
    given = [((r["html"] or "").encode(), r["page_id"]) for r in odd_pages.collect()]
    want = []
    for data, page in given:
        last = max((i for d, i in given if d == data and i is not None), default=None)
        to = last if page is not None and len(data) >= min_bytes and page < last else None
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((str(page), len(data), digest, "revisit" if to is not None else "response", to, None if to is not None else data))
    got = [(str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    for r in listed.collect():
        files, path = file_at(r["path"])
        with files.open_input_file(path) as f, zipfile.ZipFile(io.BytesIO(f.read())) as package:
            assert package.testzip() is None and {i.compress_type for i in package.infolist()} == {zipfile.ZIP_STORED}
    assert warc_zip.read_packages(warc_zip.write_packages(odd_pages.limit(0))).count() == 0


def test_packages_without_index_comment_and_zip64(spark):
    folder = fresh_path(spark, "zips")
    files, root = file_at(folder)
    files.create_dir(root, recursive=True)
    records = [warc_zip.record(i, f"u{i}", b"body %d" % i * i, None) for i in range(200)]
    data = b"".join(zlib.compress(r, wbits=31) for r in records)
    paths = []
    for name, method in (("plain.zip", zipfile.ZIP_STORED), ("many.zip", zipfile.ZIP_STORED), ("packed.zip", zipfile.ZIP_DEFLATED)):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w", method) as package:
            package.comment = b"PK\x05\x06 a comment that looks like a directory"
            if name == "many.zip":
                for i in range(66_000):  # more members than the short directory can count
                    package.writestr(f"m/{i}", b"")
            with package.open("archive/x.warc.gz", "w", force_zip64=True) as out:
                out.write(data)
        with files.open_output_stream(f"{root}/{name}") as out:
            out.write(raw.getvalue())
        paths.append(f"{folder}/{name}")
    for path in paths[:2]:
        listed = spark.createDataFrame([(path,)], "path string")
        assert {r["page_id"]: bytes(r["payload"]) for r in warc_zip.read_packages(listed).collect()} == {i: b"body %d" % i * i for i in range(200)}
    with pytest.raises(ValueError, match="compressed"):
        warc_zip.Package(paths[2]).stored_at("archive/x.warc.gz")
    with files.open_output_stream(f"{root}/none.zip") as out:
        out.write(b"no archive")
    with pytest.raises(ValueError, match="no ZIP directory"):
        warc_zip.Package(f"{folder}/none.zip")


# --- 9

PAGES = [
    ("<html><body><nav><a href=x>Home</a></nav><article><h1>T</h1><p>One <b>bo</b>ld &amp; x.<p>Two</article><footer>F</footer></body></html>", "T One bold & x. Two"),
    ("<body><header><h1>Site</h1></header><div id=content><h2>Head</h2><p>A long enough paragraph of the text itself.</p><p>Short.</p></div><div class='side-bar sidebar'>Side words</div></body>", "Head A long enough paragraph of the text itself. Short."),
    ("<main><p>Body text of some length stands here.</p><section class=comments><p>I disagree with all of it, at length.</p></section><form><p>Mail</p></form></main>", "Body text of some length stands here."),
    ("<div class=cookie-notice><p>We use cookies and more cookies.</p></div><div><p>Text of   the\n page.</p><ul><li><a href=a>More</a></li><li>An item</li></ul></div>", "Text of the page. An item"),
    ("<article><p>Kept<script>var a = '</p>';</script> whole<style>p{}</style></p><aside>Not this</aside></article>", "Kept whole"),
    ("just text", "just text"),
    ("<p>unclosed &lt;b&gt; <i>mark", "unclosed <b> mark"),
    ("<nav>menu</nav>", ""),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_pages_keep_their_article(spark, sf):
    rows = queries.QUERIES["op9_html_text"](spark, sf).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        inside = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        assert r["text"] == " ".join(htmllib.unescape(re.sub(r"<[^>]*>", " ", inside)).split()) and r["n_chars"] == len(r["text"])


def test_odd_pages(odd_pages):
    rows = html_text.extract_pages(odd_pages)
    assert rows.columns == ["page_id", "url", "text"] and rows.count() == odd_pages.count()
    assert all(r["text"] is not None for r in rows.collect())
    assert html_text.extract_pages(odd_pages.limit(0)).count() == 0


# --- components


def test_components_of_chains_stars_and_noise(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(150)]
    links += [(7, 7), (100, 101), (101, 100), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    a, b = components.forest(np.array([1, 2, 9]), np.array([2, 3, 8]))
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(2, 1), (3, 1), (9, 8)]


# --- pipeline


def test_pipeline_keeps_columns_and_tokens(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, sf)
        path = fresh_path(spark, name)
        out.write.parquet(path)
        at = spark.read.parquet(path)
        assert at.columns == docs.columns
        ids = [r[0] for r in at.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) > 0
        if name == "quality_classifier":
            assert at.join(labels.where("quality = 0"), "doc_id").count() <= 1
    packed = corpus_pipeline.STAGES[-1][1](spark, at, sf)
    assert packed.select("doc_id").distinct().count() == at.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] == 2048


def test_pipeline_on_odd_and_empty_documents(spark, sf, odd_docs, no_docs):
    for docs in (odd_docs.select("doc_id", "text", "lang", "source", "n_chars"), no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
        pieces = packed.collect()
        assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.collect()}
        by_place = {(r["sequence_id"], r["offset"]): r["length"] for r in pieces}
        assert len(by_place) == len(pieces) and all(offset == 0 or any(s == at and o + n == offset for (at, o), n in by_place.items()) for s, offset in by_place)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div id=content><section>" + "<p>The first part of the text is long.</p>" * 13 + "</section><section>" + "<p>The second part is text as well now.</p>" * 7 + "</section></div>", " ".join(["The first part of the text is long."] * 13 + ["The second part is text as well now."] * 7)),
        ("<article><p>Text of the article stands here.</p><h2>References</h2><ul><li><a href=a>A source</a></li><li><a href=b>Another</a></li></ul></article>", "Text of the article stands here. References A source Another"),
        ("<div><ul><li><a href=h>Home</a></li></ul><p>Text of the page stands here.</p><ul><li><a href=a>A source</a></li><li><a href=b>Another</a></li></ul></div>", "Text of the page stands here. A source Another"),
        ("<div class='long-form'><p>All of the text is inside of this.</p></div>", "All of the text is inside of this."),
        ("<div class='form'><p>All of the text is inside of this.</p></div>", "All of the text is inside of this."),
        ("<article><div class='post-header'><h1>Title</h1></div><p>Text of the article stands here.</p></article>", "Title Text of the article stands here."),
        ("<div><p>Text of the page stands here, some of it.</p><div class='related-work'><p>Others wrote of this too, in other words.</p></div><div class='share-links'><a href=a>One</a> <a href=b>Two</a></div></div>", "Text of the page stands here, some of it. Others wrote of this too, in other words."),
    ],
)
def test_the_whole_article_stays(page, text):
    assert html_text.main_text(page) == text


def test_deeply_nested_pages_take_linear_time():
    import time

    page = "<div>" * 60_000 + "text " * 20 + "".join("<div>some words here, more of them</p></section>" for _ in range(20_000))
    start = time.process_time()
    text = html_text.main_text(page)
    assert text.startswith("text text") and text.count("some words") == 20_000 and time.process_time() - start < 5
