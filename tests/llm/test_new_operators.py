"""Ranked search, Merkle manifest and line dedup against brute force."""

import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from corpuslens.llm import line_dedup, merkle, ranked_search

ITEMS = "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def last_none(x):
    return (x is None, x or 0)


# --- 11


def searched(docs, items, k):
    tokens = [(d, TERM.findall((t or "").translate(LOWER))) for d, t in docs]
    n, total = sum(bool(t) for _, t in tokens), sum(len(t) for _, t in tokens)
    df = {}
    for _, t in tokens:
        for term in set(t):
            df[term] = df.get(term, 0) + 1
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(TERM.findall((text or "").translate(LOWER)))
    want = []
    for item, terms in asked.items():
        scores = []
        for d, t in tokens:
            m = 100 - 90 + 90 * len(t) * n // max(total, 1)
            w = {x: math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) for x in terms if x in df}
            score = sum(w[x] * (1_000_000_000 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in w)
            if score > 0:
                scores.append((-score, last_none(d), d))
        want += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(want, key=str)


@pytest.mark.parametrize(("tile_bytes", "block_terms"), [(4_000_000, 8192), (700, 5)])
def test_ranked_search_against_brute_force(spark, odd_docs, tile_bytes, block_terms):
    more = [(i, " ".join(w for j, w in enumerate("the of and Über CAT cat dog 7up x y straße İi ﬁsh".split() * 3) if (i * 31 + j * j) % 5 < 2)) for i in range(100, 160)]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).withColumn("shard", F.lit("clash"))
    items = [(i, " ".join(["the of"] + w)) for i, w in enumerate([["cat"], ["cat", "dog"], ["cat dog 7up"], ["and"], ["and über ÜBER Über"], ["straße x y"], []])]
    items += [(50, None), (51, ""), (52, "... !"), (53, "nowhere"), (54, "word"), (54, "ab"), (None, "cat ﬁsh"), (55, odd_docs.where("doc_id = 6").first()["text"][:3000])]
    table = spark.createDataFrame(items, ITEMS).withColumn("terms", F.lit(1))
    got = ranked_search.ranked_search(docs, table, 5, tile_bytes, block_terms).collect()
    want = searched([(r["doc_id"], r["text"]) for r in docs.collect()], items, 5)
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got), key=str) == want


def test_ranked_search_of_empty_tables(spark, no_docs):
    items = spark.createDataFrame([(1, "the")], ITEMS)
    docs = spark.createDataFrame([(1, "the")], "doc_id long, text string")
    assert ranked_search.ranked_search(no_docs, items).count() == 0
    assert ranked_search.ranked_search(docs, items.limit(0)).count() == 0
    assert ranked_search.ranked_search(docs.withColumn("text", F.lit(None).cast("string")), items).count() == 0
    assert [r["score"] > 0 for r in ranked_search.ranked_search(docs, items).collect()] == [True]


def test_shared_sets_become_prefixes(spark):
    rows = [(i, t, 1) for i, words in enumerate(["a b c", "a b c d", "a b e", "f", "e f"]) for t in words.split()]
    found = {r["item_id"]: r for r in ranked_search.shared_sets(spark.createDataFrame(rows, "item_id long, term string, weight long")).collect()}
    atom = {t["term"]: t["atom"] for r in found.values() for t in r["terms"]}
    assert atom["a"] == atom["b"] and len({str(x) for x in atom.values()}) == 5  # a and b are always together
    assert found[0]["path"] == found[1]["path"][:2] and found[0]["path"][0] == atom["a"] and found[2]["path"][0] == atom["a"]


# --- 12


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def proofs_of(nodes):
    """Root, and for each node its runs as (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            run = place - place % 3
            paths[i].append(("".join(nodes[run:place]), "".join(nodes[place + 1 : run + 3])))
        nodes = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        at = [place // 3 for place in at]
    return nodes[0], paths


def proven(rows):
    def leaf(row, text):
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)])

    trees = {}
    for row in rows:
        cut = row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
        own = leaf(row, row[4])
        trees.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, own, leaf(row, row[4].replace("\n", "")) if cut else own))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    grown = {s: proofs_of([x[2] for x in sorted(trees[s])]) for s in names}
    root, tops = proofs_of([grown[s][0] for s in names])
    want = []
    for s, top in zip(names, tops, strict=True):
        subroot, paths = grown[s]
        for (there, doc, own, given), path in zip(sorted(trees[s]), paths, strict=True):
            folded = given
            for left, right in path + top:
                folded = h(left, folded, right)
            want.append((doc if there else None, own, subroot, root, h(*[x for pair in path + top for x in pair]), folded, folded == root))
    return sorted(want, key=str)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest_against_a_plain_tree(spark, odd_docs, levels):
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    more = [(100 + i, ["big", "Big", "é", ""][0 if i % 3 else i % 4], "en", i, f"line\n{i}\n") for i in range(70)]
    docs = odd_docs.select(*columns).union(spark.createDataFrame(more, "doc_id long, source string, lang string, n_chars long, text string").select(*columns))
    got = merkle.manifest(docs.withColumn("tree", F.lit(1)).withColumn("place", F.lit("x")).repartition(5), levels)
    want = proven([tuple(r) for r in docs.collect()])
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert {w[-1] for w in want} == {True, False}


def test_manifest_of_one_document_and_of_none(spark, no_docs):
    one = spark.createDataFrame([(7, "s", None, 1, "t")], "doc_id long, source string, lang string, n_chars long, text string")
    (row,) = merkle.manifest(one).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["proof_sha256"] == h("") and row["verified"]
    assert merkle.manifest(no_docs).count() == 0


# --- 13


def deduplicated(rows, least=10):
    keys = [[line.strip(" \t\n\x0b\x0c\r").translate(LOWER) for line in (t or "").split("\n")] for _, t in rows]
    holders = {}
    for (d, _), ks in zip(rows, keys, strict=True):
        for key in ks:
            if len(key) >= least:
                holders.setdefault(key, set()).add(d)
    want = []
    for (d, t), ks in zip(rows, keys, strict=True):
        lines = (t or "").split("\n")
        kept = [line for line, key in zip(lines, ks, strict=True) if len(key) < least or d == min(holders[key], key=last_none)]
        want.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(want, key=str)


@pytest.mark.parametrize("hot", [1000, 2])
def test_shared_lines_against_brute_force(spark, odd_docs, hot, monkeypatch):
    """Once with every hash on the sorted path, once with those of two lines or more split off."""
    monkeypatch.setattr(line_dedup, "HOT_LINES", hot)
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 0.0)
    rows = [(20, "A shared line here\nown\n\tA SHARED line here \r\nshort"), (21, "a shared line here"), (22, "\n\nÀ shared line here\nown words of 22"), (23, "à shared line here\nÀ shared line here")]
    rows += [(24, "same same same same\nsame same same same\nx"), (24, "x\nsame same same same"), (25, "same same same same\nlast\n"), (None, "same same same same"), (26, "123456789\n1234567890"), (27, "123456789\n1234567890 \n")]
    rows += [(i, "licence line of many documents\n" * (i % 3) + f"text {i} of its own, long enough\nlicence line of many documents\n") for i in range(30, 60)]
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    table = docs.withColumn("n_lines", F.lit("clash")).withColumn("h1", F.lit(0)).withColumn("_keep", F.lit(0)).repartition(4)
    got = line_dedup.without_shared_lines(table)
    assert got.columns == ["doc_id", "text", "h1", "_keep", "n_lines", "n_dropped", "kept_text"]
    assert sorted((tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=str) == deduplicated([tuple(r) for r in docs.collect()])


def test_bitmaps_are_runs_and_the_plan_is_native(spark, no_docs):
    docs = spark.createDataFrame([(1, "first line of all\nsecond line of all"), (2, "own\nfirst line of all\nsecond line of all\nown\nfirst line of all")], "doc_id long, text string")
    bitmaps = line_dedup.keep_bitmaps(docs)
    assert {r["doc_id"]: r["keep"] for r in bitmaps.collect()} == {1: [2], 2: [1, 3, 4, 5]}
    assert line_dedup.keep_bitmaps(no_docs).count() == 0 and line_dedup.without_shared_lines(no_docs).count() == 0
    plan = line_dedup.without_shared_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)


# --- near-duplicates with odd columns


def test_one_row_of_a_repeated_id_stays_and_names_may_clash(spark):
    from corpuslens.llm import simhash

    words = [" ".join(f"w{(i * 37 + j * j) % 991}" for j in range(40)) for i in range(6)]
    rows = [(1, words[0], 1, "a"), (1, words[1], 1, "b"), (2, words[0], 1, "c"), (3, words[2], 1, "d"), (4, words[2] + " more", 1, "e"), (None, words[2], 1, "f"), (5, None, 1, "g"), (6, "", 1, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone_id int, _place string").repartition(3)
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns
    got = {(r["doc_id"], r["text"]) for r in kept.collect()}
    first = min(words[0], words[1])
    assert got == {(1, first), (3, words[2]), (None, words[2]), (5, None)}
