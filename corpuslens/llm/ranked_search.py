"""Ranked lexical search of many items at once, each shared part of them evaluated once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import BATCH_ROWS, WIDE_ROWS, output, scan, stored, stored_map

#: Bytes of the texts of a tile (one document may have more), and terms of a block of items (one item may have more).
TILE_BYTES, BLOCK_TERMS = 2_000_000, 8192
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TILE = "tile long, n_docs long, n_terms long, doc_ids array<long>, lengths binary, terms array<string>, counts array<long>, docs binary, tfs binary"
BLOCK = "block long, item_ids array<long>, terms array<string>, weights binary, atom_of binary, parents binary, added binary, node_of binary, rest_begins binary, rest binary"


def terms_of(text: Column) -> Column:
    """Maximal runs of digits, letters and everything beyond ASCII, A-Z in lower case."""
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), _SEPARATORS), "")


# --- documents: tiles of postings


def _byte_classes() -> np.ndarray:
    """Each byte in lower case, or 0 where it separates terms."""
    kept = np.array([b if b >= 128 or chr(b).isalnum() else 0 for b in range(256)], np.uint8)
    kept[65:91] += 32
    return kept


def _tile(ids: pa.Array, texts: pa.Array, classes: np.ndarray, number: int) -> pa.RecordBatch:
    """The inverted postings of some documents, which are put in order of doc_id."""
    order = pc.sort_indices(ids)
    ids, texts = ids.take(order), texts.take(order).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    ends = offsets - offsets[0]
    data = classes[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    inside = data != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = ends[1:-1][ends[1:-1] < len(data)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    kept = np.cumsum(inside, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    token_ends = np.append(kept[starts] - 1, kept[-1] if len(kept) else 0).astype(np.int64)
    del kept
    tokens = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(token_ends), pa.py_buffer(data[inside]))
    coded = tokens.dictionary_encode()
    doc_of = np.searchsorted(ends, starts, side="right") - 1
    pairs, tfs = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(ids) + doc_of, return_counts=True)
    lengths = np.bincount(doc_of, minlength=len(ids)).astype("<i8")
    counts = np.bincount(pairs // len(ids), minlength=len(coded.dictionary))
    columns = {
        "tile": ([number], pa.int64()), "n_docs": ([int((lengths > 0).sum())], pa.int64()), "n_terms": ([len(starts)], pa.int64()), "doc_ids": ([ids.to_pylist()], pa.list_(pa.int64())),
        "lengths": ([lengths.tobytes()], pa.binary()), "terms": ([coded.dictionary.to_pylist()], pa.list_(pa.string())), "counts": ([counts.tolist()], pa.list_(pa.int64())),
        "docs": ([(pairs % len(ids)).astype("<i4").tobytes()], pa.binary()), "tfs": ([tfs.astype("<i4").tobytes()], pa.binary()),
    }
    return output(columns)


def _tiles(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    number, classes = TaskContext.get().partitionId() << 32, _byte_classes()
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(1).cast(pa.large_binary())
        room = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)) // most
        cuts = [0, *(np.flatnonzero(np.diff(room)) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            yield _tile(batch.column(0).slice(begin, end - begin), texts.slice(begin, end - begin), classes, number)
            number += 1


# --- items: blocks with the graph of what they share


def _weighted(items: DataFrame, tiles: DataFrame, n_docs: int) -> DataFrame:
    """item_id, term, weight of every term of an item that a document holds."""
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(terms_of(F.col("text"))).alias("term")).distinct()
    held = tiles.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.counts").alias("df"))
    df = held.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0)))
    return asked.join(df, "term").select("item_id", "term", weight.cast("long").alias("weight"))


def shared_sets(weighted: DataFrame) -> DataFrame:
    """item_id, path, terms: the term sets that items share, mined from (item_id, term, weight).

    Terms that the same items hold form an atom, told by two hashes of that set of items. path has an item's atoms, the
    ones of most items first, so items that share atoms share a prefix of the path; terms has (term, weight, atom).
    """
    member = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), F.coalesce(F.col("item_id").cast("string"), F.lit(""))))
    sets = weighted.groupBy("term").agg(F.struct((-F.count("*")).alias("c"), member(1).alias("a"), member(2).alias("b")).alias("atom"))
    terms = F.sort_array(F.collect_list(F.struct("atom", "term", "weight")))
    listed = weighted.join(sets, "term").groupBy("item_id").agg(terms.alias("terms"))
    return listed.select("item_id", F.array_distinct(F.transform("terms", lambda t: t["atom"])).alias("path"), "terms")


def _block(items: list[dict], number: int) -> pa.RecordBatch:
    """Items and their graph: terms add up to atoms, atoms to the path prefixes that items share, these to items."""
    atoms: dict[tuple, int] = {}
    terms: dict[str, tuple[int, int]] = {}
    paths = []
    for item in items:
        for t in item["terms"]:
            terms[t["term"]] = (t["weight"], atoms.setdefault((t["atom"]["a"], t["atom"]["b"]), len(atoms)))
        paths.append([atoms[p["a"], p["b"]] for p in item["path"]])
    below: dict[tuple[int, int], int] = {}
    uses: list[int] = []
    for path in paths:
        at = -1
        for atom in path:
            at = below.setdefault((at, atom), len(uses))
            if at == len(uses):
                uses.append(0)
            uses[at] += 1
    nodes, parents, added = {-1: -1}, [], []
    for (parent, atom), at in below.items():
        if uses[at] > 1:
            nodes[at] = len(parents)
            parents.append(nodes[parent])
            added.append(atom)
    node_of, rest = [], []
    for path in paths:
        at, depth = -1, 0
        while depth < len(path) and uses[below[at, path[depth]]] > 1:
            at, depth = below[at, path[depth]], depth + 1
        node_of.append(nodes[at])
        rest.append(path[depth:])
    ints = lambda values: ([np.array(values, "<i4").tobytes()], pa.binary())
    columns = {
        "block": ([number], pa.int64()), "item_ids": ([[i["item_id"] for i in items]], pa.list_(pa.int64())), "terms": ([list(terms)], pa.list_(pa.string())),
        "weights": ([np.array([w for w, _ in terms.values()], "<i8").tobytes()], pa.binary()), "atom_of": ints([a for _, a in terms.values()]), "parents": ints(parents), "added": ints(added),
        "node_of": ints(node_of), "rest_begins": ints(np.cumsum([0, *map(len, rest)])), "rest": ints([a for r in rest for a in r]),
    }
    return output(columns)


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    number, held, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        for row in batch.to_pylist():
            if held and size + len(row["terms"]) > most:
                yield _block(held, number)
                number, held, size = number + 1, [], 0
            held.append(row)
            size += len(row["terms"])
    if held:
        yield _block(held, number)


# --- scores


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k highest scores above 0 of each row, ties to the smaller column."""
    k = min(k, scores.shape[1])
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
    above = scores > np.maximum(least, 0)
    level = (scores == least) & (scores > 0)
    level &= np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | level)


def _scored(batches: Iterator[pa.RecordBatch], k: int, n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
    ints = lambda row, name: np.frombuffer(row[name].as_py(), "<i4")
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            lengths = np.frombuffer(row["lengths"].as_py(), "<i8")
            ends = np.concatenate([[0], np.cumsum(row["counts"].values.to_numpy(zero_copy_only=False))]).astype(np.int64)
            docs, tfs = ints(row, "docs"), ints(row, "tfs").astype(np.int64)
            norm = 8 * (100 - 90 + 90 * lengths * n_docs // n_terms)
            weights, atom_of = np.frombuffer(row["weights"].as_py(), "<i8"), ints(row, "atom_of")
            atoms = np.zeros((atom_of.max(initial=-1) + 1, len(lengths)), np.int64)
            found = pc.index_in(row["q_terms"].values, value_set=row["terms"].values).fill_null(-1).to_numpy(zero_copy_only=False)
            for t in np.flatnonzero(found >= 0):
                at = slice(ends[found[t]], ends[found[t] + 1])
                atoms[atom_of[t], docs[at]] += weights[t] * (1_000_000_000 * tfs[at] // (1000 * tfs[at] + norm[docs[at]]))
            nodes = np.zeros((len(ints(row, "parents")) + 1, len(lengths)), np.int64)  # the last stays 0: where nothing is shared
            for at, (parent, atom) in enumerate(zip(ints(row, "parents"), ints(row, "added"), strict=True)):
                np.add(nodes[parent], atoms[atom], out=nodes[at])
            scores = nodes[ints(row, "node_of")]
            begins, rest = ints(row, "rest_begins"), ints(row, "rest")
            for item in range(len(scores)):
                for atom in rest[begins[item] : begins[item + 1]]:
                    scores[item] += atoms[atom]
            items, best = _best(scores, k)
            names, ids = row["item_ids"].values, row["doc_ids"].values
            columns = [names.take(pa.array(items)), pa.array([row["shard"].as_py()] * len(items), pa.int32()), ids.take(pa.array(best)), pa.array(scores[items, best])]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "shard", "doc_id", "score"])


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, tile_bytes: int = TILE_BYTES, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest BM25 scores above 0 of each item, in whole numbers.

    docs have doc_id and text, items item_id and text. Documents become tiles of inverted postings, without a shuffle.
    The sets of terms that items share are mined by Spark; items that share most lie in one block, with a graph: each
    term goes into one atom, an atom into path prefixes that several items share, a prefix into longer ones and into
    items. Tiles meet blocks by shard; there every atom and prefix is summed once over the tile's documents, whatever
    number of items use it. Tops of tiles are merged by shard, then by item. Memory of a task: a tile, a block and
    their sums; nothing is broadcast by hand and no document's links to items are stored.

    Null and empty texts have no terms and are not counted. A term counts once in an item; rows that repeat an item_id
    are one item. Repeated documents count each. Equal scores go to the smaller doc_id, a null one last. Items that no
    document matches and empty tables give no rows; further columns are not read.
    """
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tiles = stored_map(texts, partial(_tiles, most=tile_bytes), TILE, BATCH_ROWS // 2, "postings", WIDE_ROWS)
    n_docs, n_terms = (x or 0 for x in tiles.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    shared = stored(shared_sets(_weighted(items, tiles, n_docs)), "item-paths")
    n_blocks = -(-(shared.agg(F.sum(F.size("terms"))).first()[0] or 1) // block_terms)
    ordered = shared.repartitionByRange(n_blocks, "path").sortWithinPartitions("path", "item_id")
    blocks = stored_map(ordered, partial(_blocks, most=block_terms), BLOCK, BATCH_ROWS, "item-blocks", WIDE_ROWS)
    asks = blocks.withColumnRenamed("terms", "q_terms").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    # Blocks are there once a shard, so a broadcast would grow with the number of shards.
    pairs = tiles.withColumn("shard", F.pmod(F.xxhash64("tile"), F.lit(shards)).cast("int")).join(asks.hint("merge"), "shard")
    best = stored_map(pairs, partial(_scored, k=k, n_docs=n_docs, n_terms=max(n_terms, 1)), "item_id long, shard int, doc_id long, score long", 1, "tile-tops")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for keys in (["item_id", "shard"], ["item_id"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark, sf_dir):
    return ranked_search(scan(spark, sf_dir, "documents", "doc_id", "text"), scan(spark, sf_dir, "benchmark", "item_id", "text"))


#: The same in SQL.
OP11_SQL = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents
), s as (
  select count(*) filter (where len(terms) > 0) as n, cast(sum(len(terms)) as bigint) as l from d
), q as (
  select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark
), p as (
  select r, doc_id, n_terms, term, count(*) as tf from (select r, doc_id, len(terms) as n_terms, unnest(terms) as term from d) group by all
), w as (
  select term, cast(floor(1000 * ln((2.0::double * n + 2) / (2.0::double * count(*) + 1))) as bigint) as weight from p, s group by term, n
), scored as (
  select item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n_terms * n) // l))))) as score
  from q join p using (term) join w using (term), s group by item_id, r, doc_id
), ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from scored where score > 0
)
select item_id, cast(rank as integer) as rank, doc_id, cast(score as bigint) as score from ranked where rank <= 10
"""
