"""Repeated substrings by merging Burrows-Wheeler transforms of shards.

Which byte strings of a fixed length start at more than one place of a corpus? Texts are first cut down, without loss,
to where such strings can lie; the rest is decided by transforms.

1. Anchors. The k-byte window with the least hash inside a string of the wanted length is its anchor; its own bytes
   decide it. A string whose anchor occurs once in the corpus cannot repeat. Neighbouring strings with the same anchor
   are a context: two equal strings lie in contexts of the same anchor, so an anchor's contexts can be judged apart
   from all others.
2. Where all contexts of an anchor are equal, their strings repeat as often as the context does.
3. All other contexts go to the anchor's partition, equal ones once with their count. Strings that hold a symbol seen
   nowhere else are settled at once (a first pass of one symbol). What remains is grouped into shards;
   each shard gets the order of its suffixes and their Burrows-Wheeler transform over symbols of STRIDE bytes (a text
   is STRIDE interleaved sequences). The transforms are merged by refining an interleave: pass n takes the symbols in
   the order of pass n - 1 and deals them out stably by symbol, after which the merged suffixes are in the order of
   their first n symbols; where a boundary appears in pass n, the common prefix is n - 1 symbols. After as many passes
   as the wanted length has symbols, an interval without a boundary inside is a repeated string. No suffix is sorted
   again once its shard is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import arrow_map, dealt, discard, output, scan, stored, stored_map, unused_name
from corpuslens.session import fresh_path

LENGTH = 200
#: Bytes of an anchor, and of a symbol of the transforms (LENGTH is a multiple of it).
ANCHOR, STRIDE = 64, 50
#: Bytes of contexts in a shard, and of those merged at once; contexts of one anchor always are.
SHARD_BYTES, MERGE_BYTES = 1 << 18, 1 << 20
#: An anchor with more occurrences is dealt out string by string.
HOT_ROWS = 100_000
_SLOTS = 22
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_BYTES = np.random.default_rng(20).integers(0, 2**63, 256, dtype=np.uint64)


def _mixed(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    h = a * _ODD[level] + b
    return h ^ h >> np.uint64(29)


def gram_hashes(data: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """64-bit hashes of all windows of each size, put together from windows of powers of two."""
    powers, size, level = {1: _BYTES[data]}, 1, 0
    while size * 2 <= max(sizes):
        h = powers[size]
        powers[size * 2] = _mixed(h[:-size], h[size:], level)
        size, level = size * 2, level + 1
    out = {}
    for wanted in sizes:
        done, h = 0, None
        for power in sorted(powers, reverse=True):
            if wanted - done >= power:
                part = powers[power][done : len(data) - wanted + done + 1]
                h, done = part if h is None else _mixed(h, part, 7), done + power
        h = h * _ODD[6]
        out[wanted] = h ^ h >> np.uint64(32)
    return out


def _sliding(h: np.ndarray, width: int, best) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        h = best(h[:-size], h[size:])
        size *= 2
    return best(h[: len(h) - (width - size)], h[width - size :]) if size < width else h


def own_anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` windows the place of the least hash (of its upper half; ties to the left)."""
    places = hashes >> np.uint64(32) << np.uint64(32) | np.arange(len(hashes), dtype=np.uint64)
    return (_sliding(places, width, np.minimum) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def contexts_of(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last string of each context of a text, and the hash of every string."""
    hashes = gram_hashes(data, [ANCHOR, length])
    own = own_anchors(hashes[ANCHOR], length - ANCHOR + 1)
    cuts = np.flatnonzero(np.diff(own)) + 1
    first = np.concatenate([[0], cuts])
    return hashes[ANCHOR][own[first]], first, np.concatenate([cuts - 1, [len(own) - 1]]), hashes[length]


def _context_id(whole: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Identity of the bytes from window `first` to the end of window `last`: both windows cover them."""
    return _mixed(whole[first], whole[last] ^ (last - first).astype(np.uint64) * _ODD[5], 4)


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _anchored(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """anchor hash, context, key of the row, and how often, for each distinct anchor and context of a text."""
    for batch in batches:
        found: list[tuple[np.ndarray, ...]] = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = np.frombuffer((text or "").encode(), np.uint8)
            if len(data) < length:
                continue
            anchor, first, last, whole = contexts_of(data, length)
            context, at, often = np.unique(_context_id(whole, first, last), return_index=True, return_counts=True)
            found.append((anchor[at], context, np.full(len(often), key, np.int64), often))
        if found:
            anchor, context, key, often = (np.concatenate(x) for x in zip(*found, strict=True))
            yield output({"anchor": (_signed(anchor), pa.int64()), "context": (_signed(context), pa.int64()), "key": (key, pa.int64()), "often": (often, pa.int32())})


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of true."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2] - 1


class _Contexts:
    """Collects what a text gives: runs known to repeat, and contexts that are yet to be judged."""

    def __init__(self, length: int):
        self.length = length
        self.rows: list[tuple] = []
        self.texts: dict[tuple[int, int], list] = {}

    def text(self, doc_id: int | None, key: int, raw: bytes, equal: np.ndarray, mixed: np.ndarray, hot: np.ndarray) -> None:
        anchors, first, last, whole = contexts_of(np.frombuffer(raw, np.uint8), self.length)
        anchor = _signed(anchors)
        is_equal, is_open, is_hot = (np.isin(anchor, known) for known in (equal, mixed, hot))
        for a, b in zip(*_runs(is_equal), strict=True):
            self.rows.append(("run", doc_id, key, int(first[a]), int(last[b]), 0))
        a, b, group = first[is_open], last[is_open], anchor[is_open]
        if is_hot.any():  # strings of hot anchors are contexts of their own, dealt by their bytes
            lone = np.concatenate([np.arange(f, t + 1) for f, t in zip(first[is_hot], last[is_hot], strict=True)])
            a, b, group = np.concatenate([a, lone]), np.concatenate([b, lone]), np.concatenate([group, _signed(whole[lone])])
        context = _signed(_context_id(whole, a, b))
        for p, q, c, g in zip(a.tolist(), b.tolist(), context.tolist(), group.tolist(), strict=True):
            self.rows.append(("open", doc_id, key, p, q, c))
            known = self.texts.get((g, c))
            if known is None:
                self.texts[g, c] = [raw[p : q + self.length], 1]
            else:
                known[1] += 1

    def flush(self) -> pa.RecordBatch:
        n, texts = len(self.rows), list(self.texts.items())
        m = len(texts)
        kind, doc_id, key, first, last, context = zip(*self.rows, strict=True) if n else ((), (), (), (), (), ())
        none = [None] * n
        batch = {
            "kind": ([*kind, *["text"] * m], pa.string()),
            "doc_id": ([*doc_id, *[None] * m], pa.int64()),
            "key": ([*key, *[None] * m], pa.int64()),
            "first": ([*first, *[None] * m], pa.int64()),
            "last": ([*last, *[None] * m], pa.int64()),
            "context": ([*context, *[c for (_, c), _ in texts]], pa.int64()),
            "anchor": ([*none, *[g for (g, _), _ in texts]], pa.int64()),
            "often": ([*none, *[t[1] for _, t in texts]], pa.int64()),
            "bytes": ([*none, *[t[0] for _, t in texts]], pa.binary()),
        }
        self.rows, self.texts = [], {}
        return output(batch)


#: Bytes of distinct contexts that a task holds before it hands them on.
HELD_BYTES = 64 << 20
CONTEXTS = "kind string, doc_id long, key long, first long, last long, context long, anchor long, often long, bytes binary"


def _contexts(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    gathered, none = _Contexts(length), np.array([], np.int64)
    for batch in batches:
        lists = [[none if v is None else np.array(v, np.int64) for v in batch.column(i).to_pylist()] for i in (3, 4, 5)]
        for doc_id, key, text, *known in zip(*(batch.column(i).to_pylist() for i in range(3)), *lists, strict=True):
            gathered.text(doc_id, key, text.encode(), *known)
        if sum(len(t[0]) + 300 for t in gathered.texts.values()) + 300 * len(gathered.rows) > HELD_BYTES:
            yield gathered.flush()
    yield gathered.flush()


def shard_transform(symbols: np.ndarray, following: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of a shard's suffixes by their first `depth` symbols, and the symbol before each (0: none).

    symbols has the symbol at each place, 0 at a sequence's end; following the place after it (an end's is the end).
    """
    rank, done, ahead = symbols.astype(np.uint64), 1, following
    order = np.argsort(rank) if depth == 1 else None
    while done < depth:
        step = min(done, depth - done)
        if step < done:
            ahead = np.arange(len(symbols))
            for _ in range(step):
                ahead = following[ahead]
        pair = rank << np.uint64(32) | rank[ahead]
        order = np.argsort(pair)
        ordered = pair[order]
        rank = np.empty(len(pair), np.uint64)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]])).astype(np.uint64)
        done += step
        ahead = ahead[ahead]
    before = np.zeros(len(symbols), np.uint32)
    inner = np.flatnonzero(symbols)
    before[following[inner]] = symbols[inner]
    return order, before[order]


def merged_intervals(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard of each merged suffix, interval of each, common symbols with the one before) for `depth` symbols.

    Intervals without a boundary are suffixes equal in all `depth` symbols.
    """
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint16), [len(t) for t in transforms])
    symbols = np.concatenate(transforms)
    interval = np.zeros(len(symbols), np.int64)
    common = np.full(len(symbols), depth, np.int64)
    merged, number = np.empty_like(symbols), np.arange(len(symbols), dtype=np.uint64)
    for level in range(depth):
        merged[np.argsort(shard, kind="stable")] = symbols  # each shard's symbols, in the interleaved order so far
        keyed = np.sort(merged.astype(np.uint64) << np.uint64(32) | number)  # dealt out stably by symbol
        taken = (keyed & np.uint64(0xFFFFFFFF)).astype(np.int64)
        symbol, before = keyed >> np.uint64(32), interval[taken]
        new = (symbol[1:] != symbol[:-1]) | ((before[1:] != before[:-1]) & (symbol[1:] != 0))
        shard = shard[taken]
        interval = np.concatenate([[0], np.cumsum(new)])
        bound = np.concatenate([[True], new])
        common = np.where(bound & (common > level), level, common) if level else np.where(bound, 0, depth)
    return shard, interval, common


def shared_symbols(hashes: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Whether a symbol may occur more than once; never false for one that does."""
    slot = (hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)
    return np.bincount(slot, often, 1 << _SLOTS)[slot] > 1


def repeated_in(contexts: list[bytes], often: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(context, first, last) of the runs of strings that start more than once in the contexts, counted `often` times."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    begins, depth = np.cumsum(sizes) - sizes, length // STRIDE
    hashes = gram_hashes(data, [STRIDE])[STRIDE]
    inside = np.repeat(begins + sizes, sizes)  # where the context of each byte ends
    here = np.arange(len(hashes))
    valid = inside[: len(hashes)] - STRIDE >= here
    shared = valid & shared_symbols(hashes, np.where(valid, np.repeat(often, sizes)[: len(hashes)], 0))
    count = len(data) - length + 1
    may = inside[:count] - length >= here[:count]
    for i in range(depth):
        may &= shared[i * STRIDE : i * STRIDE + count]
    first, last = _runs(may)
    if not len(first):
        return []
    owner = np.searchsorted(begins, first, "right") - 1
    apart = (owner[1:] != owner[:-1]) | (first[1:] - last[:-1] >= length)  # runs that share bytes are one text
    first, last, owner = first[np.append(True, apart)], last[np.append(apart, True)], owner[np.append(True, apart)]
    found = _intervals(hashes, first, last - first + length, often[owner], length)
    return [(int(owner[i]), int(first[i] - begins[owner[i]]) + a, int(first[i] - begins[owner[i]]) + b) for i, a, b in found]


def _intervals(hashes: np.ndarray, begins: np.ndarray, sizes: np.ndarray, often: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(text, first, last) of repeated strings, by the merged transforms of the texts at `begins`."""
    starts = np.cumsum(sizes + 1) - (sizes + 1)  # each text has a place more than bytes; its last STRIDE places are ends
    total_size, depth = int((sizes + 1).sum()), length // STRIDE
    text = np.repeat(np.arange(len(sizes)), sizes + 1)
    local = np.arange(total_size) - starts[text]
    real = local <= (sizes - STRIDE)[text]
    _, code = np.unique(hashes[(begins[text] + local)[real]], return_inverse=True)
    symbols = np.zeros(total_size, np.uint32)
    symbols[real] = code.astype(np.uint32) + 1
    following = np.arange(total_size)
    following[real] += STRIDE
    shard_of = starts // SHARD_BYTES
    firsts = np.flatnonzero(np.concatenate([[True], shard_of[1:] != shard_of[:-1]]))
    edges = [*starts[firsts].tolist(), total_size]
    orders, transforms = [], []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        order, transform = shard_transform(symbols[a:b], following[a:b] - a, depth)
        orders.append(order + a)
        transforms.append(transform)
    shard, interval, _ = merged_intervals(transforms, depth)
    place = np.empty(total_size, np.int64)
    place[np.argsort(shard, kind="stable")] = np.concatenate(orders)
    starting = local[place] <= (sizes - length)[text[place]]
    counted = np.bincount(interval[starting], often[text[place[starting]]], interval[-1] + 1)
    hit = place[starting][counted[interval[starting]] > 1]
    flags = np.zeros(total_size, bool)
    flags[hit] = True
    first, last = _runs(flags)  # a text's last places start no string, so no run crosses
    return list(zip(text[first].tolist(), local[first].tolist(), local[last].tolist(), strict=True))


def _merged(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Repeated runs of each context, of rows (anchor, context, often, bytes) sorted by anchor."""
    texts: dict[int, list] = {}
    groups: list[tuple[int, int]] = []  # contexts and bytes of each finished anchor
    anchor, held = None, 0

    def flush(items: dict[int, list]) -> pa.RecordBatch:
        ids, contexts, often = list(items), [t[0] for t in items.values()], np.array([t[1] for t in items.values()], np.int64)
        found = repeated_in(contexts, often, length) if contexts else []
        return output({"context": ([ids[i] for i, _, _ in found], pa.int64()), "from_": ([a for _, a, _ in found], pa.int64()), "to_": ([b for _, _, b in found], pa.int64())})

    own: dict[int, list] = {}

    def finish() -> None:
        """Contexts of the anchor go on to the transforms, unless there is one that occurs once."""
        nonlocal held
        if len(own) > 1 or any(t[1] > 1 for t in own.values()):
            texts.update(own)
            held += sum(len(t[0]) for t in own.values())
        own.clear()

    for batch in batches:
        for row_anchor, context, often, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row_anchor != anchor:
                finish()
                anchor = row_anchor
                if held >= MERGE_BYTES:
                    yield flush(texts)
                    texts, held = {}, 0
            known = own.get(context)
            if known is None:
                own[context] = [data, often]
            else:
                known[1] += often
    finish()
    yield flush(texts)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, key, runs (first, last): runs of places where strings of `length` bytes start that start elsewhere too.

    docs has doc_id, text and key, a hash of both; rows equal in both are told apart by nothing and share their runs.
    """
    spark = docs.sparkSession
    anchors = fresh_path(spark, "anchors")
    found = stored(arrow_map(docs.select("key", "text"), partial(_anchored, length=length), "anchor long, context long, key long, often int"), "anchors", path=anchors)
    of_anchor = found.groupBy("anchor").agg(F.sum("often").alias("n"), F.min("context").alias("a"), F.max("context").alias("b"))
    kind = F.when(F.col("a") == F.col("b"), 0).when(F.col("n") > HOT_ROWS, 2).otherwise(1)
    of_anchor = of_anchor.where("n > 1").select("anchor", kind.alias("kind"))
    known = found.select("anchor", "key").join(of_anchor, "anchor").groupBy("key")
    known = known.agg(*[F.collect_set(F.when(F.col("kind") == k, F.col("anchor"))).alias(f"k{k}") for k in (0, 1, 2)])
    del found, of_anchor
    known = stored(known, "shared-anchors")
    discard(spark, anchors)
    rows = docs.select("doc_id", "key", "text").join(known.hint("shuffle_hash"), "key")
    parts = arrow_map(rows.select("doc_id", "key", "text", "k0", "k1", "k2"), partial(_contexts, length=length), CONTEXTS)
    parts = stored(parts, "contexts", "kind")
    texts = dealt(parts.where("kind = 'text'").select("anchor", "context", "often", "bytes"), "anchor").sortWithinPartitions("anchor", "context")
    judged = stored_map(texts, partial(_merged, length=length), "context long, from_ long, to_ long", 4000, "repeated")
    judged = judged.groupBy("context").agg(F.collect_list(F.struct("from_", "to_")).alias("judged"))
    runs = parts.where("kind = 'run'").groupBy("doc_id", "key").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    # One row a context on the one side, one a text and context on the other: places are laid out inside the rows.
    opened = parts.where("kind = 'open'").groupBy("doc_id", "key", "context").agg(F.collect_set("first").alias("places")).join(judged, "context")
    spread = F.transform("places", lambda p: F.transform("judged", lambda r: F.struct((p + r["from_"]).alias("first"), (p + r["to_"]).alias("last"))))
    return runs.union(opened.select("doc_id", "key", F.flatten(spread).alias("runs")))


def _cut(batches: Iterator[pa.RecordBatch], length: int, as_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, spans = [], []
        for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data, out, at, gone = (text or "").encode(), [], 0, []
            for run in sorted((r["first"], r["last"] + length) for r in runs or []):
                if gone and run[0] <= gone[-1][1]:
                    gone[-1][1] = max(gone[-1][1], run[1])
                else:
                    gone.append([*run])
            for a, b in gone:
                out.append(data[at:a])
                at = b
            out.append(data[at:])
            kept.append(b"".join(out).decode("utf-8", "ignore") if as_text else b"".join(out))
            spans.append([{"start": a, "end": b} for a, b in gone])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind), pa.array(kept, pa.string() if as_text else pa.binary()), *batch.columns[3:]], names=["doc_id", "spans", "kept", *batch.schema.names[3:]])


def remove_repeats(docs: DataFrame, length: int = LENGTH, carry: list[str] | None = None, as_text: bool = False) -> DataFrame:
    """doc_id, spans (byte ranges removed), kept (the bytes that remain), n_bytes and the columns named in `carry`.

    Every byte that a string of `length` bytes covers which also starts anywhere else, in the same text or another, is
    removed; strings are judged on the texts as they came. A carried column whose name is taken gets underscores before
    it. Null texts are empty; texts shorter than `length` stay
    whole; null doc_ids and repeated rows count like any other (repeated long texts vanish); an empty table gives no
    rows; columns not named are not read. With as_text, kept is text without the characters that a cut has split.
    """
    if length % STRIDE or length < ANCHOR + STRIDE:
        raise ValueError(f"length must be a multiple of {STRIDE} from {ANCHOR + STRIDE} on")
    named = [F.col(f"`{c}`").alias(f"carried_{i}") for i, c in enumerate(carry or [])]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *named)
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(rows, length)
    spans = spans.groupBy("key", "doc_id").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    spans = spans.withColumnsRenamed({"key": "s_key", "doc_id": "s_doc"}).hint("shuffle_hash")
    joined = rows.join(spans, (F.col("key") == F.col("s_key")) & F.col("doc_id").eqNullSafe(F.col("s_doc")), "left")
    columns = [F.col(f"carried_{i}") for i in range(len(named))]
    types = "".join(f", carried_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry or []))
    fields = f"doc_id long, spans array<struct<start:bigint,end:bigint>>, kept {'string' if as_text else 'binary'}, n_bytes long{types}"
    cut = arrow_map(joined.select("doc_id", "text", "runs", F.octet_length("text").cast("long").alias("n_bytes"), *columns), partial(_cut, length=length, as_text=as_text), fields)
    names = ["doc_id", "spans", "kept", "n_bytes"]
    for c in carry or []:
        names.append(unused_name(c, names))
    return cut.toDF(*names)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows with repeats cut out of their text; other columns stay, n_chars counts the text anew if there is one."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = remove_repeats(docs, length, others, as_text=True)
    at = {"doc_id": F.col("doc_id"), "text": F.col("kept"), **{c: F.col(f"`{name}`") for c, name in zip(others, cut.columns[4:], strict=True)}}
    if "n_chars" in at:
        at["n_chars"] = F.char_length("kept").cast(docs.schema["n_chars"].dataType)
    return cut.select(*[at[c].alias(c) for c in docs.columns])


def op7_repeats(spark, sf_dir):
    rows = remove_repeats(scan(spark, sf_dir, "documents", "doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
