"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import arrow_map, dealt, output, scan, stored, stored_map, unused_name
from corpuslens.llm.components import components, forest

BITS = 64
#: Shingles hashed at once, rows of a bucket compared at once, and rows that Python gets at once.
BLOCK_SHINGLES, TILE, BUCKET_ROWS = 200_000, 2048, 20_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str | None, size: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of the word shingles of a whole text, in blocks; fewer words than `size` are one shingle, none gives none."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # of bytes: only A-Z change, only ASCII white space splits
    if not words:
        return
    line = b" ".join(words)
    ends = np.fromiter(accumulate(map(len, words)), np.int64, len(words)) + np.arange(len(words))
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)))[: max(1, len(words) - size + 1)].tolist()
    ends = ends[min(size, len(words)) - 1 :].tolist()
    digest = partial(xxh64_intdigest, seed=seed)
    for i in range(0, len(starts), BLOCK_SHINGLES):
        pieces = (line[a:b] for a, b in zip(starts[i : i + BLOCK_SHINGLES], ends[i : i + BLOCK_SHINGLES], strict=True))
        yield np.fromiter(map(digest, pieces), np.uint64)


def fingerprint(text: str | None, size: int, words: int = 1, seed: int = 42) -> np.ndarray:
    """Bit by bit the majority of the shingle hashes, repeats included; a tie is 0, and so is a text without words.

    Words of 64 bits beyond the first come from further mixings of the same hashes.
    """
    ones, total = np.zeros((words, BITS), np.int64), 0
    for hashes in shingle_hashes(text, size, seed):
        for word in range(words):
            if word:
                hashes = hashes * _ODD + np.uint64(word)
                hashes ^= hashes >> np.uint64(29)
                mixed = hashes * _ODD
                mixed ^= mixed >> np.uint64(32)
            else:
                mixed = hashes
            ones[word] += np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return np.packbits(2 * ones > total, axis=1, bitorder="little").view(np.uint64).ravel()


def _fingerprints(batches: Iterator[pa.RecordBatch], size: int, words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t, size, words) for t in batch.column(1).to_pylist()], np.uint64).reshape(-1, words).view(np.int64)
        columns = [pa.array(np.ascontiguousarray(prints[:, w])) for w in range(words)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *_names(words)])


def _names(words: int) -> list[str]:
    return [f"p{w}" for w in range(words)]


def fingerprints(docs: DataFrame, size: int, words: int = 1) -> DataFrame:
    """doc_id and fingerprint (64 bits in each of the longs p0, p1, ...) of each whole text; null and empty texts have zero."""
    fields = ", ".join(["doc_id long", *[f"{p} long" for p in _names(words)]])
    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), partial(_fingerprints, size=size, words=words), fields)


def segments(radius: int, rows: int) -> list[tuple[int, int, int]]:
    """(lowest bit, bits, ball radius) of each segment of 64 bits, so that no pair within `radius` is lost.

    Radii that sum to radius - segments + 1 lose nothing: with every segment one beyond its own, the distance would be
    greater than radius. The number of segments is that of the least expected work for so many fingerprints: keys of a
    ball to look up, and chance matches of each. It changes the work only, never the result.
    """

    def layout(count: int) -> list[tuple[int, int, int]]:
        cuts = [BITS * i // count for i in range(count + 1)]
        spare = radius - count + 1
        return [(a, b - a, spare // count + (i < spare % count)) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]

    def work(parts: list[tuple[int, int, int]]) -> float:
        return sum(sum(1 for r in range(ball + 1) for _ in combinations(range(bits), r)) * (1 + rows / 2**bits) for _, bits, ball in parts)

    return min((layout(count) for count in range(1, radius + 2) if count > 1 or radius == 0), key=work)


def _keys(parts: list[tuple[int, int, int]]) -> Column:
    """Array of (segment, key, probe): the fingerprint's own key in each segment, and the keys in the ball around it.

    Of two keys in one ball the larger looks up the smaller, so each pair meets once: a mask is used if its highest
    bit is set in the key.
    """
    keys = []
    for number, (low, bits, ball) in enumerate(parts):
        key = F.shiftrightunsigned(f"p{low // BITS}", low % BITS).bitwiseAND(F.lit((1 << bits) - 1))
        where = F.lit(number).cast("long")
        keys.append(F.array(F.struct(where.alias("segment"), key.alias("key"), F.lit(False).alias("probe"))))
        masks = [sum(1 << i for i in chosen) for r in range(1, ball + 1) for chosen in combinations(range(bits), r)]
        if masks:
            table = F.array(*[F.lit(m).cast("long") for m in masks])
            due = F.filter(table, lambda m: key.bitwiseAND(m) > m.bitwiseXOR(key).bitwiseAND(m))
            keys.append(F.transform(due, lambda m: F.struct(where.alias("segment"), key.bitwiseXOR(m).alias("key"), F.lit(True).alias("probe"))))
    return F.concat(*keys)


def _near(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Whether complete fingerprints, words in the last axis, are at most `radius` bits apart."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32) <= radius


def _compared(run: np.ndarray, table: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links in one large bucket, whose first `table` rows are its own; tile by tile, a forest of them is kept."""
    prints, ids = run["print"], run["id"]
    a, b = np.array([], np.int64), np.array([], np.int64)
    for i in range(0, table, TILE):
        for j in range(i, len(run), TILE):
            near = _near(prints[i : min(i + TILE, table), None], prints[None, j : j + TILE], radius)
            x, y = np.nonzero(near)
            a, b = forest(np.concatenate([a, ids[x + i]]), np.concatenate([b, ids[y + j]]))
    return a, b


def _links(batches: Iterator[pa.RecordBatch], radius: int, words: int) -> Iterator[pa.RecordBatch]:
    """Links inside the buckets of a partition sorted by bucket, own keys first."""
    kind = np.dtype([("segment", "i8"), ("key", "i8"), ("probe", "?"), ("id", "i8"), ("print", "u8", (words,))])
    rest = np.array([], kind)

    def linked(rows: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate([[True], (rows["key"][1:] != rows["key"][:-1]) | (rows["segment"][1:] != rows["segment"][:-1])]))
        sizes = np.diff(np.append(first, len(rows)))
        own = np.add.reduceat(~rows["probe"], first, dtype=np.int64)
        found = []
        large = np.flatnonzero(own * sizes > TILE * TILE)
        for r in large:
            found.append(_compared(rows[first[r] : first[r] + sizes[r]], int(own[r]), radius))
        own[large] = 0
        place = np.arange(len(rows)) - np.repeat(first, sizes)
        partners = np.minimum(place, np.repeat(own, sizes))  # the bucket's own rows before this one
        ends = np.cumsum(partners)
        step = 0
        while step < len(rows):  # so many rows at once that their pairs fit
            stop = max(step + 1, int(np.searchsorted(ends, (ends[step - 1] if step else 0) + TILE * TILE, "right")))
            n = partners[step:stop]
            right = np.repeat(np.arange(step, stop), n)
            left = np.repeat(np.repeat(first, sizes)[step:stop] - (np.cumsum(n) - n), n) + np.arange(len(right))
            near = _near(rows["print"][left], rows["print"][right], radius)
            found.append((rows["id"][left[near]], rows["id"][right[near]]))
            step = stop
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        a, b = forest(a, b)
        return output({"a": (a, pa.int64()), "b": (b, pa.int64())})

    for batch in batches:
        fresh = np.empty(batch.num_rows, kind)
        for name, column in zip(kind.names[:4], batch.columns, strict=False):
            fresh[name] = column.to_numpy(zero_copy_only=False)
        for word in range(words):
            fresh["print"][:, word] = batch.column(4 + word).to_numpy().view(np.uint64)
        rows = np.concatenate([rest, fresh])
        last = np.flatnonzero((rows["key"] != rows["key"][-1]) | (rows["segment"] != rows["segment"][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield linked(rows[:cut])
        rest = rows[cut:]
    if len(rest):
        yield linked(rest)


def linked_fingerprints(prints: DataFrame, parts: list[tuple[int, int, int]], radius: int, words: int) -> DataFrame:
    """Links (a, b) between rows (id, p0, p1, ...) at most `radius` bits apart, enough of them to join what is joined.

    Each fingerprint stands once in the table of its key in every segment and looks up the keys in a small ball; what
    meets in a bucket is compared over all bits. A bucket gives a forest of its links, never all pairs.
    """
    names = _names(words)
    rows = prints.select("id", *names, F.explode(_keys(parts)).alias("k"))
    rows = dealt(rows.select("k.segment", "k.key", "k.probe", "id", *names), "segment", "key")
    rows = rows.sortWithinPartitions("segment", "key", "probe")
    return stored_map(rows, partial(_links, radius=radius, words=words), "a long, b long", BUCKET_ROWS, "simhash-links")


def simhash_components(docs: DataFrame, size: int, radius: int) -> DataFrame:
    """doc_id, fingerprint (long) and component_id, the smallest doc_id reachable over links of at most `radius` of 64 bits.

    Documents with equal fingerprints are one node, so groups of copies cost one row. Empty and null texts share
    fingerprint zero and link like any other. Rows with a null doc_id get a fingerprint, link nothing, and have the
    component of their fingerprint if another row gives it one, else null. Repeated rows stay; an empty table gives no
    rows; further columns are not read.
    """
    prints = stored(fingerprints(docs, size), "fingerprints")
    nodes, bridges = _nodes(prints, ["p0"])
    links = linked_fingerprints(nodes, segments(radius, nodes.count()), radius, 1)
    found = components(links.union(bridges))
    nodes = nodes.join(found.withColumnRenamed("node", "id"), "id", "left").select("p0", F.coalesce("component", "id").alias("component_id"))
    return prints.join(nodes, "p0", "left").select("doc_id", F.col("p0").alias("fingerprint"), "component_id")


def _nodes(prints: DataFrame, names: list[str], *further: Column) -> tuple[DataFrame, DataFrame]:
    """Rows of equal columns `names` as one row with the smallest doc_id, id; and links of a doc_id in rows of several."""
    nodes = prints.where("doc_id is not null").groupBy(*names).agg(F.min("doc_id").alias("id"), *further)
    whole = F.struct(*names)
    several = prints.groupBy("doc_id").agg(F.min(whole).alias("x"), F.max(whole).alias("y")).where("x <> y").select("doc_id")
    bridges = prints.join(several, "doc_id").select("doc_id", *names).distinct().join(nodes.select("id", *names), names)
    return nodes, bridges.select(F.col("doc_id").alias("a"), F.col("id").alias("b"))


#: Longs of a fingerprint of distinct shingles, bits of a segment, and bits in which near candidates may differ in the half
#: that their segment is not in. Large sets of similarity 0.8 differ in 15 % of the bits, so some segment has at most one
#: of them except in 3 of 100,000 cases.
SET_WORDS, SEGMENT_BITS, SET_RADIUS = 8, 16, 72
#: Sets of so many shingles in all are fingerprinted at once.
BLOCK_VALUES = 1 << 16
#: Fingerprints that one task should hold of a segment, pairs compared at once, and pairs of two keys that are many.
GROUP_ROWS, BLOCK_PAIRS, MANY_PAIRS = 250_000, 1 << 18, 1 << 16


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Distinct hashes of the word shingles of a whole text, sorted."""
    blocks = list(shingle_hashes(text, size, 42))
    return np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, np.uint64)


def set_fingerprints(sets: list[np.ndarray], words: int = SET_WORDS) -> np.ndarray:
    """SimHash of each set that is not empty, in `words` longs: bit by bit the majority of its hashes; a tie is 0."""
    lengths = np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(lengths) - lengths
    values = np.concatenate(sets)
    prints = np.empty((len(sets), words), np.uint64)
    for word in range(words):
        hashes = values * _ODD + np.uint64(word)
        hashes ^= hashes >> np.uint64(29)
        hashes *= _ODD
        hashes ^= hashes >> np.uint64(32)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        prints[:, word] = np.packbits(2 * ones > lengths[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return prints


def _set_names() -> list[str]:
    return [f"w{i}" for i in range(SET_WORDS)]


def _set_printed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_intdigest

    for batch in batches:
        sets = [shingle_set(t, size) for t in batch.column(1).to_pylist()]
        digests = np.array([[d >> 64, d & (1 << 64) - 1] for d in (xxh3_128_intdigest(s.tobytes()) for s in sets)], np.uint64).reshape(-1, 2).view(np.int64)
        prints = np.zeros((len(sets), SET_WORDS), np.uint64)
        some, held = [], 0
        for i, s in enumerate(sets):
            if len(s):
                some.append(i)
                held += len(s)
            if some and (held >= BLOCK_VALUES or i == len(sets) - 1):
                prints[some] = set_fingerprints([sets[j] for j in some])
                some, held = [], 0
        columns = [np.ascontiguousarray(c) for c in (digests[:, 0], digests[:, 1], *prints.view(np.int64).T)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names=["doc_id", "p0", "p1", *_set_names()])


def _placed(nodes: DataFrame, high: int) -> DataFrame:
    """part, low, id and the half of the fingerprint without the segment: two rows a segment, however many parts there are.

    Keys that differ in at most one bit share their `high` highest or their `high` lowest bits. The even parts of a
    segment hold the keys of the same highest bits, for neighbours by another bit; the odd parts hold those of the same
    lowest bits, with the highest bits moved to the end of low, for neighbours by one of these.
    """
    bits, half, segments_each = SEGMENT_BITS - high, SET_WORDS // 2, 64 // SEGMENT_BITS
    cuts = [divmod(n * SEGMENT_BITS, 64) for n in range(SET_WORDS * segments_each)]
    keys = [F.shiftrightunsigned(f"w{word}", low).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)).cast("int") for word, low in cuts]
    late = F.col("segment") >= half * segments_each
    others = [F.when(late, F.col(f"w{i}")).otherwise(F.col(f"w{half + i}")).alias(f"w{i}") for i in range(half)]
    key, first = F.col("key"), F.col("segment") * (2 << high)
    top, rest, end = F.shiftright(key, bits), key.bitwiseAND(F.lit((1 << bits) - 1)), key.bitwiseAND(F.lit((1 << high) - 1))
    turned = F.shiftleft(F.shiftright(rest, high), high).bitwiseOR(top)
    by_top = F.struct((first + top).alias("part"), rest.alias("low"))
    by_end = F.struct((first + (1 << high) + end).alias("part"), turned.alias("low"))
    rows = nodes.select("id", *_set_names(), F.posexplode(F.array(*keys)).alias("segment", "key"))
    return rows.select("id", *others, F.explode(F.array(by_top, by_end)).alias("k")).select("k.part", "k.low", "id", *[f"w{i}" for i in range(half)])


def _joined(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Components after links between places x and y; `root` names the smallest place of each."""
    a, b = forest(root[x], root[y])
    moved = np.arange(len(root))
    moved[a] = b
    return moved[root]


def part_components(low: np.ndarray, probe: np.ndarray, prints: np.ndarray, bits: int, radius: int) -> np.ndarray:
    """For each row of a part the first row of its component, over pairs whose keys differ in at most one bit and whose
    fingerprints differ in at most `radius`. Rows are sorted by probe, then by low key; probes meet their own key only.

    Where many rows meet many, rows already in one component are not compared, so a group of near copies costs little.
    """
    own = int(np.searchsorted(probe, True))
    keys, root = low[:own], np.arange(len(low))
    shown, first, held = np.unique(keys, return_index=True, return_counts=True)

    def meet(rows: np.ndarray, start: np.ndarray, n: np.ndarray) -> None:
        """Rows against the n rows from start each."""
        nonlocal root
        ends, step = np.cumsum(n), 0
        while step < len(rows):
            done = int(ends[step - 1]) if step else 0
            stop = max(step + 1, int(np.searchsorted(ends, done + BLOCK_PAIRS, "right")))
            c = n[step:stop]
            x = np.repeat(rows[step:stop], c)
            y = np.repeat(start[step:stop] - (np.cumsum(c) - c), c) + np.arange(len(x))
            apart = np.flatnonzero(root[x] != root[y])
            x, y = x[apart], y[apart]
            near = _near(prints[x], prints[y], radius)
            if near.any():
                root = _joined(root, x[near], y[near])
            step = stop

    def meet_many(rows: np.ndarray, others: np.ndarray) -> None:
        nonlocal root
        for i in range(0, len(rows), 64):
            block = rows[i : i + 64]
            for j in range(0, len(others), TILE):
                tile = others[j : j + TILE]
                if root[block[0]] == root[block].max():
                    tile = tile[root[tile] != root[block[0]]]
                if len(tile):
                    x, y = np.nonzero(_near(prints[block, None], prints[None, tile], radius))
                    if len(x):
                        root = _joined(root, block[x], tile[y])

    def look_up(rows: np.ndarray, wanted: np.ndarray) -> None:
        """Rows, in the order of the keys they want, against the own rows of those keys."""
        at = np.minimum(np.searchsorted(shown, wanted), len(shown) - 1)
        found = shown[at] == wanted
        rows, at = rows[found], at[found]
        asking = np.bincount(at, minlength=len(shown))
        many = asking * held > MANY_PAIRS
        for k in np.flatnonzero(many).tolist():
            meet_many(rows[at == k], np.arange(first[k], first[k] + held[k]))
        few = ~many[at]
        meet(rows[few], first[at[few]], held[at[few]])

    if own:
        place = np.arange(own)
        at = np.searchsorted(shown, keys)
        many = held * held > MANY_PAIRS
        for k in np.flatnonzero(many).tolist():
            meet_many(place[first[k] : first[k] + held[k]], place[first[k] : first[k] + held[k]])
        few = ~many[at]
        meet(place[few], first[at[few]], place[few] - first[at[few]])
        look_up(np.arange(own, len(low)), low[own:])
        for bit in range(bits):
            asks = place[keys >> bit & 1 == 1]
            look_up(asks, keys[asks] - (1 << bit))
    return root


def _near_links(batches: Iterator[pa.RecordBatch], high: int, radius: int) -> Iterator[pa.RecordBatch]:
    """Links of rows sorted by part and low key: of each row to the smallest id of its component in the part.

    A group of near copies meets in many parts; its smallest id is the same in most, so many of its links are equal.
    """
    kind = np.dtype([("part", "i4"), ("low", "i4"), ("id", "i8"), ("print", "u8", (SET_WORDS // 2,))])
    held: list[np.ndarray] = []

    def linked() -> pa.RecordBatch:
        rows = np.concatenate(held)
        bits = high if rows["part"][0] >> high & 1 else SEGMENT_BITS - high
        root = part_components(rows["low"], np.zeros(len(rows), bool), np.ascontiguousarray(rows["print"]), bits, radius)
        least = rows["id"].copy()
        np.minimum.at(least, root, rows["id"])
        rest = np.flatnonzero(rows["id"] != least[root])
        return output({"a": (rows["id"][rest], pa.int64()), "b": (least[root[rest]], pa.int64())})

    for batch in batches:
        fresh = np.empty(batch.num_rows, kind)
        for name, column in zip(kind.names[:3], batch.columns, strict=False):
            fresh[name] = column.to_numpy(zero_copy_only=False)
        for word in range(SET_WORDS // 2):
            fresh["print"][:, word] = batch.column(3 + word).to_numpy().view(np.uint64)
        for piece in np.split(fresh, np.flatnonzero(np.diff(fresh["part"])) + 1):
            if held and held[-1]["part"][-1] != piece["part"][0]:
                yield linked()
                held = []
            held.append(piece)
    if held:
        yield linked()


#: Links of which a forest is made at once.
FOREST_LINKS = 1 << 20


def _fewer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forests of the links, many at a time: those of a row, at most one from each of its places, are in one task."""
    held: list[pa.RecordBatch] = []

    def reduced() -> pa.RecordBatch:
        a, b = forest(*(np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1)))
        return output({"a": (a, pa.int64()), "b": (b, pa.int64())})

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= FOREST_LINKS:
            yield reduced()
            held = []
    if held:
        yield reduced()


def near_fingerprints(nodes: DataFrame, radius: int = SET_RADIUS) -> DataFrame:
    """Links (a, b) that join the rows (id, w0, w1, ...) of which a segment differs in at most one bit and the half of the
    fingerprint without that segment in at most `radius`.

    Multi-index hashing: a fingerprint stands in two parts for each segment and meets the keys of the ball of one bit
    around its own; the other half's bits decide, and no more than these are sent. The number of rows sets how many
    parts there are, never what is compared nor how many rows a fingerprint becomes.
    """
    high = min(SEGMENT_BITS // 2, max(2, (nodes.count() // GROUP_ROWS).bit_length()))
    rows = dealt(_placed(nodes, high), "part").sortWithinPartitions("part", "low")
    links = stored_map(rows, partial(_near_links, high=high, radius=radius), "a long, b long", BUCKET_ROWS, "near-links")
    return stored_map(dealt(links, "a"), _fewer, "a long, b long", BUCKET_ROWS, "near-forests")


def similar_components(ids: np.ndarray, sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set the smallest id reachable over pairs whose Jaccard similarity is at least `similarity`.

    From each set reached, all sets not yet reached are counted over the postings of its shingles; a set once reached
    is counted no more, so a group of near copies costs one pass over its sets.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    values, index = np.unique(np.concatenate(sets), return_inverse=True)
    begins = np.cumsum(sizes) - sizes
    root = np.full(len(sets), -1, np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(index, kind="stable")
    terms, docs = index[order], owner[order]
    at = np.searchsorted(terms, np.arange(len(values) + 1))
    waiting = listed = len(sets)
    for first in np.argsort(ids, kind="stable").tolist():
        if root[first] >= 0:
            continue
        root[first] = ids[first]
        waiting -= 1
        queue = [first]
        while queue and waiting:
            if 2 * waiting < listed:  # postings of the sets not yet reached only
                keep = root[docs] < 0
                terms, docs, listed = terms[keep], docs[keep], waiting
                at = np.searchsorted(terms, np.arange(len(values) + 1))
            i = queue.pop()
            own = index[begins[i] : begins[i] + sizes[i]]
            n = at[own + 1] - at[own]
            places = np.repeat(at[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            found, both = np.unique(docs[places], return_counts=True)
            near = found[(both >= similarity * (sizes[i] + sizes[found] - both) * (1 - 1e-12)) & (root[found] < 0)]
            root[near] = ids[first]
            waiting -= len(near)
            queue.extend(near.tolist())
    return root


def _verified(batches: Iterator[pa.RecordBatch], size: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Links of each text (id, text) to the smallest id of its component, in rows sorted by candidate component."""
    group, ids, sets = None, [], []

    def linked() -> pa.RecordBatch:
        nodes = np.array(ids, np.int64)
        return output({"a": (nodes, pa.int64()), "b": (similar_components(nodes, sets, similarity), pa.int64())})

    for batch in batches:
        for component, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if component != group and ids:
                yield linked()
                ids, sets = [], []
            group = component
            ids.append(doc_id)
            sets.append(shingle_set(text, size))
    if ids:
        yield linked()


#: Bits for each id in the bitmap of a set of ids, and the most that there are; a longer set makes the bitmap less selective.
ID_BITS, MOST_BITS = 32, 1 << 27


def may_be_among(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """docs with a boolean `name`: false only where the doc_id is not among the ids (one column, of longs).

    A bitmap of the ids' hashes, of bounded size, goes to every task, so that rows whose bit is not set need no exchange.
    """
    size = min(MOST_BITS, max(1 << 15, ids.count() * ID_BITS))

    def slot(column: Column) -> Column:
        return F.pmod(F.xxhash64(column.cast("long")), F.lit(size))

    def byte(column: Column) -> Column:
        return F.conv(F.hex(column), 16, 10).cast("int")

    place, block, bits = (unused_name(c, docs.columns) for c in ("_slot", "_block", "_bits"))
    slots = ids.select(slot(F.col(ids.columns[0])).alias("s"))
    bitmap = slots.groupBy(F.shiftright("s", 15).alias(block)).agg(F.bitmap_construct_agg(F.col("s").bitwiseAND(F.lit(32767))).alias(bits))
    rows = docs.withColumn(place, slot(F.col("doc_id"))).join(F.broadcast(bitmap), F.shiftright(place, 15) == F.col(block), "left")
    at = F.col(place).bitwiseAND(F.lit(32767)).cast("int")
    held = byte(F.substring(F.col(bits), F.shiftright(at, 3) + 1, F.lit(1)))
    is_set = F.coalesce(F.getbit(held, at.bitwiseAND(F.lit(7))) == 1, F.lit(False))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], is_set.alias(name))


def similar_links(docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links (a, b) between doc_ids that join what pairs of texts of at least this Jaccard similarity join.

    Candidates come from SimHash fingerprints of the distinct shingles by multi-index hashing and are joined into
    components; inside each, the distinct shingles of the texts themselves decide. Texts of the same shingles are one
    node. No pair is a row.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    fields = ", ".join(["doc_id long, p0 long, p1 long", *[f"{w} long" for w in _set_names()]])
    prints = stored(arrow_map(texts, partial(_set_printed, size=size), fields), "set-fingerprints")
    nodes, bridges = _nodes(prints, ["p0", "p1"], *[F.min(w).alias(w) for w in _set_names()])
    found = components(near_fingerprints(stored(nodes, "set-nodes")))
    likely = may_be_among(texts, found.select("node"), "_likely").where("_likely")
    chosen = likely.join(found.withColumnRenamed("node", "doc_id"), "doc_id").select("component", "doc_id", "text")
    chosen = dealt(chosen, "component").sortWithinPartitions("component", "doc_id")
    same = prints.where("doc_id is not null").join(nodes.select("id", "p0", "p1"), ["p0", "p1"]).select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    return arrow_map(chosen, partial(_verified, size=size, similarity=similarity), "a long, b long").union(bridges).union(same)


def one_of_each_group(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs without near-duplicates: of texts linked by a similarity of word shingles, the smallest doc_id.

    A link is an exact Jaccard similarity of the sets of distinct shingles (by 64-bit hashes) of at least `similarity`;
    the number of rows has no part in it. Equal texts are near-duplicates, empty and null ones too. Of rows that share
    a doc_id the one with the smallest text stays; rows with a null doc_id stay all; all columns are kept; an empty table gives no rows.
    """
    rows, ids = docs.agg(F.count("doc_id"), F.count_distinct("doc_id")).first()
    found = components(similar_links(docs, size, similarity))
    mark, place, likely = (unused_name(c, docs.columns) for c in ("_gone_id", "_place", "_likely"))
    gone = found.where("node > component").select(F.col("node").alias(mark))
    told = may_be_among(docs.where("doc_id is not null"), gone, likely)
    judged = told.where(F.col(likely)).join(gone, F.col("doc_id").cast("long") == F.col(mark), "left_anti")
    kept = told.where(~F.col(likely)).union(judged).drop(likely)
    if ids < rows:
        first = Window.partitionBy("doc_id").orderBy(F.col("text").cast("string").asc_nulls_first(), *[F.xxhash64(F.col(f"`{c}`").cast("string")) for c in docs.columns])
        kept = kept.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).drop(place)
    return kept.union(docs.where("doc_id is null"))


def op10_simhash(spark, sf_dir):
    rows = simhash_components(scan(spark, sf_dir, "documents", "doc_id", "text"), size=4, radius=4)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
