"""Token ids in Re-Pair compressed files, readable at random.

A file holds consecutive documents of one range of doc_id, all numbers little-endian:

    magic "REPAIR01"; 7 unsigned 64-bit numbers: documents, tokens, symbols, rules, first nonterminal, bytes of a symbol, 0
    doc_id of each document (signed 64-bit), then a byte each: 1 if the doc_id is null
    first symbol of each document, then the number of symbols (unsigned 64-bit)
    first token of each document, then the number of tokens (unsigned 64-bit)
    the rules: left and right symbol of nonterminal first+i (unsigned 32-bit pairs)
    the expansion length of each rule (unsigned 32-bit)
    the symbols

No rule spans two documents, so each document is a run of whole symbols, found by its offset and decoded alone.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.llm.common import BATCH_ROWS, arrow_map, dealt, file_at, fresh_path, output, scan, stored_map
from corpuslens.llm.tokens import word_tokenizer

MAGIC = b"REPAIR01"
HEADER = struct.Struct("<8s7Q")
END_ID = 1
#: Tokens of a file, rules of a pass over it, and uses that a rule needs.
FILE_TOKENS, PASS_RULES, MIN_USES = 2_000_000, 5000, 8
_SLOTS, _MIX = 18, 0x9E3779B97F4A7C15


def compress(tokens: np.ndarray, ends: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, their document ends, and rules of ids whose documents end where `ends` is true.

    Re-Pair in passes: a pass counts all pairs inside documents, gives the most frequent ones a nonterminal each, and
    replaces them from the left without overlap; the next pass sees the new symbols, until no pair is frequent. Once a
    pass has left none of the frequent pairs over, only pairs with one of its nonterminals can become frequent, so the
    next one looks at those places and no others.
    """
    symbols, rules = tokens, []
    due: np.ndarray | None = None  # places that may begin a frequent pair; all of them at first
    while len(symbols) >= 2:
        # Two symbols of 16 bits make a 32-bit pair, else a 64-bit one.
        narrow = first + len(rules) + PASS_RULES < 1 << 16
        kind, half, bits = (np.uint32, 16, 32) if narrow else (np.uint64, 32, 64)
        mix, shift = kind(_MIX & (2**bits - 1) | 1), kind(bits - _SLOTS)
        symbols = symbols.astype(kind)
        inside = ~ends[:-1] if due is None else due[:-1] & ~ends[:-1]
        places = np.flatnonzero(inside)
        pairs = (symbols[:-1] << kind(half) | symbols[1:])[inside] if due is None else symbols[places] << kind(half) | symbols[places + 1]
        ordered = np.sort(pairs)
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.array([], int)
        uses = np.diff(np.append(starts, len(ordered)))
        often = np.flatnonzero(uses >= MIN_USES)
        left_over = len(often) > PASS_RULES
        often = often[np.argsort(-uses[often], kind="stable")][:PASS_RULES]
        if not len(often):
            break
        chosen = ordered[starts[often]]
        # Direct lookup by a mixed slot; of pairs that share a slot the most frequent is kept, the rest wait for the next pass.
        slot_of = chosen * mix >> shift
        slots, which = np.full(1 << _SLOTS, kind(2**bits - 1)), np.zeros(1 << _SLOTS, np.int32)
        slots[slot_of[::-1]] = chosen[::-1]
        which[slot_of[::-1]] = np.arange(len(chosen), dtype=np.int32)[::-1]
        slot = pairs * mix >> shift
        held = slots[slot]
        match = held == pairs
        hit, pair_of = places[match], which[slot[match]]
        if not len(hit):
            break
        run = np.concatenate([[True], np.diff(hit) != 1])
        since = np.arange(len(hit)) - np.flatnonzero(run)[np.cumsum(run) - 1]
        hit, pair_of = hit[since % 2 == 0], pair_of[since % 2 == 0]  # neighbouring hits overlap: every second one of a run
        taken = np.bincount(pair_of, minlength=len(chosen)) > 0
        used, number = np.flatnonzero(taken), (np.cumsum(taken) - 1).astype(kind)
        keep = np.ones(len(symbols), bool)
        keep[hit + 1] = False
        if left_over:
            due = None
        else:
            waiting = np.zeros(len(symbols), bool)
            waiting[places[(held != kind(2**bits - 1)) & ~match]] = True  # pairs of a slot that another had, and others in it
            due = waiting
        symbols[hit] = kind(first + len(rules)) + number[pair_of]
        ends[hit] = ends[hit + 1]
        if due is not None:
            due[hit] = True
            before = hit[hit > 0] - 1
            due[np.where(keep[before], before, before - 1)] = True  # the place before, which may be replaced itself
            due = due[keep]
        rules.extend((int(p) >> half, int(p) & (1 << half) - 1) for p in chosen[used])
        symbols, ends = symbols[keep], ends[keep]
    return symbols, ends, np.array(rules, "<u4").reshape(-1, 2)


def expansions(rules: np.ndarray, first: int) -> list[np.ndarray]:
    """The ids of each nonterminal; a rule names ids and earlier rules only."""
    known: list[np.ndarray] = []
    for pair in rules.tolist():
        known.append(np.concatenate([known[s - first] if s >= first else np.array([s], np.uint32) for s in pair]))
    return known


def expand(symbols: np.ndarray, known: list[np.ndarray], first: int) -> np.ndarray:
    """The ids of symbols, all at once: each symbol copies its run out of the table of expansions."""
    symbols = symbols.astype(np.int64)
    sizes = np.array([len(k) for k in known], np.int64)
    table = np.concatenate([*known, np.zeros(0, np.uint32)])
    begins = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    rule = np.where(symbols >= first, symbols - first, -1)
    lengths = np.where(rule >= 0, sizes[rule], 1) if len(known) else np.ones(len(symbols), np.int64)
    out = np.repeat(symbols, lengths)
    if len(known):
        origin = np.cumsum(lengths) - lengths
        inside = np.repeat(rule >= 0, lengths)
        source = np.repeat(np.where(rule >= 0, begins[rule], 0) - origin, lengths) + np.arange(len(out))
        out[inside] = table[source[inside]]
    return out.astype("<u4")


def file_bytes(doc_ids: list[int | None], ids: list[np.ndarray], first: int) -> bytes:
    sizes = np.array([len(x) for x in ids], np.int64)
    token_starts = np.concatenate([[0], np.cumsum(sizes)])
    tokens = np.concatenate([*ids, np.zeros(0, np.uint32)])
    ends = np.zeros(len(tokens), bool)
    ends[token_starts[1:] - 1] = True
    symbols, ends, rules = compress(tokens, ends, first)
    symbol_starts = np.concatenate([[0], np.flatnonzero(ends) + 1])
    width = 2 if first + len(rules) <= 1 << 16 else 4
    lengths = np.array([len(x) for x in expansions(rules, first)], "<u4")
    head = HEADER.pack(MAGIC, len(ids), len(tokens), len(symbols), len(rules), first, width, 0)
    parts = [
        np.array([d or 0 for d in doc_ids], "<i8"),
        np.array([d is None for d in doc_ids], "u1"),
        symbol_starts.astype("<u8"),
        token_starts.astype("<u8"),
        rules,
        lengths,
        symbols.astype(f"<u{width}"),
    ]
    return head + b"".join(p.tobytes() for p in parts)


class TokenFile:
    """A file in the shared folder; only what a call needs is read."""

    def __init__(self, uri: str):
        files, path = file_at(uri)
        self.file = files.open_input_file(path)
        magic, self.documents, self.tokens, self.symbols, self.rules, self.first, self.width, _ = HEADER.unpack(self.file.read(HEADER.size))
        if magic != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        sizes = [8 * self.documents, self.documents, 8 * (self.documents + 1), 8 * (self.documents + 1), 8 * self.rules, 4 * self.rules, self.width * self.symbols]
        self.at = np.concatenate([[0], np.cumsum(sizes)]) + HEADER.size
        self._known: list[np.ndarray] | None = None

    def _part(self, part: int, kind: str, start: int = 0, stop: int | None = None) -> np.ndarray:
        width = np.dtype(kind).itemsize
        begin = int(self.at[part]) + start * width
        end = int(self.at[part + 1]) if stop is None else int(self.at[part]) + stop * width
        self.file.seek(begin)
        return np.frombuffer(self.file.read(end - begin), kind)

    def known(self) -> list[np.ndarray]:
        if self._known is None:
            self._known = expansions(self._part(4, "<u4").reshape(-1, 2), self.first)
            if [len(k) for k in self._known] != self._part(5, "<u4").tolist():
                raise ValueError("expansion lengths and rules disagree")
        return self._known

    def doc_ids(self) -> list[int | None]:
        return [None if gone else d for d, gone in zip(self._part(0, "<i8").tolist(), self._part(1, "u1").tolist(), strict=True)]

    def token_starts(self) -> np.ndarray:
        return self._part(3, "<u8").astype(np.int64)

    def document(self, index: int) -> np.ndarray:
        """Ids of one document, from its symbols alone."""
        start, stop = self._part(2, "<u8", index, index + 2).tolist()
        return expand(self._part(6, f"<u{self.width}", start, stop), self.known(), self.first)

    def all(self) -> np.ndarray:
        return expand(self._part(6, f"<u{self.width}"), self.known(), self.first)


def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str) -> Iterator[pa.RecordBatch]:
    encoder, context = word_tokenizer(tokenizer), TaskContext.get()
    files, root = file_at(folder)
    files.create_dir(root, recursive=True)
    part, attempt, first = context.partitionId(), context.taskAttemptId(), encoder.library.get_vocab_size()
    doc_ids: list[int | None] = []
    ids: list[np.ndarray] = []
    held = number = 0

    def flush() -> pa.RecordBatch:
        nonlocal number, held
        name = f"part-{part:06d}-{number:05d}-{attempt}.repair"  # an attempt never overwrites another
        with files.open_output_stream(f"{root}/{name}") as out:
            out.write(file_bytes(doc_ids, ids, first))
        row = {"part": ([part], pa.int32()), "number": ([number], pa.int32()), "path": ([f"{folder}/{name}"], pa.string()), "n_docs": ([len(ids)], pa.int64()), "n_tokens": ([held], pa.int64())}
        number, held = number + 1, 0
        doc_ids.clear()
        ids.clear()
        return output(row)

    for batch in batches:
        tokens, at = encoder.encode(batch.column(1))
        for doc_id, start, end in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            doc_ids.append(doc_id)
            ids.append(np.append(tokens[start:end], tokens.dtype.type(END_ID)))
            held += len(ids[-1])
            if held >= FILE_TOKENS:
                yield flush()
    if ids:
        yield flush()


def write_token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the ids of whole texts, an end id after each, in ascending doc_id order; returns the list of files.

    part, number, path, n_docs, n_tokens and base, the tokens of all files before. A null or empty text has the end id
    only; null doc_ids come first; rows with the same doc_id are ordered by text; further columns are not read; an
    empty table gives no files. The list is written before it is used, so it names the files of finished attempts only.
    """
    folder = fresh_path(docs.sparkSession, "token-files")
    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first())
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    # Words that texts of a batch share are looked up once in it, so batches are twice as long as elsewhere.
    listed = stored_map(rows, partial(_write, folder=folder, tokenizer=tokenizer), "part int, number int, path string, n_docs long, n_tokens long", 2 * BATCH_ROWS, "token-file-list")
    # Files before in the same part, plus all earlier parts: one row a part in the second window.
    before = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    parts = listed.groupBy("part").agg(F.sum("n_tokens").alias("of_part"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("of_earlier", F.coalesce(F.sum("of_part").over(earlier), F.lit(0))).drop("of_part")
    listed = listed.withColumn("of_files", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    return listed.join(parts, "part").withColumn("base", F.col("of_files") + F.col("of_earlier")).drop("of_files", "of_earlier")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            file = TokenFile(path)
            starts, data = file.token_starts(), file.all().tobytes()
            cut = starts.tolist()
            ids = [data[4 * a : 4 * b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
            fields = {"doc_id": (file.doc_ids(), pa.int64()), "start": (starts[:-1] + base, pa.int64()), "n_tokens": (np.diff(starts), pa.int64()), "ids": (ids, pa.binary())}
            yield output(fields)


def read_token_files(listed: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of each document, read back from the files."""
    return arrow_map(dealt(listed.select("path", "base"), "path"), _read, "doc_id long, start long, n_tokens long, ids binary")


def op6_token_files(spark, sf_dir):
    import public_tokenizers

    listed = write_token_files(scan(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    rows = read_token_files(listed)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
