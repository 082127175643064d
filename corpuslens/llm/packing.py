"""Packing of documents into training sequences with lexical neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import arrow_map, scan
from corpuslens.llm.tokens import word_tokenizer

WINDOW, END_ID = 2048, 1
#: Documents and tokens of an index shard, and terms with which a seed asks: None, all that another document has too.
SHARD_DOCS, SHARD_TOKENS, QUERY_TERMS = 4096, 2_000_000, None
#: Terms that one document in so many holds are scored as dense rows; so many of them at most, the commonest.
DENSE_SHARE, DENSE_TERMS = 16, 768
K1, B = 1.2, 0.75
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Index:
    """BM25 inverted index of one shard's documents: postings of a term, and the weights of the terms in each."""

    def __init__(self, docs: list[np.ndarray]):
        sizes = np.array([len(d) for d in docs], np.int64)
        keys = np.repeat(np.arange(len(docs), dtype=np.uint64), sizes) << np.uint64(32) | np.concatenate(docs).astype(np.uint64)
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        often = np.diff(np.append(first, len(keys))).astype(np.float64)
        doc, term = (keys[first] >> np.uint64(32)).astype(np.int64), (keys[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        held = np.bincount(term)
        idf = np.log1p((len(docs) - held + 0.5) / (held + 0.5))
        weight = idf[term] * often * (K1 + 1) / (often + K1 * (1 - B + B * sizes[doc] / sizes.mean()))
        order = np.argsort(term, kind="stable")
        self.posting_docs, self.posting_weights = doc[order], weight[order]
        self.posting_at = np.concatenate([[0], np.cumsum(held)])
        # The terms with which each document asks: all that another document has too.
        shared = np.flatnonzero(held[term] > 1)
        self.asks = term[shared]
        self.asks_at = np.searchsorted(doc[shared], np.arange(len(docs) + 1))
        self.count = len(docs)
        common = np.argsort(-held, kind="stable")[:DENSE_TERMS]
        common = common[held[common] * DENSE_SHARE >= len(docs)]
        self.dense_row = np.full(len(held), -1)
        self.dense_row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), len(docs)))
        rows = self.dense_row[term]
        self.dense[rows[rows >= 0], doc[rows >= 0]] = weight[rows >= 0]

    def neighbours(self, seed: int, unused: np.ndarray) -> list[int]:
        """Unused documents that share a term with the seed, best first, ties in the shard's order."""
        asks = self.asks[self.asks_at[seed] : self.asks_at[seed + 1]]
        if not len(asks):
            return []
        rows = self.dense_row[asks]
        chosen = np.zeros(len(self.dense))
        chosen[rows[rows >= 0]] = 1
        rest = asks[rows < 0]
        begins, sizes = self.posting_at[rest], self.posting_at[rest + 1] - self.posting_at[rest]
        places = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        scores = chosen @ self.dense + np.bincount(self.posting_docs[places], self.posting_weights[places], self.count)
        found = np.flatnonzero((scores > 0) & unused)
        return found[np.argsort(-scores[found], kind="stable")].tolist()


class _Shard:
    """Documents of a shard with what is left of each, packed window by window."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.tokens: list[np.ndarray] = []
        self.starts: list[int] = []

    def add(self, doc_id: int | None, tokens: np.ndarray, start: int = 0) -> None:
        self.ids.append(doc_id)
        self.tokens.append(tokens)
        self.starts.append(start)

    def windows(self, last: bool) -> Iterator[list[tuple[int, int, int]]]:
        """Lists of (document, start, length) of at most WINDOW tokens.

        A document longer than a window is cut; what remains of each waits. A seed's window is filled with the rest of
        its best unused neighbours, then of the next unused documents; the one that does not fit is cut, and its rest
        is the next seed. Unless it is the last, a shard leaves its unfilled window to the next one.
        """
        left = np.array([len(t) for t in self.tokens], np.int64) - self.starts
        for i in np.flatnonzero(left >= WINDOW).tolist():
            while left[i] >= WINDOW:
                yield [(i, self.starts[i], WINDOW)]
                self.starts[i] += WINDOW
                left[i] -= WINDOW
        total, order, at, seed = int(left.sum()), np.flatnonzero(left), 0, -1
        if not total:
            return
        index = Index([t[s:] if s < len(t) else t[-1:] for t, s in zip(self.tokens, self.starts, strict=True)])
        while total >= WINDOW or (last and total):
            while seed < 0:
                seed, at = (int(order[at]) if left[order[at]] else -1), at + 1
            room, pieces, following = min(WINDOW, total), [], -1

            def take(i: int) -> None:
                nonlocal room, following
                n = min(room, int(left[i]))
                pieces.append((i, self.starts[i], n))
                self.starts[i] += n
                left[i] -= n
                room -= n
                following = i if left[i] else -1

            take(seed)
            if room:
                for i in index.neighbours(seed, left > 0):
                    take(i)
                    if not room:
                        break
            while room:
                if left[order[at]]:
                    take(int(order[at]))
                else:
                    at += 1
            total -= sum(n for _, _, n in pieces)
            seed = following
            yield pieces

    def rest(self) -> _Shard:
        other = _Shard()
        for doc_id, tokens, start in zip(self.ids, self.tokens, self.starts, strict=True):
            if start < len(tokens):
                other.add(doc_id, tokens, start)
        return other


def _powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A window that is not full, as sequences whose sizes are powers of two: they need no padding."""
    size = sum(n for _, _, n in pieces)
    if size == WINDOW:
        return [pieces]
    out, queue = [], list(reversed(pieces))
    for bit in reversed(range(size.bit_length())):
        room = size & 1 << bit
        if room:
            out.append([])
        while room:
            i, start, n = queue.pop()
            used = min(n, room)
            out[-1].append((i, start, used))
            if used < n:
                queue.append((i, start + used, n - used))
            room -= used
    return out


def _packed(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    encoder, number = word_tokenizer(tokenizer), TaskContext.get().partitionId() << 32
    shard, held = _Shard(), 0

    def rows(last: bool) -> pa.RecordBatch:
        nonlocal number
        fields: list[list] = [[] for _ in range(7)]
        for window in shard.windows(last):
            for pieces in _powers(window):
                offset = 0
                for i, start, n in pieces:
                    tokens = shard.tokens[i]
                    for field, value in zip(fields, (shard.ids[i], start, n, tokens[start : start + n].astype("<u4").tobytes(), len(tokens), number, offset), strict=True):
                        field.append(value)
                    offset += n
                number += 1
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(f, k) for f, k in zip(fields, kinds, strict=True)], names=names)

    for batch in batches:
        tokens, at = encoder.encode(batch.column(1))
        for doc_id, start, end in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            shard.add(doc_id, np.append(tokens[start:end], tokens.dtype.type(END_ID)))
            held += end - start + 1
            if held >= SHARD_TOKENS or len(shard.ids) >= SHARD_DOCS:
                yield rows(last=False)
                shard = shard.rest()
                held = sum(len(t) - s for t, s in zip(shard.tokens, shard.starts, strict=True))
    if shard.ids:
        yield rows(last=True)


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset of every piece.

    Whole texts are encoded, an end id after each, and cut into pieces of sequences of 2048 tokens; each token is in
    one piece. The index is built by shards of neighbouring rows, inside the task that reads them: nothing is
    exchanged, and what does not fill a window goes on to the task's next shard. Only the last window of a task is not
    full; it becomes sequences whose sizes are powers of two. Retried tasks give the same sequence_ids.

    A null or empty text is its end id; null doc_ids and repeated rows are packed like any other; an empty table gives
    no rows; further columns are not read.
    """
    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), partial(_packed, tokenizer=tokenizer), PIECES)


def op8_packing(spark, sf_dir):
    import public_tokenizers

    rows = pack(scan(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
