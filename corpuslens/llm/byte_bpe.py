"""Byte-level BPE: encoding by backtracking over dictionary matches, and decoding."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache, partial
from itertools import batched, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import arrow_map, scan

#: Pieces and token pairs remembered in one Python worker.
MEMORY_PIECES, MEMORY_PAIRS = 400_000, 600_000
#: Pieces of a text that are held at once.
BLOCK_PIECES = 200_000
LONG_TEXT = 1_000_000
#: Ids whose bytes are gathered at once.
DECODED_IDS = 500_000


class ByteBpe:
    """Ids of a rank file, as merging by rank gives them.

    A sequence of tokens is what merging gives exactly if each token and each pair of neighbours is. So a piece is covered from the left with the longest dictionary match at
    each place; a match that does not go with its left neighbour gives way to the next shorter one, and a place from
    which nothing goes on is marked and never tried again. Every place is left at most once for each match, so the
    work is linear in the piece. Whether two tokens go together is remembered.
    """

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.width = {i: len(t) for t, i in self.ranks.items()}
        self.matcher = ahocorasick.Automaton()
        for token, i in self.ranks.items():
            self.matcher.add_word(token.decode("latin-1"), (len(token), i))
        self.matcher.make_automaton()
        self.pattern = regex.compile(pattern)
        self.widths = np.zeros(max(self.tokens) + 1, np.int64)
        self.widths[list(self.width)] = list(self.width.values())
        self.begins = np.cumsum(self.widths) - self.widths
        self.table = np.frombuffer(b"".join(self.tokens[i] for i in sorted(self.tokens)), np.uint8)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.shorter_of: dict[int, int] = {}
        self.halves_of: dict[int, tuple[int, int] | None] = {}
        self.pieces = _Pieces(self.encode_piece)

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives this one; None for a single byte; (-1, -1) if merging never gives it."""
        known = self.halves_of.get(token, 0)
        if known == 0:
            data = self.tokens[token]
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(a + b, token), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if rank >= token:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            known = None if len(parts) == 1 else (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (-1, -1)
            self.halves_of[token] = known
        return known

    def goes(self, left: int, right: int) -> bool:
        """Whether merging keeps these neighbours; left is -1 at the start of a piece.

        The two are taken apart again, the later merge first. At each step the parts that touch must not have a merge
        that was due before the one just undone; of equal merges the left one is due first.
        """
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= MEMORY_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.halves(right) != (-1, -1) and (left < 0 or self._touch(left, right))
        return known

    def _touch(self, left: int, right: int) -> bool:
        due = len(self.ranks)
        while True:
            if self.ranks.get(self.tokens[left] + self.tokens[right], due) < due:
                return False
            a, b = self.halves(left), self.halves(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                due, left = left, a[1]
            else:
                due, right = right + 1, b[0]

    def shorter(self, token: int) -> int:
        """The longest token that is a proper prefix, or -1."""
        known = self.shorter_of.get(token)
        if known is None:
            data = self.tokens[token]
            known = next((self.ranks[data[:n]] for n in range(len(data) - 1, 0, -1) if data[:n] in self.ranks), -1)
            self.shorter_of[token] = known
        return known

    def covered(self, piece: bytes) -> list[int]:
        """Longest matches one after another if all neighbours go together, which is then the answer; else backtracking."""
        text, pairs, goes, ids, left, at = piece.decode("latin-1"), self.pairs, self.goes, [], -1, -1
        for end, (length, token) in self.matcher.iter_long(text):
            good = pairs.get((left, token))
            if end - length != at or not (goes(left, token) if good is None else good):
                return self.backtracked(text)
            ids.append(token)
            left, at = token, end
        return ids if at == len(text) - 1 else self.backtracked(text)

    def backtracked(self, text: str) -> list[int]:
        size = len(text)
        longest = [-1] * size
        for end, (length, token) in self.matcher.iter(text):
            longest[end - length + 1] = token  # ends ascend, so the longest match from a place comes last
        lost, ids, at, token, left = bytearray(size + 1), [], 0, longest[0], -1
        width, pairs, goes = self.width, self.pairs, self.goes
        while at < size:
            while token >= 0:
                good = pairs.get((left, token))
                if (goes(left, token) if good is None else good) and not lost[at + width[token]]:
                    break
                token = self.shorter(token)
            if token >= 0:
                ids.append(token)
                at += width[token]
                left, token = token, longest[at] if at < size else -1
            else:
                lost[at] = 1
                last = ids.pop()
                at -= width[last]
                left, token = ids[-1] if ids else -1, self.shorter(last)
        return ids

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        whole = self.ranks.get(data)
        return (whole,) if whole is not None else tuple(self.covered(data))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, taken in blocks of pieces if it is long."""
        if len(text) <= LONG_TEXT:
            return self._ids(self.pattern.findall(text))
        blocks = batched((m.group() for m in self.pattern.finditer(text)), BLOCK_PIECES)
        return np.concatenate([self._ids(block) for block in blocks])

    def _ids(self, pieces: Sequence[str]) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.pieces.__getitem__, pieces)), np.int32)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids in a row, and where each id's bytes end; every id copies its run out of one table."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.widths) and self.widths[ids].all()):
            raise KeyError("an id is not in the vocabulary")
        parts, ends = [np.zeros(0, np.uint8)], np.cumsum(self.widths[ids]) if len(ids) else np.zeros(0, np.int64)
        for block in np.split(ids, range(DECODED_IDS, len(ids), DECODED_IDS)):
            lengths = self.widths[block]
            source = np.repeat(self.begins[block] - (np.cumsum(lengths) - lengths), lengths)
            source += np.arange(len(source))
            parts.append(self.table[source])
        return np.concatenate(parts), ends


class _Pieces(dict):
    """Pieces already encoded, in two halves: when the new one is full it becomes the old one, from which pieces that
    occur again come back."""

    def __init__(self, encode: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self.encode = encode
        self.old: dict[str, tuple[int, ...]] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        found = self.old.get(piece) or self.encode(piece)
        if len(piece) <= 64:
            if len(self) >= MEMORY_PIECES // 2:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def _encode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = byte_bpe(path, pattern)
    for batch in batches:
        ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
        at = np.cumsum([0, *map(len, ids)], dtype=np.int32)
        column = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))
        yield pa.RecordBatch.from_arrays([batch.column(0), column], names=["doc_id", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = byte_bpe(path, pattern)
    for batch in batches:
        ids = batch.column(1)
        sizes = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        data, ends = bpe.bytes_of(ids.flatten().to_numpy(zero_copy_only=False))
        at = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        decoded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([batch.column(0), ids, decoded.cast(pa.binary())], names=["doc_id", "ids", "decoded"])


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array<int>) of each row's whole text.

    A null or empty text has no ids; a null doc_id, repeated rows and further columns change nothing (further columns
    are not read); an empty table gives no rows. Rows stay where they are read: there is no exchange.
    """
    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), partial(_encode, path=path, pattern=pattern), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and decoded (the bytes of the ids; null or empty ids: no bytes). An id outside the vocabulary is an error."""
    return arrow_map(encoded.select("doc_id", "ids"), partial(_decode, path=path, pattern=pattern), "doc_id long, ids array<int>, decoded binary")


def op5_byte_bpe(spark, sf_dir):
    import public_tokenizers

    at = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    rows = decode_documents(encode_documents(scan(spark, sf_dir, "documents", "doc_id", "text"), *at), *at)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
