"""Token ids of whole texts by a file of the tokenizers library, with a bounded memory of words already encoded."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words remembered in one Python worker, in two halves: a full new half becomes the old one, whose words are forgotten
#: unless they occur again.
MEMORY_WORDS = 1_200_000
#: Words sent to the library in one call.
CALL_WORDS = 128
#: Characters that may stand between words in a call; one is chosen that the vocabulary encodes as a single id.
SEPARATORS = "§¶•¤†‡"


#: Words whose case the vocabulary's normaliser treats letter by letter, and whose last marks its splitter cuts off.
_PLAIN = re.compile(r"([0-9A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-/:-@\[-`{-~]*)")


class WordTokenizer:
    """encode() gives, for each text, the same ids as the library, as unsigned 16- or 32-bit numbers.

    By default the names of added tokens are ordinary text; with added=True a text that holds one goes whole to the
    library's default call.

    The library's normaliser and splitter treat every run between plain spaces alone, so a text's ids are the ids of
    those runs in a row. Each distinct run goes to the library once, many in a call, with a separator between them that
    none of them holds.
    """

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their names in a text are ordinary text
        self.default, self.added = Tokenizer.from_file(path), []
        if added:
            tokens = self.default.get_added_tokens_decoder().values()
            if any(t.normalized for t in tokens):
                raise ValueError("added tokens that match normalised text are not supported")
            self.added = [t.content for t in tokens]
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.known: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        for mark in SEPARATORS:
            ids = self.library.encode(f"a {mark} b", add_special_tokens=False).ids
            if len(ids) == 3 and ids == [*self._ids("a"), *self._ids(mark), *self._ids("b")]:
                self.mark, self.mark_id = mark, ids[1]
                break
        else:
            raise ValueError("the vocabulary has no separator of one id")

    def _ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _learn(self, words: list[str]) -> None:
        """Sends what is new to the library: plain words in lower case and without their last marks.

        Words of a to z pass the normaliser and the splitter as they are, so they go to the merges at once.
        """
        merges, code, known = self.library.model.tokenize, self.code, self.known
        others = []
        for word in words:
            if word.isascii() and word.islower() and word.isalpha():
                known[word] = array(code, [t.id for t in merges(word)]).tobytes()
            else:
                others.append(word)
        plain: dict[str, tuple[str, str]] = {}
        rest = []
        for word in others:
            match = _PLAIN.fullmatch(word)
            if match:
                plain[word] = match[1].lower(), match[2]
            else:
                rest.append(word)
        due = {part for pair in plain.values() for part in pair}
        due.update(w for w in rest if self.mark not in w)
        found = {w: known[w] for w in due & known.keys()}
        asked = []
        for word in due - known.keys():
            if word.isascii() and word.isalpha():
                found[word] = array(code, [t.id for t in merges(word)]).tobytes()
            else:
                asked.append(word)
        found.update(self._call(asked))
        known.update((w, found[stem] + found[end]) for w, (stem, end) in plain.items())
        known.update((w, found[w] if self.mark not in w else self._bytes(w)) for w in rest)

    def _bytes(self, word: str) -> bytes:
        return np.array(self._ids(word), self.dtype).tobytes()

    def _call(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that do not hold the separator, many in a call."""
        calls = [words[i : i + CALL_WORDS] for i in range(0, len(words), CALL_WORDS)]
        found = {}
        width = self.dtype.itemsize
        for call, encoding in zip(calls, self.library.encode_batch_fast([f" {self.mark} ".join(c) for c in calls], add_special_tokens=False), strict=True):
            ids = np.array(encoding.ids, self.dtype)
            ends = [*(np.flatnonzero(ids == self.mark_id) * width).tolist(), len(ids) * width]
            data, start = ids.tobytes(), 0
            if len(ends) != len(call):
                raise ValueError("separators were lost in encoding")
            for word, end in zip(call, ends, strict=True):
                found[word] = data[start:end]
                start = end + width
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column in a row, and where each text begins (and the last one ends)."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        named = np.zeros(len(texts), bool)
        for name in self.added:
            named |= pc.match_substring(texts, name).to_numpy(zero_copy_only=False)
        if not named.any():
            return self._encode(texts)
        ids, at = self._encode(pc.if_else(pa.array(named), "", texts))
        rows, sizes, parts, done = np.flatnonzero(named), np.diff(at), [], 0
        for row, text in zip(rows.tolist(), texts.filter(pa.array(named)).to_pylist(), strict=True):
            found = np.array(self.default.encode(text).ids, self.dtype)
            parts += [ids[done : at[row]], found]
            done, sizes[row] = at[row], len(found)
        return np.concatenate([*parts, ids[done:]]), np.concatenate([[0], np.cumsum(sizes)])

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ascii_only = pc.equal(pc.binary_length(texts), pc.cast(pc.utf8_length(texts), pa.int64()))
        texts = pc.replace_substring(pc.if_else(ascii_only, pc.ascii_lower(texts), texts), "\n", " ")
        split = pc.split_pattern(texts, " ")
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > MEMORY_WORDS // 2:
            self.known, self.old = {"": b""}, self.known
        fresh = [w for w in distinct if w not in self.known]
        again = [w for w in fresh if w in self.old]
        self.known.update((w, self.old[w]) for w in again)
        self._learn([w for w in fresh if w not in self.known] if again else fresh)
        parts = [self.known[w] for w in distinct]
        table = np.frombuffer(b"".join(parts), self.dtype)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // self.dtype.itemsize
        begins = np.cumsum(sizes) - sizes
        which = words.indices.to_numpy(zero_copy_only=False)
        lengths = sizes[which]
        ends = np.cumsum(lengths)
        kind = np.int32 if max(len(table), ends[-1] if len(ends) else 0) < 1 << 31 else np.int64
        source = np.repeat((begins[which] - (ends - lengths)).astype(kind), lengths)
        source += np.arange(len(source), dtype=kind)
        at = np.concatenate([[0], ends])[np.asarray(split.offsets) - split.offsets[0].as_py()]
        return table[source], at


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """The ids of the library's default call."""
    return WordTokenizer(path, added=True)
