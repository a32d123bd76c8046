"""Exact and fast encoding with tokenizers whose pre-tokenizer drops white space.

The texts are cut at blanks and line feeds, which such a tokenizer never puts
into a token, so the ids of a text are the ids of its chunks in order. Chunks
recur: each distinct chunk is encoded once by the library and then looked up.
Chunks of lower-case Latin-1 letters alone, which the normalizer and the
pre-tokenizer leave as they are, go to the library's model directly.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_cache

#: Distinct chunks of a generation; a worker remembers two, and drops those that weren't met in the last one.
CACHE_CHUNKS = 200_000
#: Bytes of texts that are cut and looked up at once, unless one text alone has more.
SLICE_BYTES = 3 << 20
#: Signs that the pre-tokenizer keeps together and apart from letters and digits.
SIGNS = ".,;:!?%&*#$|"
#: A text that is always one token of its own between blanks, and how many chunks are encoded between such marks at once.
MARK, JOINED = "0", 2000
#: Longer chunks are encoded each time and not remembered.
CACHE_CHARS = 64


#: Letters that need no normalizer.
_LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch
#: Bytes that the byte-level alphabet doesn't write as themselves but, in order, as the signs from 256 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
#: Those letters as that alphabet writes them.
_BYTE_SIGNS = {c: "".join(chr(256 + _HIDDEN.index(b) if b in _HIDDEN else b) for b in chr(c).encode()) for c in range(0xDF, 0x100)}
#: Words on which both ways must agree, or all goes through the whole library.
_PROBES = ["the", "\u00fcber", "stra\u00dfe", "a" * 40, *(f"x{chr(c)}y" for c in range(0xDF, 0x100) if c != 0xF7)]

#: Full stops and commas that end a word, in Latin-1 lower case.
_ENDS = re.compile("(?<=[a-z0-9\u00df-\u00f6\u00f8-\u00ff])([.,]+)(?=[ \n])")

#: A full stop or comma after something else than a letter, a digit or white space.
_IN_RUN = re.compile("[^a-z0-9\u00df-\u00f6\u00f8-\u00ff \t\n\r\x0b\x0c\x85\xa0][.,]")


def _spaced(text: str | None) -> str:
    """The text with blanks where it is cut into chunks.

    Texts within Latin-1 are lower-cased first, as the tokenizer does, and get
    blanks before signs that end words, where it cuts too, so that fewer chunks
    are distinct. Texts that may hold a special token are left as they are.
    """
    if text is None:
        return ""
    if "<|" not in text:
        try:
            text.encode("latin-1")
            text = text.lower()
            if _IN_RUN.search(text):
                text = _ENDS.sub(r" \1", text)
            else:  # no run of signs can be cut
                text = text.replace(". ", " . ").replace(", ", " , ").replace(".\n", " .\n").replace(",\n", " ,\n")
        except UnicodeEncodeError:
            pass
    return text.replace("\n", " ")


def _stem(chunk: str) -> str:
    """The chunk without the signs that end it, where the tokenizer cuts before them; ASCII ones lower-cased."""
    stem = chunk.rstrip(SIGNS)
    if stem and not (stem if stem.isascii() else stem.lower())[-1].isalnum():
        return chunk  # the signs may belong to a longer run: of signs, or of marks that lower-casing splits off
    return stem.lower() if stem.isascii() and "<|" not in stem else stem


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) + 1, dtype=np.int64)
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.model = self.tokenizer.model
        self.direct = all(self._letter_ids(p) == self._ids(p).tobytes() for p in _PROBES)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _letter_ids(self, word: str) -> bytes:
        """Ids of a word of ``_LETTERS``, by the model alone."""
        return array("I", [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(_BYTE_SIGNS))]).tobytes()

    def _encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk. Many are encoded in one text, between marks that no chunk contains."""
        out: list[bytes] = []
        parts = [chunks[at : at + JOINED] for at in range(0, len(chunks), JOINED)]
        got = self.tokenizer.encode_batch_fast([f" {MARK} ".join(p) for p in parts], add_special_tokens=False)
        for part, one in zip(parts, got, strict=True):
            ids = np.array(one.ids, "<u4")
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) != len(part) - 1:
                out += [self._ids(c).tobytes() for c in part]
                continue
            raw, edges = ids.tobytes(), [-1, *ends.tolist(), len(ids)]
            out += [raw[4 * (a + 1) : 4 * b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return out

    def _remembered(self, chunks: list[str]) -> list[bytes | None]:
        """Ids of the chunks that are remembered; those of the older generation move to the new one."""
        found = list(map(self.known.get, chunks))
        older = self.older
        if older:
            for k, ids in enumerate(found):
                if ids is None and (ids := older.get(chunks[k])) is not None:
                    found[k] = self.known[chunks[k]] = ids
        return found

    def _look_up(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks. New ones are encoded by their stems and the signs that end them, and remembered."""
        if len(self.known) > CACHE_CHUNKS:
            self.older, self.known = self.known, {"": b""}
        found, known = self._remembered(chunks), self.known
        alone, cut = [], []
        for k in [k for k, ids in enumerate(found) if ids is None]:
            c = chunks[k]
            if len(c) > CACHE_CHARS:
                alone.append(k)
            elif self.direct and _LETTERS(c):
                known[c] = found[k] = self._letter_ids(c)
            elif MARK in c or self.mark is None:
                alone.append(k)
            else:
                stem = _stem(c)
                cut.append((k, stem, c[len(stem) :]))
        parts = list({x for _, *pair in cut for x in pair})
        ids_of = dict(zip(parts, self._remembered(parts), strict=True))
        new = []
        for p in [p for p, ids in ids_of.items() if ids is None]:
            if self.direct and _LETTERS(p):
                known[p] = ids_of[p] = self._letter_ids(p)
            else:
                new.append(p)
        made = dict(zip(new, self._encode_chunks(new), strict=True))
        ids_of |= made
        known |= made
        for k, stem, signs in cut:
            found[k] = known[chunks[k]] = ids_of[stem] + ids_of[signs]
        for k in alone:
            found[k] = self._ids(chunks[k]).tobytes()
        return found

    def encode_flat(self, texts: Sequence[str | None], end: Sequence[int] = ()) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, each followed by ``end``; where each text begins, and their number). A null text has none of its own."""
        words = pc.split_pattern(pa.array([_spaced(t) for t in texts], pa.string()), " ")
        coded = words.values.dictionary_encode()
        parts = [*self._look_up(coded.dictionary.to_pylist()), np.array(end, "<u4").tobytes()]
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.append(0, size)).astype(np.int32)), pa.array(np.frombuffer(b"".join(parts), "<u4")))
        at = words.offsets.to_numpy()
        index = np.insert(coded.indices.to_numpy(), at[1:], len(parts) - 1)
        taken = lists.take(pa.array(index))
        starts = taken.offsets.to_numpy().astype(np.int64)
        return taken.values.to_numpy()[starts[0] : starts[-1]], (starts - starts[0])[at + np.arange(len(at))]

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text as bytes; a null text has none."""
        ids, at = self.encode_flat(texts)
        return [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for the vocabulary file at ``path``."""
    return worker_cache(f"encoder {path}", lambda: WordEncoder(path))


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
