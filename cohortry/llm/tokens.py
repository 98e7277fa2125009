"""Token ids of whole texts with the vocabulary files of public tokenizers, cached by word.

Most words of a text have been seen before, so each worker keeps the ids of words. Texts are
cut only where the tokenizer's own splitting rule cannot look across; any text with
characters for which that is not certain goes to the tokenizer whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa

#: Words a cache holds before it starts anew, and the longest it takes; longer ones seldom come again.
CACHED_WORDS = 500_000
CACHED_LENGTH = 24

#: Latin-1 bytes of texts that may be cut: no control characters that some rules count as
#: white space, no letters outside the plain ranges, no zero byte (it marks the cuts).
_CUTTABLE = bytes(x for x in range(256) if x not in {0, *range(0x1C, 0x20), 0x85, 0xA0, 0xAA, 0xB5, 0xBA})

#: What the words' splitting rule sees in a Latin-1 byte: white space, a letter, a number (each by itself), any other mark.
_SPACE, _LETTER, _NUMBER, _MARK = range(4)
_KINDS = np.array(
    [
        _SPACE if x in b" \t\n\r\x0b\x0c" else _LETTER if chr(x).isalpha() else _NUMBER if chr(x).isnumeric() else _MARK
        for x in range(256)
    ],
    dtype=np.uint8,
)
#: Bytes of text that are cut into words at a time.
CUT_BYTES = 4 << 20

_BYTE_PARTS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+")

#: The same without white space other than spaces and line breaks; and two of those in a row.
_PLAIN = bytes(x for x in _CUTTABLE if x not in b"\t\r\x0b\x0c")
_DOUBLE = ("  ", "\n\n", " \n", "\n ")


@lru_cache(maxsize=2)
def _opened(path: str, changed: int, size: int) -> tuple:
    """Tokenizer, contents of a file and the words cached with it, kept by a worker as long as the file does not change."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        return Tokenizer.from_file(path), json.load(file), {}


class Encoder:
    """Encodes texts to arrays of ids, with an end id after each; one tokenizer per worker.

    ``path``: file of the tokenizer. ``end``: id appended to every document. The file's added
    tokens are found in texts as the library finds them; texts that hold one go to it whole.
    Files whose splitting rule is not one of the two known here are used without the cache.
    """

    def __init__(self, path: str, end: int | None = None):
        self.path, self.end, self._ready = path, end, False

    def __getstate__(self):
        return {"path": self.path, "end": self.end, "_ready": False}

    def _load(self) -> None:
        seen = os.stat(self.path)
        whole, spec, self._words = _opened(self.path, seen.st_mtime_ns, seen.st_size)
        splitter = spec.get("pre_tokenizer") or {}
        plain = splitter.get("type") == "ByteLevel" and splitter.get("use_regex") and not splitter.get("add_prefix_space")
        lowers = "Lowercase" in json.dumps(spec.get("normalizer"))
        drops = splitter.get("type") == "Sequence" and "Removed" in json.dumps(splitter)
        self._mode = "words" if drops and lowers else "bytes" if plain and not spec.get("normalizer") else "whole"
        self._tokenizer, self._model, self._shown = whole, whole.model, _byte_letters()
        self._lowers = lowers
        self._added = [t["content"].lower() if lowers else t["content"] for t in spec.get("added_tokens") or ()]
        self._chunks: dict[str, bytes] = {}
        self._parts: dict[str, bytes] = {}
        self._ready = True

    def _whole(self, text: str) -> bytes:
        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str) -> bytes:
        """Ids of what the splitting rule leaves in one piece."""
        found = self._parts.get(part)
        if found is None:
            found = array("I", [t.id for t in self._model.tokenize(part.translate(self._shown))]).tobytes()
            if len(part) <= CACHED_LENGTH:
                self._parts[part] = found
        return found

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a chunk not seen before."""
        if "'" in chunk:  # a rule of its own
            found = self._whole(chunk)
        else:
            found = b"".join(map(self._part, _BYTE_PARTS.findall(chunk)))
        if len(chunk) <= CACHED_LENGTH:
            self._chunks[chunk] = found
        return found

    def _word(self, raw: bytes) -> bytes:
        """Ids of a word not seen before, cut as the splitting rule cuts it."""
        word = raw.decode("latin-1")
        if "'" in word:  # a rule of its own
            found = self._whole(word)
        else:
            shown = word if raw.isalpha() else word.translate(self._shown)
            found = array("I", [t.id for t in self._model.tokenize(shown)]).tobytes()
        if len(raw) <= CACHED_LENGTH:
            self._words[raw] = found
        return found

    def _cut(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of lower-case Latin-1 texts: cut into words together, each different word looked up once."""
        joined = np.frombuffer(b"".join([t + b"\n" for t in texts]), dtype=np.uint8)
        kind = _KINDS[joined]
        ink = kind != _SPACE
        first = ink.copy()
        first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        quote = joined == ord("'")
        if quote.any():
            # What holds an apostrophe stays in one piece up to the white space around it.
            head = ink.copy()
            head[1:] &= ~ink[:-1]
            chunk = np.cumsum(head)
            whole = np.zeros(chunk[-1] + 1, dtype=bool)
            whole[chunk[quote]] = True
            first &= head | ~whole[chunk]
        begins = np.flatnonzero(first)
        # Without white space the words follow one another.
        before = np.cumsum(ink)
        offsets = np.append(before[begins] - 1, before[-1])
        buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(joined[ink])]
        coded = pa.Array.from_buffers(pa.large_binary(), len(begins), buffers).dictionary_encode()
        _, places, held = coded.dictionary.buffers()
        places = np.frombuffer(places, dtype=np.int64, count=len(coded.dictionary) + 1).tolist()
        held, make = held.to_pybytes() if held else b"", self._word
        words = [held[a:b] for a, b in pairwise(places)]
        found = list(map(self._words.get, words))
        found = [make(w) if f is None else f for w, f in zip(words, found, strict=True)]
        flat = np.frombuffer(b"".join(found), dtype=np.uint32)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        code = coded.indices.to_numpy()
        size = sizes[code]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[code] - ends[:-1], size) + np.arange(ends[-1])]
        stops = ends[np.searchsorted(begins, np.cumsum([len(t) + 1 for t in texts]))]
        return np.split(ids, stops[:-1])

    @staticmethod
    def _evenly_spaced(text: str) -> bool:
        """Whether white space is single and inside the text, so that a cut at it is a cut of the splitting rule."""
        return not (text[0] in " \n" or text[-1] in " \n" or any(pair in text for pair in _DOUBLE))

    def _plain(self, text: str) -> bytes | None:
        """The text in lower-case Latin-1, if it may be cut into words."""
        if self._mode != "words":
            return None
        seen = text.lower()
        if any(mark in seen for mark in self._added):
            return None
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return None if raw.translate(None, _CUTTABLE) else seen.encode("latin-1")

    def _one(self, text: str) -> bytes:
        """Ids of a text by its chunks where the byte-level rule allows that, else by the tokenizer."""
        seen = text.lower() if self._lowers else text
        if self._mode != "bytes" or any(mark in seen for mark in self._added):
            return self._whole(text)
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return self._whole(text)
        if not raw or raw.translate(None, _PLAIN) or not self._evenly_spaced(text):
            return self._whole(text)
        # A space belongs to the word after it; a line break stands alone.
        chunks = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        found = list(map(self._chunks.get, chunks))
        if None in found:
            make = self._chunk
            found = [make(c) if f is None else f for c, f in zip(chunks, found, strict=True)]
        return b"".join(found)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text (null: empty), the end id last."""
        if not self._ready:
            self._load()
        for cache in (self._words, self._chunks, self._parts):
            if len(cache) > CACHED_WORDS:
                cache.clear()
        out: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[tuple[int, bytes]] = []

        def cut() -> None:
            if held:
                for (i, _), ids in zip(held, self._cut([p for _, p in held]), strict=True):
                    out[i].append(ids)
                held.clear()

        size = 0
        for i, text in enumerate(texts):
            raw = self._plain(text or "")
            if raw is None:
                out[i].append(np.frombuffer(self._one(text or ""), dtype=np.uint32))
                continue
            for piece in _pieces(raw):
                if size + len(piece) > CUT_BYTES:
                    cut()
                    size = 0
                held.append((i, piece))
                size += len(piece)
        cut()
        last = [] if self.end is None else [np.array([self.end], dtype=np.uint32)]
        return [np.concatenate([*parts, *last]) if len(parts) + len(last) > 1 else parts[0] for parts in out]


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A text in pieces of up to ``CUT_BYTES``, cut at white space (longer where there is none)."""
    at = 0
    while len(raw) - at > CUT_BYTES:
        stop = max(raw.rfind(b" ", at + 1, at + CUT_BYTES), raw.rfind(b"\n", at + 1, at + CUT_BYTES))
        if stop < 0:
            break
        yield raw[at:stop]
        at = stop
    yield raw[at:]


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others, in order, for U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = {b: chr(b) for b in shown}
    letter |= {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in letter)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}
