"""SentencePiece encoding by Viterbi search over a double-array trie, and decoding.

The pieces and log scores come from a model file; the segmentation with the largest score
sum is chosen, among equal sums the one whose last piece is longest, and so on backwards.
The model file in use (``piece_bpe_32k.model``) is a BPE model, so its scores are merge order
and not log probabilities: the ids are neither those of a unigram model nor the library's own
encoding by that file. Characters no piece holds become byte pieces. Spaces are written as a marker, with one put
before a text. No piece goes on after a marker that follows another character, so texts
are searched word by word, and words seen before are remembered.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARK = "▁"
#: How much worse than the worst piece an unknown character is.
UNKNOWN_PENALTY = 10.0
#: Words remembered before starting anew, and the longest remembered.
CACHED_WORDS = 400_000
CACHED_LENGTH = 24

_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class DoubleArray:
    """A trie in two arrays: the child of node s by code c is t = base[s] + c if check[t] == s; ``value[s]`` is the entry ending at s or -1.

    Codes are numbers from 1 given to the characters in use, the most frequent first.
    """

    def __init__(self, entries: dict[str, int]):
        counts: dict[str, int] = {}
        for entry in entries:
            for c in entry:
                counts[c] = counts.get(c, 0) + 1
        self.codes = {c: i + 1 for i, c in enumerate(sorted(counts, key=lambda c: (-counts[c], c)))}
        size = 4 * (sum(map(len, entries)) + len(self.codes)) + 16
        base, check, value = (np.full(size, fill, dtype=np.int64) for fill in (0, -1, -1))
        used = np.zeros(size, dtype=bool)
        used[0] = True
        # Where the search for room starts, by number of children: behind the last place found for as many.
        room: dict[int, int] = {}
        level = [(0, sorted(entries), 0)]
        while level:
            following = []
            for node, names, depth in level:
                if names and len(names[0]) == depth:
                    value[node] = entries[names[0]]
                    names = names[1:]
                if not names:
                    continue
                children: dict[int, list[str]] = {}
                for name in names:
                    children.setdefault(self.codes[name[depth]], []).append(name)
                codes = np.array(sorted(children), dtype=np.int64)
                kind = min(len(codes), 16)
                at = room.get(kind, 1)
                while True:
                    if at + codes[-1] >= size:
                        base, check, value = (np.append(x, np.full(size, f)) for x, f in ((base, 0), (check, -1), (value, -1)))
                        used = np.append(used, np.zeros(size, dtype=bool))
                        size *= 2
                    if not used[at + codes].any():
                        break
                    at += 1
                room[kind] = at
                base[node] = at
                used[at + codes] = True
                check[at + codes] = node
                following += [(at + code, children[code], depth + 1) for code in codes.tolist()]
            level = following
        last = int(np.flatnonzero(used)[-1]) + len(self.codes) + 2
        self.base, self.check, self.value = base[:last].tolist(), check[:last].tolist(), value[:last].tolist()

    def prefixes(self, text: str, start: int) -> Iterator[tuple[int, int]]:
        """(end, entry) of every entry that starts at ``start``, shortest first."""
        node = 0
        for end in range(start, len(text)):
            code = self.codes.get(text[end])
            if code is None:
                return
            child = self.base[node] + code
            if self.check[child] != node:
                return
            node = child
            if self.value[node] >= 0:
                yield end + 1, self.value[node]


class PieceModel:
    """Pieces of a model file; ``encode`` and ``decode`` for one text."""

    def __init__(self, path: str):
        import sentencepiece

        file = sentencepiece.SentencePieceProcessor(model_file=path)
        n = file.get_piece_size()
        self.names = [file.id_to_piece(i) for i in range(n)]
        self.scores = [file.get_score(i) for i in range(n)]
        self.unknown = file.unk_id()
        self.byte_ids = {int(self.names[i][1:-1], 16): i for i in range(n) if file.is_byte(i)}
        special = {i for i in range(n) if file.is_byte(i) or file.is_control(i) or file.is_unknown(i) or file.is_unused(i)}
        self.plain = [i for i in range(n) if i not in special]
        self.control = special - set(self.byte_ids.values())
        if any(MARK in self.names[i].lstrip(MARK) for i in self.plain):
            raise ValueError("a piece goes on over a word's start")
        self.trie = DoubleArray({self.names[i]: i for i in self.plain})
        self.unknown_score = min((self.scores[i] for i in self.plain), default=0.0) - UNKNOWN_PENALTY
        #: Characters that stand side by side in some piece.
        self.pairs = {x[k : k + 2] for x in map(self.names.__getitem__, self.plain) for k in range(len(x) - 1)}
        self._known: dict[str, bytes] = {}
        self._parts: dict[str, bytes] = {}

    def __getstate__(self):
        return {**self.__dict__, "_known": {}, "_parts": {}}

    def segment(self, word: str) -> tuple[float, list[int]]:
        """Best score sum and its ids; -1 - code point stands for an unknown character."""
        n = len(word)
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        codes = [self.trie.codes.get(c, 0) for c in word]
        best, start_of, piece_of = [0.0] + [-np.inf] * n, [0] * (n + 1), [0] * (n + 1)
        for start in range(n):
            here, node, single = best[start], 0, False
            for end in range(start, n):
                code = codes[end]
                child = base[node] + code
                if not code or check[child] != node:
                    break
                node = child
                piece = value[node]
                if piece >= 0:
                    if end == start:
                        single = True
                    total = here + scores[piece]
                    if total > best[end + 1]:
                        best[end + 1], start_of[end + 1], piece_of[end + 1] = total, start, piece
            if not single:
                total = here + self.unknown_score
                if total > best[start + 1]:
                    best[start + 1], start_of[start + 1], piece_of[start + 1] = total, start, -1 - ord(word[start])
        found, at = [], n
        while at:
            found.append(piece_of[at])
            at = start_of[at]
        return best[n], found[::-1]

    def _ids(self, part: str) -> bytes:
        ids = array("I")
        for piece in self.segment(part)[1]:
            if piece >= 0:
                ids.append(piece)
            elif self.byte_ids:
                ids.extend(self.byte_ids[b] for b in chr(-1 - piece).encode("utf-8", "replace"))
            else:
                ids.append(self.unknown)
        return ids.tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a word not seen before, cut where no piece holds the two characters side by side."""
        out, start = [], 0
        for end in range(1, len(word) + 1):
            if end < len(word) and word[end - 1 : end + 1] in self.pairs:
                continue
            part = word[start:end]
            ids = self._parts.get(part)
            if ids is None:
                ids = self._ids(part)
                if len(part) <= CACHED_LENGTH:
                    self._parts[part] = ids
            out.append(ids)
            start = end
        found = b"".join(out)
        if len(word) <= CACHED_LENGTH:
            self._known[word] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text; null and empty ones have none."""
        if not text:
            return np.empty(0, dtype=np.uint32)
        words = _WORDS.findall(MARK + text.replace(" ", MARK))
        for cache in (self._known, self._parts):
            if len(cache) > CACHED_WORDS:
                cache.clear()
        found = list(map(self._known.get, words))
        if None in found:
            found = [self._known.get(w) or self._word(w) if f is None else f for w, f in zip(words, found, strict=True)]
        return np.frombuffer(b"".join(found), dtype=np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: markers become spaces, the first one goes, runs of byte pieces are UTF-8."""
        byte_of = {i: b for b, i in self.byte_ids.items()}
        raw = bytearray()
        for i in ids.tolist():
            if i in byte_of:
                raw.append(byte_of[i])
            elif i not in self.control:
                raw += self.names[i].encode()
        return raw.decode("utf-8", "replace").replace(MARK, " ")[1:]


def encode_documents(docs: DataFrame, model: PieceModel) -> DataFrame:
    """doc_id, n_pieces, n_bytes (byte pieces), ids_crc32, same (decoding gives the text back), ids (little-endian 32-bit).

    Null and empty texts have no pieces. A text that holds the marker itself comes back with
    spaces in its place, so ``same`` is judged after that change. Repeated rows are encoded
    each; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    byte_ids = np.array(sorted(model.byte_ids.values()), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_bytes = {i: bytes([b]) for b, i in model.byte_ids.items()}
        text_of = [as_bytes.get(i) or (b"" if i in model.control else x.encode()) for i, x in enumerate(model.names)]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [model.encode(t) for t in texts]
            raw = [x.astype("<u4").tobytes() for x in found]
            back = [b"".join(map(text_of.__getitem__, x.tolist())).decode("utf-8", "replace").replace(MARK, " ")[1:] for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([int(np.isin(x, byte_ids).sum()) for x in found], pa.int64()),
                    pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                    pa.array([(t or "").replace(MARK, " ") == b for t, b in zip(texts, back, strict=True)]),
                    pa.array(raw, pa.binary()),
                ],
                names=["doc_id", "n_pieces", "n_bytes", "ids_crc32", "same", "ids"],
            )

    schema = f"doc_id {kind}, n_pieces long, n_bytes long, ids_crc32 long, same boolean, ids binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, model: PieceModel) -> DataFrame:
    """doc_id and text of encoded documents."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.decode(np.frombuffer(x or b"", dtype="<u4")) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
