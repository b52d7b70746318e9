"""SentencePiece encoding and decoding over a relational lattice of words.

A text is cut into words (blanks become a mark that leads the next word; no piece crosses that cut). For the distinct
words of a batch, all substrings up to the longest piece are exploded, equi-joined to the piece table by hash, and
grouped as edges by word and end; a fold over the ends keeps, for each, the piece that the best path ends with.

Two kinds of path: in a unigram model the best path has the highest sum of scores (Viterbi). A byte-pair model has no
such sum; there a sequence of pieces is the model's own encoding exactly if every two neighbours, encoded together,
stay as they are, so the fold keeps the one edge whose piece may follow the piece kept at its start. Characters
without a piece become byte pieces.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hingeworks.llm.common import coded_words, steps, text_batches

MARK = "▁"
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Words and pairs that a worker remembers at most; beyond that it starts anew.
CACHE_WORDS, CACHE_PAIRS = 600_000, 1_000_000
#: Characters in one lattice at most (one longer word is a lattice of its own).
LATTICE_CHARS = 400_000
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Pieces:
    """A piece table and its codec. kind is bpe or unigram; pieces are (text, score) by id, bytes maps a byte to its id."""

    def __init__(self, pieces: dict[str, tuple[int, float]], bytes_: dict[int, int], kind: str, unknown: int = 0, texts: dict[int, bytes] | None = None):
        self.pieces, self.bytes, self.kind, self.unknown = pieces, bytes_, kind, unknown
        self.longest = max(map(len, pieces), default=1)
        by_id = {i: t.replace(MARK, " ").encode() for t, (i, _) in pieces.items()} | {i: bytes([b]) for b, i in bytes_.items()} | (texts or {})
        self.out = [by_id.get(i, b"") for i in range(max(by_id, default=0) + 1)]
        self.score = np.zeros(len(self.out) + 1)
        self.text: list[str] = [""] * len(self.out)
        for t, (i, s) in pieces.items():
            self.score[i], self.text[i] = s, t
        self.score[-1] = min(self.score.min(), 0.0) - 10.0  # a character without a piece
        self.width, self.type = (2, "<u2") if len(self.out) < 1 << 16 else (4, "<u4")
        hashes = self._hash_all(list(pieces))
        order = np.argsort(hashes)
        self.hashes, self.hash_ids = hashes[order], np.array([i for i, _ in pieces.values()], dtype=np.int64)[order]
        if len(np.unique(self.hashes)) < len(self.hashes):
            raise ValueError("two pieces share a hash")
        self.seen = np.zeros(1 << 22, dtype=bool)
        self.seen[(self.hashes >> np.uint64(42)).astype(np.int64)] = True
        self.words: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    @classmethod
    def from_model(cls, path: str, kind: str | None = None) -> Pieces:
        """A model of the library. Its kind shows in the scores: byte-pair models number their merges.

        Models that change texts before they cut them (other than blanks) or join blanks are refused.
        """
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if (changed := sp.normalize("Ａﬁ e\u0301  x")) != f"{MARK}Ａﬁ{MARK}e\u0301{MARK}{MARK}x":
            raise ValueError(f"{path} changes texts before it cuts them: {changed!r}")
        ids = range(sp.get_piece_size())
        bytes_ = {int(sp.id_to_piece(i)[1:-1], 16): i for i in ids if sp.is_byte(i)}
        pieces = {sp.id_to_piece(i): (i, sp.get_score(i)) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        whole = all(s == round(s) for _, s in pieces.values())
        return cls(pieces, bytes_, kind or ("bpe" if whole else "unigram"), sp.unk_id())

    @staticmethod
    def _codes(texts: list[str]) -> np.ndarray:
        return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)

    @staticmethod
    def _mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    def _prefix(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(code)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((code + np.uint64(1)) * _powers(BASE, n), out=sums[1:])
        return sums, _powers(BASE_INVERSE, n)

    def _hash_all(self, texts: list[str]) -> np.ndarray:
        sums, inverse = self._prefix(self._codes(texts))
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        starts = ends - [len(t) for t in texts]
        return self._mixed((sums[ends] - sums[starts]) * inverse[starts])

    def _edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all substrings that are pieces, and every character's place in its word.

        A single character without a piece is an edge of piece -1, so every place can be reached.
        """
        code = self._codes(words)
        sums, inverse = self._prefix(code)
        size = np.array([len(w) for w in words], dtype=np.int64)
        place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
        found = []
        for length in range(1, min(self.longest, int(size.max(initial=0))) + 1):
            start = np.flatnonzero(place[length - 1 :] >= length - 1)
            h = self._mixed((sums[start + length] - sums[start]) * inverse[start])
            if length > 1:
                maybe = self.seen[(h >> np.uint64(42)).astype(np.int64)]
                start, h = start[maybe], h[maybe]
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[at] == h
            piece = np.where(hit, self.hash_ids[at], -1)
            if length > 1:
                start, piece = start[hit], piece[hit]
            found.append((start, start + length, piece))
        start, end, piece = (np.concatenate(x) for x in zip(*found))
        return start, end, piece, place

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each (non-empty) word by its best path through the lattice."""
        start, end, piece, place = self._edges(words)
        order = np.lexsort((start, end, place[end - 1]))  # by step, word and end; the longest piece first
        start, end, piece = start[order], end[order], piece[order]
        cuts = np.flatnonzero(np.diff(place[end - 1], prepend=-1, append=-1))
        kept, back = np.full(len(place), -2), np.zeros(len(place), dtype=np.int64)
        total = np.zeros(len(place))
        for a, b in zip(cuts, cuts[1:]):
            s, e, p = start[a:b], end[a:b], piece[a:b]
            opens = place[s] == 0
            if self.kind == "bpe":
                good = np.flatnonzero(self._may_follow(np.where(opens, -1, kept[s - 1]), p))
            else:
                sums = np.where(opens, 0.0, total[s - 1]) + self.score[p]
                good = np.lexsort((np.arange(b - a), -sums, e))
            at, first = np.unique(e[good], return_index=True)
            best = good[first]
            kept[at - 1], back[at - 1] = p[best], s[best]
            if self.kind != "bpe":
                total[at - 1] = sums[best]
        return self._paths(words, kept, back)

    def _paths(self, words: list[str], kept: np.ndarray, back: np.ndarray) -> list[bytes]:
        """Follow all words' best paths from their ends, a piece each at a time."""
        end = np.cumsum([len(w) for w in words], dtype=np.int64)
        begin = end - [len(w) for w in words]
        word, at, seen = np.arange(len(words)), end, []
        while len(word):
            seen.append((word, kept[at - 1]))
            at = back[at - 1]
            on = at > begin[word]
            word, at = word[on], at[on]
        word, piece = (np.concatenate(x[::-1]) for x in zip(*seen))
        order = np.argsort(word, kind="stable")
        word, piece = word[order], piece[order]
        flat, cut = piece.astype(self.type).tobytes(), np.searchsorted(word, np.arange(len(words) + 1)) * self.width
        out = [flat[a:b] for a, b in zip(cut.tolist(), cut[1:].tolist())]
        for i in np.unique(word[piece < 0]).tolist():
            out[i] = self._path(words[i], int(end[i]), kept, back)
        return out

    def _path(self, word: str, end: int, kept: np.ndarray, back: np.ndarray) -> bytes:
        begin, at, ids = end - len(word), end, []
        while at > begin:
            p, s = int(kept[at - 1]), int(back[at - 1])
            if p >= 0:
                ids.append(p)
            else:
                ids.extend(reversed(self._spelled(word[s - begin : at - begin])))
            at = s
        return np.array(ids[::-1], dtype=self.type).tobytes()

    def _spelled(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def _may_follow(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether two pieces, encoded together, stay as they are; the start and characters without a piece never merge."""
        both = (before >= 0) & (piece >= 0)
        key, place = np.unique((before[both] << 32) | piece[both], return_inverse=True)
        if len(self.pairs) > CACHE_PAIRS:
            self.pairs.clear()
        known = self.pairs
        for k in key.tolist():
            if k not in known:
                known[k] = self.merged(self.text[k >> 32] + self.text[k & 0xFFFFFFFF]) == [k >> 32, k & 0xFFFFFFFF]
        out = np.ones(len(piece), dtype=bool)
        out[both] = np.array([known[k] for k in key.tolist()], dtype=bool)[place] if len(key) else True
        return out

    def merged(self, word: str) -> list[int]:
        """Byte-pair encoding by definition: merge the best-scored pair, leftmost on ties, until none is a piece."""
        parts: list[str] = list(word)
        left, right = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        queue: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (hit := self.pieces.get(parts[i] + parts[j])):
                heapq.heappush(queue, (-hit[1], i, j, parts[i] + parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            _, i, j, text = heapq.heappop(queue)
            if not parts[i] or not parts[j] or parts[i] + parts[j] != text or right[i] != j:
                continue
            parts[i], parts[j] = text, ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [x for t in parts if t for x in ([self.pieces[t][0]] if t in self.pieces else self._spelled(t))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, little-endian, `width` bytes each; an empty text has none.

        Texts with single blanks between words only have their words told apart in Arrow, and the cache is asked once
        for each distinct one; others are cut by a pattern.
        """
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        odd = [not t or "  " in t or MARK in t or t[0] == " " or t[-1] == " " for t in texts]
        plain = pa.array([t for t, o in zip(texts, odd) if not o], pa.string())
        keys, joined = coded_words(pc.split_pattern(plain, " "))
        cut = [WORDS.findall(MARK + t.replace(" ", MARK)) if t else [] for t, o in zip(texts, odd) if o]
        words = self.words
        found = list(map(words.get, keys))
        new = {MARK + k for k, v in zip(keys, found) if v is None} | {w for s in cut for w in s if self._key(w) not in words}
        if new:
            self._learn(list(new))
            found = list(map(words.__getitem__, keys))
        parts, rest = iter(joined(found)), iter([b"".join(words[self._key(w)] for w in s) for s in cut])
        return [next(rest) if o else next(parts) for o in odd]

    @staticmethod
    def _key(word: str) -> str:
        """A word with the one mark that most have left off; any other stands for itself behind a mark of its own."""
        return word[1:] if word[:1] == MARK and word[1:2] != MARK and len(word) > 1 else MARK + word

    def _learn(self, new: list[str]) -> None:
        ties = {w for w in new if MARK * 2 in w} if self.kind == "bpe" else set()  # runs of marks have equal scores: by definition
        for w in ties:
            self.words[self._key(w)] = np.array(self.merged(w), dtype=self.type).tobytes()
        rest = [w for w in new if w not in ties]
        for a, b in steps(map(len, rest), LATTICE_CHARS):
            self.words.update(zip(map(self._key, rest[a:b]), self.encode_words(rest[a:b])))

    def ids(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, dtype=self.type)

    def decode(self, data: bytes) -> str:
        """The text of ids: pieces and bytes joined, marks as blanks, without the first blank."""
        text = b"".join(map(self.out.__getitem__, self.ids(data).tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@cache
def load(path: str, kind: str | None) -> Pieces:
    return Pieces.from_model(path, kind)


def encoded(docs: DataFrame, path: str, kind: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids array<int>, n_pieces, ids_crc32, round_trip) of whole texts.

    ids_crc32 is over the ids as little-endian unsigned 32-bit integers; round_trip says that decoding gives the text
    back (a text holding the mark character itself decodes to a blank there). Null and empty texts have no ids.
    Repeated rows stay, other columns are ignored, an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path, kind)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in steps(map(len, texts), 4_000_000):
                data = codec.encode(texts[a:b])
                ids = [codec.ids(d) for d in data]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(a, b - a),
                        pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())),
                        pa.array([len(i) for i in ids], pa.int64()),
                        pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()),
                        pa.array([codec.decode(d) == t for d, t in zip(data, texts[a:b])], pa.bool_()),
                    ],
                    ["id", "ids", "n_pieces", "ids_crc32", "round_trip"],
                )

    text_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "id long, ids array<int>, n_pieces long, ids_crc32 long, round_trip boolean")


def op6_sentencepiece(spark, sf_dir: str, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_pieces, ids_crc32, round_trip for every text of `documents`."""
    import public_tokenizers

    found = encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(vocabulary))
    return found.select(F.col("id").alias("doc_id"), "n_pieces", "ids_crc32", "round_trip")
