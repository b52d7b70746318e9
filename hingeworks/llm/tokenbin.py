"""Token ids as binary shards with Elias-Fano document boundaries.

A shard holds, for a block of documents of ascending id: the concatenated ids, then the documents' end offsets and then
the document ids, both as Elias-Fano sequences, then a footer. An offset costs about 2 + log2(ids a document) bits
instead of 64, and `select` returns any of them from the samples without decoding the rest. Null document ids come first
and are only counted; the others are stored as differences from the least.

Layout, little-endian: ids (2 bytes each where the vocabulary allows, else 4) | low bits, high bits and samples of the
offsets | the same of the document ids | footer: 8-byte magic, then 14 int64: ids, documents, id width, null document
ids, least document id, zero, and for either sequence its low-bit width and the lengths of its three parts in bytes.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hingeworks.llm.blocks import block_of, bounds_of, keyed
from hingeworks.llm.common import coded_words, kept_path, steps

MAGIC = b"HWEFIDS2"
SAMPLE = 256
#: Cached words a worker holds at most; beyond that the cache starts anew.
CACHE_WORDS = 500_000
#: Bytes of texts encoded at a time, and one text more.
BATCH_BYTES = 12_000_000


class EliasFano:
    """A non-descending sequence of non-negative integers, near its minimal space, with select."""

    def __init__(self, n: int, low_width: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_width, self.low, self.high, self.samples = n, low_width, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        top = int(v[-1]) + 1 if n else 1
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = (v[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        at = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        marks = np.zeros(int(at[-1]) + 1 if n else 0, dtype=np.uint8)
        marks[at] = 1
        return cls(n, width, low, np.packbits(marks, bitorder="little").tobytes(), at[::SAMPLE].copy())

    def parts(self) -> list[bytes]:
        """Low bits, high bits, samples: the place of every SAMPLE-th set bit, in as few bytes as the last one needs."""
        return [self.low, self.high, self.samples.astype(self.sample_type(len(self.high))).tobytes()]

    @staticmethod
    def sample_type(high: int) -> str:
        return "<u2" if 8 * high < 1 << 16 else "<u4" if 8 * high < 1 << 32 else "<u8"

    @classmethod
    def from_parts(cls, n: int, low_width: int, low: bytes, high: bytes, samples: bytes) -> EliasFano:
        return cls(n, low_width, low, high, np.frombuffer(samples, cls.sample_type(len(high))))

    def select(self, i: int) -> int:
        """The i-th value: the i-th set bit of the high part, found from the nearest sample, and its low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start = int(self.samples[i // SAMPLE])
        need, byte = i % SAMPLE, start // 8
        word = self.high[byte] >> start % 8 << start % 8
        while word.bit_count() <= need:
            need -= word.bit_count()
            byte += 1
            word = self.high[byte]
        for _ in range(need):
            word &= word - 1
        at = byte * 8 + (word & -word).bit_length() - 1
        first = i * self.low_width
        chunk = int.from_bytes(self.low[first // 8 : (first + self.low_width + 7) // 8], "little")
        return (at - i << self.low_width) | (chunk >> first % 8 & (1 << self.low_width) - 1)


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class ShardWriter:
    """Writes under a name of its own and moves the finished file into place, so a repeated task does no harm."""

    def __init__(self, uri: str, width: int):
        self.fs, self.path = file_system(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.own, self.width = f"{self.path}.{uuid.uuid4().hex}.tmp", width
        self.out = self.fs.open_output_stream(self.own)
        self.ids: list[int | None] = []
        self.sizes: list[int] = []

    def add(self, doc: int | None, data: bytes) -> None:
        self.out.write(data)
        self.ids.append(doc)
        self.sizes.append(len(data) // self.width)

    def close(self) -> tuple[int, int]:
        ends = np.cumsum(np.array(self.sizes, dtype=np.int64))
        known = [d for d in self.ids if d is not None]
        least = known[0] if known else 0
        total, foot = int(ends[-1]) if len(ends) else 0, []
        for ef in (EliasFano.encode(ends), EliasFano.encode(np.array([d - least for d in known], dtype=np.uint64))):
            parts = ef.parts()
            foot += [ef.low_width, *map(len, parts)]
            for part in parts:
                self.out.write(part)
        self.out.write(MAGIC + np.array([total, len(ends), self.width, len(self.ids) - len(known), least, 0, *foot], dtype="<i8").tobytes())
        self.out.close()
        self.fs.move(self.own, self.path)
        return len(ends), total


class ShardReader:
    """Opens a shard; holds its two sequences, reads ids on demand."""

    FOOT = 8 + 14 * 8

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        foot = self._at(size - self.FOOT, self.FOOT)
        if foot[:8] != MAGIC:
            raise ValueError(f"{uri} is no shard of token ids")
        self.n_ids, self.n_docs, self.width, self.nulls, self.least, _, *rest = np.frombuffer(foot[8:], "<i8").tolist()
        at, found = self.n_ids * self.width, []
        for n, (low_width, *sizes) in ((self.n_docs, rest[:4]), (self.n_docs - self.nulls, rest[4:])):
            parts = []
            for s in sizes:
                parts.append(self._at(at, s))
                at += s
            found.append(EliasFano.from_parts(n, low_width, *parts))
        self.ends, self.docs = found

    def _at(self, start: int, size: int) -> bytes:
        return self.file.read_at(size, start)

    def bounds(self, i: int) -> tuple[int, int]:
        """Start and end of the i-th document in this shard's ids."""
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.least + self.docs.select(i - self.nulls)

    def ids(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self._at(start * self.width, (end - start) * self.width), f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        return self.ids(*self.bounds(i))

    def close(self) -> None:
        self.file.close()


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def letter_tokenizer(path: str):
    """The same model for letter-only words already spelled in its byte alphabet: split at line feeds, nothing else."""
    from tokenizers import Tokenizer, pre_tokenizers

    tok = Tokenizer.from_file(path)
    tok.pre_tokenizer = pre_tokenizers.Split(BYTES[10], "isolated")
    return tok


def _byte_alphabet() -> list[str]:
    """A byte-level vocabulary's character for each byte: itself where it prints, else the next from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(other)) for b in range(256)]


BYTES = _byte_alphabet()
_SPELL = dict(enumerate(BYTES))


@cache
def shared_encoder(path: str, end_id: int | None) -> WordCachedEncoder:
    """One a worker, so that its tasks share the words met so far."""
    return WordCachedEncoder(path, end_id)


class WordCachedEncoder:
    """Encodes whole texts with a byte-level BPE of the tokenizers library, meeting each distinct word once.

    The library's byte-level splitter ends a piece before any blank or line feed that isn't part of a run of three white
    spaces or of two at the end, and no merge crosses pieces. So a text without such runs and without special-token
    strings is the concatenation of its words (with the blank before them) and line feeds, each encoded on its own.
    Other texts go to the library whole. Words are told apart in Arrow, new ones go to the library many at a time.

    Keys: a word stands for itself after a blank, the empty word for a blank alone; START leads a word without a blank.
    """

    START = "\x01"
    #: White space of either library's definition, three in a row or two at the end; or the mark itself.
    WHOLE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]{3}|[\s\x0b\x1c-\x1f\x{85}\p{Z}]{2}\z|\x01"
    #: Letters, then the marks that may follow them; the splitter always cuts between.
    LETTERS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:]*)")
    #: Words in one text for the library.
    LINE = 500

    def __init__(self, path: str, end_id: int | None):
        self.tok, self.letters = tokenizer(path), letter_tokenizer(path)
        wide = max(self.tok.get_vocab_size(), (end_id or 0) + 1) > 1 << 16
        self.width, self.kind = (4, "<u4") if wide else (2, "<u2")
        self.end = b"" if end_id is None else np.array([end_id], dtype=self.kind).tobytes()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        feed = self.tok.encode("\n", add_special_tokens=False).ids
        if len(feed) != 1 or self.tok.decode(self.tok.encode(" a\n b", add_special_tokens=False).ids) != " a\n b":
            raise ValueError(f"{path} is no byte-level vocabulary: it doesn't keep line feeds and blanks")
        self.feed = feed[0]
        self.words: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.kind) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _between_feeds(self, tok, words: list[str], lead: str = "", spell: bool = False) -> Iterator[tuple[str, bytes]]:
        """(word, ids of lead + word) for words without white space inside, many to a text with line feeds between."""
        glue = "\n" + lead
        for i in range(0, len(words), 100 * self.LINE):
            lines = [words[j : j + self.LINE] for j in range(i, min(i + 100 * self.LINE, len(words)), self.LINE)]
            texts = [lead + glue.join(x) for x in lines]
            if spell:
                texts = [t.encode().decode("latin-1").translate(_SPELL) for t in texts]
            for own, e in zip(lines, tok.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(e.ids, dtype=self.kind)
                stops = (np.flatnonzero(ids == self.feed) * self.width).tolist()
                data, width = ids.tobytes(), self.width
                yield from zip(own, [data[a:b] for a, b in zip([0, *[x + width for x in stops]], [*stops, len(data)])])

    def _learn(self, keys: list[str]) -> None:
        """Letter-only words first, then words with marks behind letters, whose letters are then known, then the rest."""
        words, match, start = self.words, self.LETTERS.fullmatch, self.START
        rest = [k for k in keys if not (k.isascii() and k.isalpha())]
        plain, marked, odd = [k for k in keys if k.isascii() and k.isalpha()], [], []
        for k in rest:
            if m := match(k[1:] if k[:1] == start else k):
                core, marks = m.groups()
                head = start + core if k[:1] == start else core
                if marks:
                    marked.append((k, head, marks))
                else:
                    plain.append(k)
            else:
                odd.append(k)
        known = set(plain)
        extra = {h for _, h, _ in marked if h not in words and h not in known}
        led = [k for k in plain if k[0] != start] + [h for h in extra if h[0] != start]
        bare = [k[1:] for k in plain if k[0] == start] + [h[1:] for h in extra if h[0] == start]
        words.update(self._between_feeds(self.letters, led, " ", spell=True))
        words.update((start + w, v) for w, v in self._between_feeds(self.letters, bare, spell=True))
        fresh = list({m for _, _, m in marked if m not in self.marks})
        self.marks.update(self._between_feeds(self.tok, fresh))
        words.update([(k, words[h] + self.marks[m]) for k, h, m in marked])
        solid = [k for k in odd if k[:1] != start and k.split() == [k]]
        words.update(self._between_feeds(self.tok, solid, " "))
        last = [k for k in odd if k[:1] == start or k.split() != [k]]
        texts = [k[1:] if k[:1] == start else k if k == "\n" else " " + k for k in last]
        words.update(zip(last, (i.tobytes() for i in self._ids(texts))))

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """Ids of whole texts as bytes."""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        whole = pc.match_substring_regex(texts, self.WHOLE)
        for s in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, s))
        alone = [i.tobytes() for i in self._ids(texts.filter(whole).to_pylist())]
        rest = texts.filter(pc.invert(whole))
        marked = pc.binary_join_element_wise(self.START, pc.replace_substring(rest, "\n", f" \n {self.START}"), "")
        keys, joined = coded_words(pc.split_pattern(marked, " "))
        found = list(map(self.words.get, keys))
        if None in found:
            self._learn([k for k, v in zip(keys, found) if v is None])
            found = list(map(self.words.__getitem__, keys))
        parts = iter(joined(found))
        single = iter(alone)
        return [(next(single) if w else next(parts)) + self.end for w in whole.to_pylist()]


def write_shards(docs: DataFrame, out: str, encoder: Callable[[], WordCachedEncoder], width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and write one shard a block of ascending ids under `out`; return the manifest (pid, path, n_docs, n_ids).

    A null text counts as empty, a null id comes first, rows of equal ids are ordered by their encoded bytes. The
    manifest has one row a shard and is itself a written table.
    """
    own = keyed(docs, id_col, text_col)
    bounds = bounds_of(own)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder()

        def coded(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            keys, ids, texts = (pa.concat_arrays([r.column(c) for r in rows]) for c in ("key", "id", "text"))
            pid = pa.array(block_of(bounds, keys.to_pylist()), pa.int32())
            return pa.RecordBatch.from_arrays([pid, keys, ids, pa.array(enc.encode(texts), pa.binary())], ["pid", "key", "id", "data"])

        held, size = [], 0  # words are told apart over some 12 MB of texts at a time
        for batch in batches:
            for a, b in steps(pc.binary_length(batch.column("text")).to_pylist(), BATCH_BYTES):
                part = batch.slice(a, b - a)
                held.append(part)
                size += pc.sum(pc.binary_length(part.column("text"))).as_py()
                if size >= BATCH_BYTES:
                    yield coded(held)
                    held, size = [], 0
        if held:
            yield coded(held)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, shard, done = None, None, []
        for batch in batches:
            for p, doc, data in zip(batch.column("pid").to_pylist(), batch.column("id").to_pylist(), batch.column("data")):
                if p != pid:
                    if shard:
                        done.append((pid, name, *shard.close()))
                    pid, name = p, f"{out}/shard-{p:06d}.ids"
                    shard = ShardWriter(name, width)
                shard.add(doc, data.as_py())
        if shard:
            done.append((pid, name, *shard.close()))
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(kinds)], ["pid", "path", "n_docs", "n_ids"])

    coded = own.mapInArrow(encode, "pid int, key long, id long, data binary")
    dealt = coded.repartitionById(max(1, len(bounds)), F.col("pid")).sortWithinPartitions("pid", "key", "data")
    schema = "pid int, path string, n_docs long, n_ids long"
    dealt.select("pid", "id", "data").mapInArrow(write, schema).write.parquet(f"{out}/manifest")
    return docs.sparkSession.read.schema(schema).parquet(f"{out}/manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Rows (id, start, n_tokens, ids_crc32) read back from the shards; start counts the ids of all documents before."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist()):
                shard = ShardReader(path)
                for block in range(0, shard.n_docs, 100_000):
                    every = range(block, min(block + 100_000, shard.n_docs))
                    ends = [shard.bounds(block)[0], *map(shard.ends.select, every)]
                    sizes = [b - a for a, b in zip(ends, ends[1:])]
                    for a, b in steps(sizes, 4_000_000):
                        base = ends[a]
                        ids = shard.ids(base, ends[b]).astype("<u4")
                        sums = [zlib.crc32(ids[x - base : y - base].tobytes()) for x, y in zip(ends[a:b], ends[a + 1 : b + 1])]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([shard.doc_id(block + i) for i in range(a, b)], pa.int64()), pa.array([x + first for x in ends[a:b]], pa.int64()), pa.array(sizes[a:b], pa.int64()), pa.array(sums, pa.int64())],
                            ["id", "start", "n_tokens", "ids_crc32"],
                        )
                shard.close()

    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    placed = manifest.select("pid", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"))
    shards = max(1, int(manifest.agg(F.coalesce(F.max("pid"), F.lit(0))).first()[0]) + 1)
    return placed.repartitionById(shards, F.col("pid")).select("path", "first").mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long")


def op10_token_id_output(spark, sf_dir: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2) -> DataFrame:
    """Encode whole `documents`, write the shards, read them back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    path = public_tokenizers.path(vocabulary)
    width = shared_encoder(path, end_id).width
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_shards(docs, kept_path(spark, "token-ids"), lambda: shared_encoder(path, end_id), width)
    return read_shards(manifest).withColumnRenamed("id", "doc_id")
