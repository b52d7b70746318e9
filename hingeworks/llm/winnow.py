"""Document fingerprints by winnowing.

Every k-gram of code points gets a rolling hash; of each window of w consecutive k-grams the least hash is kept, the
rightmost one on ties, with its position. Any passage of w + k - 1 code points that two texts share therefore leaves
at least one common hash in both fingerprints, and no shared passage shorter than k can.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hingeworks.llm.blocks import bounds_of, keyed, with_next
from hingeworks.llm.common import STEP_CHARS, steps

GRAM, WINDOW = 24, 41
#: Odd, so that it has an inverse modulo 2^64: a k-gram's hash is the sum of code[i + j] * BASE^j, shifted down to i = 0.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[str(base)] = have
    return have[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def winnow(texts: list[str], k: int = GRAM, w: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text (hashes uint32, positions int64), in text order. A text shorter than k is one gram; an empty one has none."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    n, none = len(code), (np.empty(0, np.uint32), np.empty(0, np.int64))
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((code + np.uint64(1)) * _power(BASE, n), out=prefix[1:])
    inverse = _power(BASE_INVERSE, max(n, 1))
    gram = _mixed((prefix[k:] - prefix[: n + 1 - k]) * inverse[: max(0, n + 1 - k)]) if n >= k else np.empty(0, np.uint64)
    # hash above, complement of the position below: the least value is the least hash, on ties the rightmost
    packed = (gram & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(gram), dtype=np.uint64))
    least, span = packed, 1
    while span * 2 <= w and len(least) > span:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < w and len(least) > w - span:
        least = np.minimum(least[: len(least) - (w - span)], least[w - span :])
    fresh = np.ones(len(least), dtype=bool)
    fresh[1:] = least[1:] != least[:-1]
    out, end = [], 0
    for size in lengths.tolist():
        start, end = end, end + size
        if not size:
            out.append(none)
            continue
        if size < k:
            h = _mixed((prefix[end : end + 1] - prefix[start : start + 1]) * inverse[start : start + 1])
            out.append(((h >> np.uint64(32)).astype(np.uint32), np.zeros(1, np.int64)))
            continue
        grams = size - k + 1
        if grams < w:
            kept = packed[start : start + grams].min(keepdims=True)
        else:
            first = fresh[start : start + grams - w + 1].copy()
            first[0] = True
            kept = least[start : start + grams - w + 1][first]
        at = 0xFFFFFFFF - (kept & np.uint64(0xFFFFFFFF)).astype(np.int64) - start
        out.append(((kept >> np.uint64(32)).astype(np.uint32), at))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sets of hashes; two empty fingerprints are alike."""
    x, y = set(a.tolist()), set(b.tolist())
    union = len(x | y)
    return len(x & y) / union if union else 1.0


def text_of(hashes: np.ndarray) -> str:
    """A fingerprint as text: eight hex digits a hash, in text order."""
    return hashes.astype(">u4").tobytes().hex()


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """Rows (id, n_chars, hashes array, positions array): the general operator. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text").to_pylist()
            for a, b in steps(map(len, texts)):
                prints = winnow(texts[a:b], k, w)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array([len(t) for t in texts[a:b]], pa.int64()), pa.array([h.astype(np.int64) for h, _ in prints], pa.list_(pa.int64())), pa.array([p for _, p in prints], pa.list_(pa.int64()))],
                    ["id", "n_chars", "hashes", "positions"],
                )

    return keyed(docs, id_col, text_col).select("id", "text").mapInArrow(run, "id long, n_chars long, hashes array<long>, positions array<long>")


def edited(text: str, following: str) -> str:
    """The last floor(n / 4) code points replaced by the first as many (or all) of the following text."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


OUT = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_hashes int, positions array<int>, edited_positions array<int>"


def edit_probe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = GRAM, w: int = WINDOW) -> DataFrame:
    """Fingerprint each text, its edited text and its successor by ascending id (after the last: the first).

    positions tells where each hash of the fingerprint stands (the first code point of its k-gram), so that a shared
    hash leads to the shared passage; edited_positions does so for the edited text.

    A null text counts as empty, a null id comes first, rows of equal ids follow each other by text, a table of one row
    succeeds itself, an empty table gives no rows. Other columns of docs are ignored.
    """
    own = keyed(docs, id_col, text_col)

    def probe(rows: list[tuple[bool, int | None, str]]) -> pa.RecordBatch:
        mine = [i for i in range(len(rows) - 1) if rows[i][0]]
        texts = [r[2] for r in rows]
        changed = [edited(texts[i], texts[i + 1]) for i in mine]
        found, fresh = winnow(texts, k, w), winnow(changed, k, w)
        prints, new = [h for h, _ in found], [h for h, _ in fresh]
        places = lambda every: pa.array([p.astype(np.int32) for p in every], pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][1] for i in mine], pa.int64()),
                pa.array([len(texts[i]) for i in mine], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]),
                pa.array([text_of(prints[i]) for i in mine]),
                pa.array([text_of(h) for h in new]),
                pa.array([likeness(prints[i], h) for i, h in zip(mine, new)], pa.float64()),
                pa.array([likeness(prints[i], prints[i + 1]) for i in mine], pa.float64()),
                pa.array([len(prints[i]) for i in mine], pa.int32()),
                places(found[i][1] for i in mine),
                places(p for _, p in fresh),
            ],
            ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_hashes", "positions", "edited_positions"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(batch.column("own").to_pylist(), batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                rows.append(row)
                size += len(row[2])
                if size >= STEP_CHARS and len(rows) > 1:
                    yield probe(rows)
                    rows, size = rows[-1:], len(row[2])
        if len(rows) > 1:
            yield probe(rows)

    bounds = bounds_of(own)
    return with_next(own, bounds).select("own", "id", "text").mapInArrow(run, OUT)


def op4_winnowing_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of whole `documents` texts and of their edited texts."""
    return edit_probe(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
