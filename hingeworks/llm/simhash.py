"""SimHash near-duplicate detection by anchor-point covering.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's word shingles. Two fingerprints link if they
differ in at most `threshold` bits. To find links without comparing all pairs, the words of a perfect covering code
serve as anchors: the Hamming code of length 63 (covering radius 1) over the low 63 bits. Fingerprints within distance
t of each other have a midpoint within ceil(t / 2) of both, and an anchor lies within the covering radius of that
midpoint; so replicating each distinct fingerprint to every anchor within `covering radius + ceil(t / 2)` brings each
linked pair together at some anchor (the sufficient radius of covering radius + t costs 652 copies, this one 32).
An anchor's group has at most 4,034 members, whatever the data: all 64-bit words within distance 2 of it in 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hingeworks.llm.common import components, cut, cuts_so_far, drop_cuts_since, shuffle_width, text_batches

SEED = 42
LOW63 = (1 << 63) - 1
#: Parity-check masks: bit p (0 to 62) belongs to column p + 1, the masks are the binary digits of the columns.
MASKS = [sum(1 << p for p in range(63) if (p + 1) >> j & 1) for j in range(6)]


def shingle_hashes(text: str | None, width: int, seed: int = SEED) -> list[int]:
    """XXH64 of each shingle, repeats included; a text of fewer words is one shingle, a text without words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower touches A-Z only, split the six blanks only
    if not words:
        return []
    line = b" ".join(words)
    width = min(width, len(words))
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_intdigest
    return [digest(line[a : b - 1], seed) for a, b in zip(starts, starts[width:])]


def simhash(hashes: list[int] | np.ndarray) -> int:
    """Unsigned 64-bit majority: a bit is 1 if set in over half of the hashes; 0 without hashes."""
    n = len(hashes)
    if not n:
        return 0
    h = np.asarray(hashes, dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 1 << 15):
        bits = np.unpackbits(h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp): fp is the signed 64-bit fingerprint of the whole text; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str | None, int] = {}
            out = np.empty(batch.num_rows, dtype=np.uint64)
            for i, text in enumerate(batch.column("text").to_pylist()):
                if text not in seen:
                    seen[text] = simhash(shingle_hashes(text, width))
                out[i] = seen[text]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out.view(np.int64))], ["id", "fp"])

    text_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "id long, fp long")


def anchors(fp: Column) -> Column:
    """Every word of the Hamming code within distance 2 of the low 63 bits of fp: one, or 32."""
    low = fp.bitwiseAND(F.lit(LOW63))
    syndrome = sum((F.bit_count(low.bitwiseAND(F.lit(m))) % 2 * F.lit(1 << j) for j, m in enumerate(MASKS)), F.lit(0)).cast("int")
    one = F.lit(1).cast("long")
    flip = lambda i: F.call_function("shiftleft", one, i - 1)
    pairs = F.filter(F.sequence(F.lit(1), F.lit(63)), lambda i: i.bitwiseXOR(syndrome) > i)
    two = F.transform(pairs, lambda i: low.bitwiseXOR(flip(i)).bitwiseXOR(flip(i.bitwiseXOR(syndrome))))
    return F.when(syndrome == 0, F.array(low)).otherwise(F.concat(F.array(low.bitwiseXOR(flip(syndrome))), two))


def forest(members: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph that links members at distance `threshold` or less."""
    left = np.asarray(members, dtype=np.int64).view(np.uint64)
    out, todo = [], []
    while len(left) or todo:
        if not todo:
            todo, left = [left[0]], left[1:]
        x = todo.pop()
        near = np.bitwise_count(left ^ x) <= threshold
        hits = left[near]
        left = left[~near]
        out += [(int(np.int64(x)), int(np.int64(y))) for y in hits.view(np.uint64)]
        todo += list(hits)
    return out


def links(distinct: DataFrame, threshold: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect all that link within `threshold` <= 2."""
    if not 0 <= threshold <= 2:
        raise ValueError("anchors within distance 2 cover thresholds 0 to 2")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("members")
            offsets, values = col.offsets.to_numpy(), col.values.to_numpy()
            edges = []
            for a, b in zip(offsets, offsets[1:]):
                edges += forest(values[a:b], threshold)
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])

    wide = distinct.select("fp").repartition(shuffle_width(distinct.sparkSession), "fp")  # a row becomes 32
    spread = wide.select("fp", F.explode(anchors(F.col("fp"))).alias("anchor"))
    groups = spread.groupBy("anchor").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1).select("members")
    return groups.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, width: int, threshold: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, fp, component_id, n_same): component_id is the least id reachable over links, the row's own included.

    Null and blank texts have fingerprint zero and link like any other. Equal fingerprints link whatever their number:
    links are sought between distinct fingerprints only, so copies are never expanded into pairs. Repeated rows stay
    repeated. A null id counts as the least of all and makes its component's id null. An empty table gives no rows.
    Other columns of docs are ignored, so that none can clash.
    """
    before = cuts_so_far()
    own = cut(fingerprints(docs, width, id_col, text_col), "simhash")
    distinct = own.groupBy("fp").agg(F.min(F.struct(F.col("id").isNotNull().alias("k"), F.col("id").alias("v"))).alias("first"), F.count(F.lit(1)).alias("n_same"))
    distinct = cut(distinct, "simhash-distinct")
    roots = components(links(distinct, threshold), "simhash-components")
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "n_same", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    classes = rooted.join(least, "root").select("fp", F.col("least.v").alias("component_id"), "n_same")
    classes = cut(classes, "simhash-classes")
    drop_cuts_since(before, own, classes)
    return own.join(classes, "fp").select("id", "fp", "component_id", "n_same")


def op3_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id over whole `documents`: 3-word shingles, up to 2 differing bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs, width=3, threshold=2)
    hex16 = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), hex16.alias("fingerprint"), "component_id", "n_same")
