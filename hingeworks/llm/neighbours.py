"""Approximate nearest neighbours by cross-polytope hashing, reranked exactly.

A table turns unit vectors by pseudo-rotations (three rounds of random signs and a fast Hadamard transform) and files
each under its nearest signed axes: one axis of each of several rotations, joined to one key. The number of keys grows
with the number of vectors (about one for FILL of them), so a bucket stays small. Queries probe, in each table, the keys
whose axes sum to the greatest components, so that a neighbour need not share the query's own key; the number of probes
grows as a power of the number of vectors below one half, so a query meets an ever smaller share of them. Candidates are
ranked by their exact cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hingeworks.llm.common import cut, cuts_so_far, drop_cuts_since

TABLES, SEED = 12, 20240607
#: Vectors a key on average; probes a table and query: PROBES * n ** GROWTH for n vectors.
FILL, PROBES, GROWTH = 4, 1.6, 0.4
#: Vectors a group of keys holds on average; groups are cut from twice as many of either side on.
BLOCK = 65_536
#: Salts that part the copies of one vector while its least ids are found.
SALTS = 32
#: Numbers that one vectorised step holds.
STEP = 4_000_000


@cache
def signs(width: int, rotations: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed + width).choice(np.array([-1.0, 1.0]), (rotations, 3, width))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Hadamard transform of the columns, whose length is a power of two, in n log n steps."""
    n, h = len(x), 1
    while h < n:
        y = x.reshape(n // (2 * h), 2, h, -1)
        new = np.empty_like(y)
        np.add(y[:, 0], y[:, 1], out=new[:, 0])
        np.subtract(y[:, 0], y[:, 1], out=new[:, 1])
        x, h = new.reshape(n, -1), 2 * h
    return x / np.sqrt(n)


def padded(x: np.ndarray) -> np.ndarray:
    """Unit rows with zeros up to a power of two."""
    width = 1 << max(1, x.shape[1] - 1).bit_length() if x.shape[1] > 1 else 2
    # the largest component first, so that no square overflows or vanishes
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return np.pad(x / np.linalg.norm(x, axis=1, keepdims=True), ((0, 0), (0, width - x.shape[1])))


def polytopes(width: int, bits: int) -> list[int]:
    """Axes that each rotation of a table may choose from, so that their signed choices make 2 ** bits keys."""
    full, out = width.bit_length(), []
    while bits > 0:
        out.append(1 << min(full, bits) - 1)
        bits -= full
    return out


def corners(x: np.ndarray, table: int, axes: list[int], seed: int = SEED) -> list[np.ndarray]:
    """For each rotation of a table the components of the columns of x along its signed axes: 2 i is +e_i, 2 i + 1 is -e_i."""
    flips = signs(len(x), TABLES * len(axes), seed)
    out = []
    for j, n in enumerate(axes):
        y = x
        for flip in flips[table * len(axes) + j]:
            y = hadamard(y * flip[:, None])
        out.append(np.stack([y[:n], -y[:n]], axis=1).reshape(2 * n, -1))
    return out


@cache
def combinations(sizes: tuple[int, ...], most: int) -> np.ndarray:
    """Places (one for each rotation, counted from the best) that can be among the `most` best sums.

    A combination is beaten by all that are no worse in each place, so the product of its places is `most` at most.
    """
    out = [((), 1)]
    for n in sizes:
        out = [((*p, i), q * (i + 1)) for p, q in out for i in range(min(n, most // q))]
    return np.array([p for p, _ in out])


def keys_of(x: np.ndarray, bits: int, most: int, tables: int = TABLES, seed: int = SEED) -> np.ndarray:
    """(rows, tables, at most `most`): the joint keys of the greatest summed components, greatest first."""
    x = np.ascontiguousarray(padded(x).T)
    axes, out = polytopes(len(x), bits), []
    tried = combinations(tuple(2 * n for n in axes), most)
    most = min(most, len(tried))
    for t in range(tables):
        found = corners(x, t, axes, seed)
        if most == 1:
            key = np.zeros(x.shape[1], dtype=np.int64)
            for y in found:
                key = key * len(y) + y.argmax(axis=0)
            out.append(key[:, None])
            continue
        order = [np.argsort(-y.T, axis=1, kind="stable")[:, : tried.max() + 1] for y in found]
        best = [np.take_along_axis(y.T, at, axis=1) for y, at in zip(found, order)]
        probes = np.empty((x.shape[1], most), dtype=np.int64)
        step = max(1, STEP // len(tried))
        for a in range(0, len(probes), step):
            total = sum(v[a : a + step][:, tried[:, j]] for j, v in enumerate(best))
            first = np.argsort(-total, axis=1, kind="stable")[:, :most]
            key = np.zeros(first.shape, dtype=np.int64)
            for j, y in enumerate(found):
                key = key * len(y) + np.take_along_axis(order[j][a : a + step], tried[first, j], axis=1)
            probes[a : a + step] = key
        out.append(probes)
    return np.stack(out, axis=1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec) of rows that take part: id and vector not null, all components finite, not all zero."""
    v = F.col("vec")
    kind = vectors.schema[vector_col].dataType.simpleString()  # floats stay floats on the way, half as long
    kind = kind if kind == "array<float>" else "array<double>"
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return own.where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists("vec", lambda x: x != 0))


def classes(own: DataFrame, least: int) -> DataFrame:
    """(rep, vec, ids): distinct vectors with their `least` smallest ids. Copies are parted by salts first."""
    salted = own.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    few = salted.withColumn("k", F.row_number().over(Window.partitionBy("vec", "salt").orderBy("id"))).where(F.col("k") <= least)
    few = few.withColumn("k", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("k") <= least)
    groups = few.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return groups.select(F.col("ids")[0].alias("rep"), "vec", "ids")


def group_of(keys: np.ndarray, groups: int) -> np.ndarray:
    """Keys dealt evenly to groups."""
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(groups)).astype(np.int32)


def matrix(vecs: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    vecs = vecs.combine_chunks() if isinstance(vecs, pa.ChunkedArray) else vecs
    return vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vecs), -1)


def filed(rows: DataFrame, bits: int, most: int, groups: int) -> DataFrame:
    """rows (rep, vec) once for each table and group that holds any of their keys: rep, width, table, grp, keys."""

    def deal(reps: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        key = keys_of(x, bits, most)
        n, tables, each = key.shape
        place = np.repeat(np.arange(n * tables), each)  # row and table
        key, group = key.ravel(), group_of(key.ravel(), groups)
        order = np.lexsort((group, place))
        place, group = place[order], group[order]
        starts = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (group[1:] != group[:-1])])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(key)].astype(np.int32)), pa.array(key[order]))
        row, table = np.divmod(place[starts], tables)
        columns = [pa.array(reps[row]), pa.array(np.full(len(starts), x.shape[1], np.int32)), pa.array(table.astype(np.int32)), pa.array(group[starts]), lists]
        return pa.RecordBatch.from_arrays(columns, ["rep", "width", "table", "grp", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(16, min(2_000, STEP // (TABLES * most)))
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                reps, vecs = part.column("rep").to_numpy(), part.column("vec")
                sizes = np.diff(vecs.offsets.to_numpy())
                for size in np.unique(sizes):
                    at = np.flatnonzero(sizes == size)
                    yield deal(reps[at], matrix(vecs.take(pa.array(at))))

    return rows.select("rep", "vec").mapInArrow(run, "rep long, width int, table int, grp int, keys array<long>")


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision."""
    with np.errstate(over="ignore", invalid="ignore", under="ignore", divide="ignore"):
        plain = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
    odd = ~np.isfinite(plain) | (plain == 0)
    if odd.any():  # squares that overflow or vanish
        plain[odd] = (unit(a[odd]) * unit(b[odd])).sum(axis=1)
    return plain


def nearest_in_block(queries: pa.Table, rows: pa.Table, least: int) -> pa.Table:
    """For each query its `least` nearest ids among the rows that share a key with it: (query, id, score)."""
    out: tuple[list, list, list] = ([], [], [])
    if queries.num_rows and rows.num_rows:
        held = rows["keys"].combine_chunks()
        key = held.flatten().to_numpy()
        owner = np.repeat(np.arange(rows.num_rows), np.diff(held.offsets.to_numpy()))
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        x = matrix(rows["vec"])
        near_x, ids = unit(x), rows["ids"].to_pylist()
        reps, q = queries["rep"].to_pylist(), matrix(queries["vec"])
        near_q = unit(q)
        asked = queries["keys"].combine_chunks()
        wanted, ends = asked.flatten().to_numpy(), asked.offsets.to_numpy() - asked.offsets[0].as_py()
        lo, hi = np.searchsorted(key, wanted, "left"), np.searchsorted(key, wanted, "right")
        for i in range(len(q)):
            spans = [owner[a:b] for a, b in zip(lo[ends[i] : ends[i + 1]].tolist(), hi[ends[i] : ends[i + 1]].tolist()) if a < b]
            if not spans:
                continue
            at = np.concatenate(spans)
            near = near_x[at] @ near_q[i]
            k = min(least, len(at))
            hits = at[near >= np.partition(near, len(at) - k)[len(at) - k] - 1e-9]
            exact = cosine(np.broadcast_to(q[i], (len(hits), x.shape[1])), x[hits])
            best = sorted({(-s, j) for s, h in zip(exact.tolist(), hits.tolist()) for j in ids[h]})[:least]
            out[0].extend([reps[i]] * len(best))
            out[1].extend(j for _, j in best)
            out[2].extend(-s for s, _ in best)
    return pa.table({"query": pa.array(out[0], pa.int64()), "id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})


def compared(probes: DataFrame, asks: DataFrame, index: DataFrame, rows: DataFrame, least: int, block: int) -> DataFrame:
    """(query, id, score): the nearest of each of asks (rep, vec) among the rows (rep, vec, ids) of its keys.

    probes and index have (rep, width, table, grp, keys); groups (width, table, grp) are cut into blocks of both sides.
    """
    by = ["width", "table", "grp"]
    count = lambda df, name: df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(2 * block)).cast("int").alias(name))
    parts = cut(count(index, "row_parts").join(count(probes, "ask_parts"), by), "ann-parts", narrow=True)
    salt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    index = index.join(parts, by).withColumn("rs", salt("rep", "row_parts")).withColumn("qs", every("ask_parts"))
    probes = probes.join(parts, by).withColumn("qs", salt("rep", "ask_parts")).withColumn("rs", every("row_parts"))
    cell = [*by, "rs", "qs"]
    left = probes.join(asks.select("rep", "vec"), "rep").select(*cell, "rep", "vec", "keys").groupBy(*cell)
    right = index.join(rows, "rep").select(*cell, "ids", "vec", "keys").groupBy(*cell)
    return left.cogroup(right).applyInArrow(lambda a, b: nearest_in_block(a, b, least), "query long, id long, score double")


def ranked_nearest(pairs: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score) from what was found for the class of each query."""
    once = found.groupBy("query", "id").agg(F.max("score").alias("score"))
    best = once.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("k") <= k + 1)
    near = pairs.select(F.col("id").alias("query_id"), F.col("rep").alias("query")).join(best, "query").where("id <> query_id")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("k"))).where(F.col("rank") <= k)
    return near.select("query_id", "rank", "id", "score")


def search(vectors: DataFrame, is_query, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Rows (query_id, rank, id, score): each query's k nearest other rows found, nearest first, ties to the smaller id.

    is_query is a condition on the id. Every row is indexed. Equal vectors are hashed and compared once, as a class with
    its k + 1 least ids, which is all that k results can need. Groups of keys are salted into blocks of twice `block`
    vectors and queries at most on average, so no task holds more. Queries that the tables leave with fewer than k results are
    compared with all rows, in blocks. Rows with a null id or a vector that is null, empty, zero or holds null or
    non-finite components take no part; vectors of other lengths are never compared; repeated rows count as rows.
    """
    own, before = usable(vectors, id_col, vector_col), cuts_so_far()
    groups = cut(classes(own, k + 1), "ann-classes")
    asked = own.where(is_query(F.col("id")))
    pairs = cut(asked.join(groups.select("vec", "rep"), "vec").select("id", "rep", "vec"), "ann-queries")
    once = pairs.select("rep", "vec").dropDuplicates(["rep"])
    n = groups.count()
    bits = max(1, min(60, round(np.log2(max(n, 1) / FILL)))) if n > FILL else 1
    most = max(1, int(np.ceil(PROBES * n**GROWTH)))
    dealt = max(1, -(-n // block))
    index = cut(filed(groups, bits, 1, dealt), "ann-index")
    probes = cut(filed(once, bits, most, dealt), "ann-probes")
    found = compared(probes, once, index, groups, k + 1, block)
    near = cut(ranked_nearest(pairs, found, k), "ann-found", narrow=True)
    held = groups.groupBy(F.size("vec").alias("width")).agg(F.sum(F.size("ids")).alias("held"))
    got = pairs.select("id", "rep", "vec", F.size("vec").alias("width")).join(near.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("got")), "id", "left")
    short = got.join(held, "width").where(F.coalesce("got", F.lit(0)) < F.least(F.lit(k), F.col("held") - 1)).select("id", "rep", "vec")
    short = cut(short, "ann-short", narrow=True)
    if short.isEmpty():
        drop_cuts_since(before, near)
        return near
    drop_cuts_since(before, near, groups, short)
    asks = short.select("rep", "vec").dropDuplicates(["rep"])
    whole = lambda df: df.select("rep", F.size("vec").alias("width"), F.lit(0).alias("table"), F.lit(0).alias("grp"), F.array(F.lit(0).cast("long")).alias("keys"))
    found = compared(whole(asks), asks, whole(groups), groups, k + 1, block)
    return near.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(ranked_nearest(short, found, k))


def op5_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 5 nearest of each vector whose id is divisible by 50."""
    found = search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 50 == 0, 5)
    return found.withColumnRenamed("id", "vec_id")
