"""Near-duplicate removal: SimHash links and an exact join of shingle sets by prefixes, both followed by an exact similarity check.

Documents are classed by the Jaccard similarity of their sets of word shingles. Two sets of similarity t, each sorted by
one order of all shingles, share a shingle among the first n - ceil(t n) + 1 of each (n its size), whatever the order;
so grouping documents by the shingles of these prefixes brings each near pair together, without exception. The order
puts shingles first that a sample of the documents doesn't repeat, which keeps groups small; it has no part in the result.
Documents whose SimHash fingerprints meet at an anchor within BITS bits are compared first (`simhash.links`). Similarity 0.8
doesn't bound differing bits, so the groups of prefixes then bring what fingerprints miss.
Each document is compared with the least of its groups first; all members that this leaves in different components are
then compared with each other, so a group of copies costs as many comparisons as it has members, and no pair is left out.
Before whole sets are read, pairs are passed over whose parity sketches prove more differences than the similarity allows;
members of a group are judged by their sketches within the task that holds their blocks, so that pairs are never written out.
Groups are rows of members, never lists, so a shingle may be in any number of documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hingeworks.llm.common import NO_ID, by_ids, components, cut, cuts_so_far, drop_cuts_since, ranked, text_batches, unused
from hingeworks.llm import simhash
from hingeworks.llm.simhash import shingle_hashes

#: Documents that the order of shingles is learned from, about, and shingles it knows as common at most.
SAMPLE, COMMON = 16_000, 500_000
#: Members of a group that are compared with as many others at a time.
BLOCK = 2_048
#: Bits in which linked fingerprints differ at most.
BITS = 2


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(np.array(shingle_hashes(text, width), dtype=np.uint64))


def sketch(s: np.ndarray) -> bytes:
    """A bit for each class of hashes: whether the set holds an odd number of it. Two to four bits a shingle, 64 at least."""
    bits = 1 << max(6, (2 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """How many shingles are in one set only, at least: those of a class whose parities differ. The longer sketch is folded."""
    short, long = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    return int(np.bitwise_count(short ^ np.bitwise_xor.reduce(long.reshape(-1, len(short)), axis=0)).sum())


def common_shingles(own: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample share, ascending, and how many do."""
    every = max(1, own.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, width).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.zeros(0, np.int64)]))], ["s"])

    part = own.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).select("text").mapInArrow(run, "s long")
    rows = part.groupBy("s").count().where("count > 1").orderBy(F.desc("count"), "s").limit(COMMON).toArrow()
    s, n = rows["s"].to_numpy().view(np.uint64), rows["count"].to_numpy()
    order = np.argsort(s)
    return s[order], n[order]


def prefix(s: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first n - ceil(similarity * n) + 1 of n shingles (ascending), rare ones first, then by hash."""
    if not len(s):
        return s
    known, counts = common
    rank = np.zeros(len(s), dtype=np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, s), len(known) - 1)
        rank = np.where(known[at] == s, counts[at], 0)
    return s[np.argsort(rank, kind="stable")][: len(s) - math.ceil(similarity * len(s) - 1e-9) + 1]


def profiles(docs: DataFrame, width: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(key, same, n, prefix, sketch, fp): a digest of the text's shingle set, its size, its prefix, its sketch, and the fingerprint of its shingles."""
    text_batches(docs.sparkSession)
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("key"), F.col(text_col).alias("text"))
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(own, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, size, first, bits, prints = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                hashes = np.array(shingle_hashes(text, width), dtype=np.uint64)
                s = np.unique(hashes)
                prints.append(simhash.simhash(hashes))
                same.append(xxhash.xxh128_digest(s.tobytes()))
                size.append(len(s))
                first.append(prefix(s, similarity, common.value).view(np.int64))
                bits.append(sketch(s))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(same, pa.binary()), pa.array(size, pa.int32()), pa.array(first, pa.list_(pa.int64())), pa.array(bits, pa.binary()), pa.array(np.array(prints, dtype=np.uint64).view(np.int64))], ["key", "same", "n", "prefix", "sketch", "fp"])

    return own.mapInArrow(run, "key long, same binary, n int, prefix array<long>, sketch binary, fp long")


def alike(reps: DataFrame) -> DataFrame:
    """(gid, key, n, least): the members (key, size n) of the groups of documents that share a shingle of their prefixes, and a group's least member.

    A group is told by its shingle; shingles with the same members, as copies have many, are one group. Least members and
    what tells groups apart are aggregates, so that a shingle of any number of documents is never one row or one task.
    """
    each = cut(reps.select(F.explode("prefix").alias("s"), "key", "n"), "dedup-prefixes", narrow=True)
    several = cut(each.groupBy("s").count().where("count > 1").select("s"), "dedup-shared", narrow=True)  # most shingles are of one text
    each = cut(by_ids(each, F.col("s"), several, "left_semi"), "dedup-members", narrow=True)
    digest = [F.bit_xor(F.xxhash64("key", F.lit(i))).alias(f"h{i}") for i in range(2)]
    least = [F.min("key").alias("least"), F.min_by("n", "key").alias("least_n")]
    per = each.groupBy("s").agg(F.count(F.lit(1)).alias("m"), *least, F.max("key").alias("last"), *digest)
    once = per.groupBy("m", "least", "least_n", "last", "h0", "h1").agg(F.min("s").alias("s"))
    return each.join(once.select("s", F.struct(F.col("least").alias("key"), F.col("least_n").alias("n")).alias("least")), "s").select(F.col("s").alias("gid"), "key", "n", "least")


def by_fingerprint(reps: DataFrame, similarity: float) -> DataFrame:
    """(a, b), b < a: documents with the least of their fingerprint, and the least ones of fingerprints that SimHash links, where the set sizes allow the similarity."""
    first = cut(reps.groupBy("fp").agg(F.min("key").alias("key"), F.min_by("n", "key").alias("n"), F.count(F.lit(1)).alias("m")), "dedup-fingerprints", narrow=True)
    edges = simhash.links(first, BITS).distinct()
    x, y = first.select(F.col("fp").alias("a"), F.struct("key", "n").alias("x")), first.select(F.col("fp").alias("b"), F.struct("key", "n").alias("y"))
    near = edges.join(x, "a").join(y, "b").select("x", "y")
    equal = reps.select("fp", F.struct("key", "n").alias("x")).join(first.where("m > 1").select("fp", F.struct("key", "n").alias("y")), "fp").select("x", "y")
    fits = F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * F.lit(similarity) - F.lit(1e-6)
    return near.unionByName(equal).where(fits & (F.col("x.key") != F.col("y.key"))).select(F.greatest("x.key", "y.key").alias("a"), F.least("x.key", "y.key").alias("b"))


def with_least(groups: DataFrame, similarity: float) -> DataFrame:
    """(a, b), b < a: the members of groups with the least of each, where the set sizes allow the similarity."""
    fits = F.least("n", "least.n") >= F.greatest("n", "least.n") * F.lit(similarity) - F.lit(1e-6)
    return groups.where(fits & (F.col("key") > F.col("least.key"))).select(F.col("key").alias("a"), F.col("least.key").alias("b")).distinct()


def rest(groups: DataFrame, roots: DataFrame, reps: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """(a, b), b < a: all other pairs of members of a group whose sketches allow the similarity, but for those of one component (node, root) already.

    Members are dealt to blocks of `block` by their size, by ranks through partitions, and two blocks meet only if sizes in
    them can be similar, so that a group of texts of all sizes costs its members times those near in size. No task holds
    more than two blocks of a group at once; pairs are judged within the task, by the sketches (key, sketch) of reps, and
    only what is left of them leaves it.
    """
    flat = groups.where(F.col("key") > F.col("least.key")).select("gid", "key", "n")
    rooted = flat.join(roots.withColumnRenamed("node", "key"), "key", "left").select("gid", "key", "n", F.coalesce("root", "key").alias("root"))
    rooted = cut(rooted, "dedup-rooted", narrow=True)
    last = (F.ceil(F.count(F.lit(1)) / F.lit(block)) - 1).cast("int").alias("last")
    still = rooted.groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), last).where("lo < hi").select("gid", "last")
    members = rooted.join(still, "gid").select("gid", "n", "key", "root", "last")
    large, _ = ranked(members.where("last > 0"), ["gid", "n", "key"], ["gid"], "nth", "dedup-ranked")
    large = large.withColumn("at", F.floor((F.col("nth") - 1) / F.lit(block)).cast("int")).drop("nth")
    dealt = members.where("last = 0").withColumn("at", F.lit(0)).unionByName(large)
    placed = dealt.join(reps.select("key", "sketch"), "key")
    blocks = placed.groupBy("gid", "last", "at").agg(F.array_sort(F.collect_list(F.struct("n", "key", "root", "sketch"))).alias("m"))
    # a block meets itself, and those behind it that begin within reach of its largest size
    spans = large.groupBy("gid", "at").agg(F.min("n").alias("small"), F.max("n").alias("big"))
    x, y = spans.alias("x"), spans.alias("y")
    near = (F.col("x.gid") == F.col("y.gid")) & (F.col("x.at") < F.col("y.at")) & (F.col("y.small") * F.lit(similarity) <= F.col("x.big") + F.lit(1e-6))
    meet = x.join(y, near).select("x.gid", F.col("x.at").alias("i"), F.col("y.at").alias("j"))  # three numbers a pair of blocks
    each = meet.select("gid", "i", "j", F.explode(F.array("i", "j")).alias("at")).join(blocks.where("last > 0"), ["gid", "at"])
    cells = each.groupBy("gid", "i", "j").agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("b"))
    cells = cells.select(F.lit(False).alias("own"), F.col("b")[0]["m"].alias("x"), F.col("b")[1]["m"].alias("y"))
    cells = cells.unionByName(blocks.select(F.lit(True).alias("own"), F.col("m").alias("x"), F.col("m").alias("y")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                x, y = ([batch.column(c)[at].values.field(f) for f in ("n", "key", "root", "sketch")] for c in ("x", "y"))
                a, b = like_pairs(x, y, batch.column("own")[at].as_py(), similarity)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    return cells.mapInArrow(run, "a long, b long").distinct()


def _by_length(sketches: pa.Array) -> list[tuple[int, int, np.ndarray]]:
    """(start, end, matrix): runs of sketches of one length as rows of 64-bit words; they ascend by length."""
    held = sketches.to_pylist()
    sizes = np.array([len(h) // 8 for h in held])
    starts = np.flatnonzero(np.r_[True, sizes[1:] != sizes[:-1]]) if len(held) else []
    return [(int(s), int(e), np.frombuffer(b"".join(held[s:e]), np.uint64).reshape(e - s, -1)) for s, e in zip(starts, [*starts[1:], len(held)])]


def _folded(m: np.ndarray) -> np.ndarray:
    """Sketches of half the length."""
    return np.bitwise_xor(m[:, : m.shape[1] // 2], m[:, m.shape[1] // 2 :])


def like_pairs(x: list[pa.Array], y: list[pa.Array], own: bool, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the pairs of two lists (n, key, root, sketch), ascending by n, whose sizes and sketches allow the similarity.

    own: both lists are the same, each pair counts once. Pairs of one root are passed over.
    """
    (n, k, r), (m, l, q) = ([c.to_numpy() for c in side[:3]] for side in (x, y))
    runs_x, runs_y = _by_length(x[3]), _by_length(y[3])
    halves = {id(mat): _folded(mat) for _, _, mat in runs_y if mat.shape[1] > 1}
    share, left, right = (1 - similarity) / (1 + similarity), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    lo = np.searchsorted(m, n * similarity - 1e-6, "left")
    hi = np.searchsorted(m, n / similarity + 1e-6, "right")
    for first, end, rows in runs_x:
        short = _folded(rows) if rows.shape[1] > 1 else None
        for start, stop, mat in runs_y:
            if mat.shape[1] == rows.shape[1]:
                p, t = rows, mat
            elif mat.shape[1] == 2 * rows.shape[1]:
                p, t = rows, halves[id(mat)]
            elif 2 * mat.shape[1] == rows.shape[1]:
                p, t = short, mat
            else:
                continue  # sizes too far apart
            for i in range(first, end):
                js = np.arange(max(start, lo[i], i + 1 if own else 0), min(stop, hi[i]))
                js = js[(q[js] != r[i]) & (l[js] != k[i])]
                if len(js):
                    apart = np.bitwise_count(t[js - start] ^ p[i - first]).sum(axis=1, dtype=np.int64)
                    js = js[apart <= (n[i] + m[js]) * share + 1e-6]
                    left.append(np.full(len(js), k[i]))
                    right.append(l[js])
    return np.concatenate(left), np.concatenate(right)


def plausible(edges: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """The edges whose sketches allow the similarity: sets x, y that have it differ in (1 - t) / (1 + t) (|x| + |y|) at most."""
    left = edges.join(reps.select(F.col("key").alias("a"), F.col("n").alias("m"), F.col("sketch").alias("x")), "a")
    both = left.join(reps.select(F.col("key").alias("b"), "n", F.col("sketch").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (batch.column("m").to_numpy() + batch.column("n").to_numpy()) * ((1 - similarity) / (1 + similarity)) + 1e-6
            least = [least_difference(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(np.array(least, dtype=np.int64) <= most))

    return both.select("a", "b", "m", "n", "x", "y").mapInArrow(run, "a long, b long").distinct()


def verified(edges: DataFrame, docs: DataFrame, width: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """The edges whose documents' shingle sets have at least the given Jaccard similarity."""
    ends = edges.select(F.col("a").alias("key")).unionByName(edges.select(F.col("b").alias("key"))).distinct()
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("key"), F.col(text_col).alias("text"))
    own = by_ids(own, F.col("key"), cut(ends, "dedup-ends", narrow=True), "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t, width).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.list_(pa.int64()))], ["key", "s"])

    shingles = cut(own.mapInArrow(sets, "key long, s array<long>").dropDuplicates(["key"]), "dedup-shingles")
    left = edges.join(shingles.withColumnsRenamed({"key": "a", "s": "x"}), "a")
    both = left.join(shingles.withColumnsRenamed({"key": "b", "s": "y"}), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            keep = []
            for i in range(batch.num_rows):
                p, q = x[i].values.to_numpy(), y[i].values.to_numpy()
                common = len(np.intersect1d(p, q, assume_unique=True))
                total = len(p) + len(q) - common
                keep.append(common >= similarity * total)  # two texts without words are alike
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns kept, of which one of each near-duplicate group stays: the one of the least id.

    A group is a connected component of links: shingle sets (of words, case of A-Z aside) of the given similarity. Null and blank texts are equal. Rows of one id are one document, of which
    the row of the least text stays; a null id is an id, the least. An empty table stays empty.
    """
    before = cuts_so_far()
    own = cut(profiles(docs, width, similarity, id_col, text_col), "dedup-profiles")
    first = own.groupBy("same").agg(F.min("key").alias("key"))
    reps = own.join(first, ["same", "key"], "left_semi").dropDuplicates(["same"])
    groups = cut(alike(reps), "dedup-groups", narrow=True)
    check = lambda pairs: cut(verified(cut(pairs, "dedup-candidates", narrow=True), docs, width, similarity, id_col, text_col), "dedup-links", narrow=True)
    links = check(plausible(by_fingerprint(reps, similarity).unionByName(with_least(groups, similarity)).distinct(), reps, similarity))
    roots = components(links, "dedup-components")
    more = check(rest(groups, roots, reps, similarity))
    gone = components(links.unionByName(more), "dedup-components").where("node <> root").select(F.col("node").alias("key"))
    copies = own.select("key").join(reps.select("key").distinct(), "key", "left_anti")
    out = cut(gone.unionByName(copies).distinct(), "dedup-gone", narrow=True)
    rows = by_ids(docs, F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)), out, "left_anti")
    once = own.groupBy("key").count().where("count > 1").isEmpty()
    drop_cuts_since(before, out)
    if once:
        return rows
    nth = unused(docs.columns, "nth")
    first = Window.partitionBy(docs[id_col]).orderBy(docs[text_col])
    return rows.withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).drop(nth)
