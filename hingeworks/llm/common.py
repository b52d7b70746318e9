"""Shared pieces of the training-data operators: lineage cuts, ordered blocks, connected components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of a text: maximal runs of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Sorts before any real id; stands for a null id where ids are ordered.
NO_ID = -(1 << 63)
#: Code points that one vectorised step works on at most (one longer text is a step of its own).
STEP_CHARS = 1_500_000
#: Ids that a filter broadcasts at most.
BROADCAST_IDS = 2_000_000
#: Bytes of a plan's inputs for each further task that writes a narrow table; bytes of a block of ordered ids; tasks at most.
NARROW_BYTES, BLOCK_BYTES, MOST_TASKS = 16_000_000, 64_000_000, 100_000
#: Texts that go to Python at a time.
TEXT_ROWS = 1_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the checkpoint folder set in code.

    With neither, a local session gets a fresh temporary folder; a cluster session is refused,
    because machine-local folders are invisible to other executors.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="hingeworks-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def input_bytes(df: DataFrame) -> int:
    """The size of what a plan reads, by the optimiser."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def kept_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for files of an operator's own; it is removed at the end of the driver's process."""
    path = fresh_path(spark, name)
    _cuts[path] = (spark._jvm, spark._jsc.hadoopConfiguration(), None)
    return path


def cut(df: DataFrame, name: str, narrow: bool = False, dense: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor costs nothing.

    narrow: rows of a few numbers each, written by a task a core rather than as a file a partition, or by more if the
    size of what the plan reads asks for it. dense: packed more tightly, for tables that are large beside the input.
    """
    spark = df.sparkSession
    if narrow:
        df = df.coalesce(min(max(spark.sparkContext.defaultParallelism, input_bytes(df) // NARROW_BYTES), MOST_TASKS))
    path = fresh_path(spark, name)
    _cuts[path] = (spark._jvm, spark._jsc.hadoopConfiguration(), threading.get_ident())
    df.write.parquet(path, compression="zstd" if dense else None)
    back = spark.read.schema(df.schema).parquet(path)
    back._cut_path = path
    return back


#: Cuts that still have files, in the order of their making, each with the thread that made it.
_cuts: dict[str, tuple] = {}


def _drop(path: str) -> None:
    jvm, conf, _ = _cuts.pop(path)
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


@atexit.register
def _drop_all() -> None:
    """What results that were never written still read goes with the driver's process."""
    for path in list(_cuts):
        with contextlib.suppress(Exception):  # the JVM may be gone
            _drop(path)


def drop_cut(df: DataFrame) -> None:
    """Remove the files of a cut that nothing reads any more."""
    if (path := getattr(df, "_cut_path", None)) in _cuts:
        _drop(path)


def _own() -> list[str]:
    """Cuts of this thread; an operator runs in one, so those of operators beside it aren't among them."""
    return [p for p, (_, _, thread) in list(_cuts.items()) if thread == threading.get_ident()]


def cuts_so_far() -> set[str]:
    return set(_own())


def drop_cuts_since(before: set[str], *kept: DataFrame) -> None:
    """Remove the files of all cuts that this thread made since `before` but those of `kept`, when nothing else reads them any more."""
    keep = {getattr(df, "_cut_path", None) for df in kept}
    for path in [p for p in _own() if p not in before and p not in keep]:
        _drop(path)


def text_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in Arrow batches of 1,000, so that a worker and its executor hold a few MB of them."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > TEXT_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXT_ROWS))


def unused(columns: list[str], name: str) -> str:
    """A column name that no column has, case aside."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def by_ids(docs: DataFrame, key: Column, ids: DataFrame, how: str) -> DataFrame:
    """docs with (left_semi) or without (left_anti) the keys in the written one-column table ids.

    Up to BROADCAST_IDS ids are broadcast, at 8 bytes each, and no text moves; more are merged by a shuffle.
    """
    name = ids.columns[0]
    ids = ids.select(F.col(name).alias("__only"))
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")
    return docs.join(ids, key == F.col("__only"), how)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def steps(sizes: Iterable[int], most: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes sum to at most `most`; a larger item is alone."""
    start = total = end = 0
    for end, n in enumerate(sizes, 1):
        if total and total + n > most:
            yield start, end - 1
            start, total = end - 1, 0
        total += n
    if end > start:
        yield start, end


def coded_words(split: pa.ListArray) -> tuple[list[str], Callable[[list[bytes]], list[bytes]]]:
    """The distinct words of some texts, told apart in Arrow, and what joins their codes back to texts.

    Given a code for each distinct word, the second part returns the joined codes of each text.
    """
    coded = split.flatten().dictionary_encode()

    def joined(codes: list[bytes]) -> list[bytes]:
        if not len(split):
            return []
        flat = pa.array(codes, pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1, 8 * flat.offset)
        data = memoryview(flat.buffers()[2] or b"")
        at = ends[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        return [data[a:b].tobytes() for a, b in zip(at, at[1:])]

    return coded.dictionary.to_pylist(), joined


def block_bounds(keys: DataFrame, blocks: int) -> list[int]:
    """Distinct values of the one long column that start about equal blocks, ascending; the first is the minimum.

    At most `blocks` values reach the driver, whatever the number of rows.
    """
    name = keys.columns[0]
    at = [i / blocks for i in range(blocks)]
    row = keys.agg(
        F.min(name).alias("least"),
        F.percentile_approx(name, F.array(*[F.lit(x) for x in at]), F.lit(max(10_000, 10 * blocks))).alias("cuts"),
    ).first()
    if row.least is None:
        return []
    return sorted({row.least, *row.cuts})


def ranked(df: DataFrame, order: list, by: list[str], rank: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Add a 1-based rank within groups without putting a group into one task.

    Rows are dealt by ranges of `order` (which must start with the group), so that a hot group covers
    many partitions; the rank is a row number within partition and group plus the count of that group
    in earlier partitions. Null group values form a group. Returns the ranked rows and the written rows.
    """
    spark = df.sparkSession
    n = shuffle_width(spark)
    keys = [f"__g{i}" for i in range(len(by))]
    dealt = df.repartitionByRange(n, *order).withColumn("__pid", F.spark_partition_id())
    dealt = cut(dealt.withColumns({k: F.struct(F.col(c).alias("v")) for k, c in zip(keys, by)}), name, narrow=True)
    counts = dealt.groupBy("__pid", *keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__pid", *keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__pid", *keys).orderBy(*order)
    out = dealt.join(starts, ["__pid", *keys]).withColumn(rank, F.col("__before") + F.row_number().over(within))
    return out.drop("__pid", "__before", *keys), dealt


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges (a, b) of one orderable type: rows (node, root), root the least node.

    Alternates large-star and small-star steps; each step is a grouped minimum and an equi-join, each round is
    written to the shared folder, and only two numbers a round reach the driver. Self-loops are ignored.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name, narrow=True)
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        kept = large.join(low, "a")
        small = kept.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = cut(small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), name, narrow=True)
        drop_cut(now)
        now = after
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)

