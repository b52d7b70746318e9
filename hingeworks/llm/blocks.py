"""Deal a whole table into blocks of ascending id, without one task ever seeing more than a block."""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hingeworks.llm.common import BLOCK_BYTES, MOST_TASKS, NO_ID, block_bounds, input_bytes, shuffle_width, text_batches


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, id, text): key orders null ids first; a null text becomes empty."""
    text_batches(docs.sparkSession)
    i = F.col(id_col).cast("long")
    return docs.select(F.coalesce(i, F.lit(NO_ID)).alias("key"), i.alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def bounds_of(own: DataFrame) -> list[int]:
    """First keys of the blocks; reads the id column alone. As many blocks as shuffle partitions, or more if they would exceed BLOCK_BYTES."""
    return block_bounds(own.select("key"), max(shuffle_width(own.sparkSession), min(input_bytes(own) // BLOCK_BYTES, MOST_TASKS)))


def block_of(bounds: list[int], keys: list[int]) -> list[int]:
    return [bisect_right(bounds, k) - 1 for k in keys]


def with_next(own: DataFrame, bounds: list[int]) -> DataFrame:
    """(pid, wrap, own, key, id, text), dealt by block and sorted: each row's successor is the next row.

    The rows that open a block also close the block before it with own = false (those that open the first block close
    the last, with wrap = true), so the successor of a block's last row is there too. Rows of equal ids go by text.
    """
    n = len(bounds)

    def spread(batches):
        for batch in batches:
            keys = batch.column("key").to_pylist()
            pids = block_of(bounds, keys)
            opens = [i for i, k in enumerate(keys) if bounds[pids[i]] == k]
            take = pa.array([*range(len(keys)), *opens], pa.int64())
            pid = pa.array([*pids, *((pids[i] - 1) % n for i in opens)], pa.int32())
            wrap = pa.array([False] * len(keys) + [pids[i] == 0 for i in opens], pa.bool_())
            mine = pa.array([True] * len(keys) + [False] * len(opens), pa.bool_())
            rest = [batch.column(c).take(take) for c in ("key", "id", "text")]
            yield pa.RecordBatch.from_arrays([pid, wrap, mine, *rest], ["pid", "wrap", "own", "key", "id", "text"])

    dealt = own.mapInArrow(spread, "pid int, wrap boolean, own boolean, key long, id long, text string")
    return dealt.repartitionById(max(1, n), F.col("pid")).sortWithinPartitions("pid", "wrap", "key", "text")
