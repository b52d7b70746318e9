"""Mixing sources to target weights by systematic sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hingeworks.llm.common import WORD, cut, cuts_so_far, drop_cuts_since, ranked, shuffle_width, unused

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2, "mix"


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offset(source: Column, seed: str) -> Column:
    """A source's one random offset in [0, 1), a function of seed and name; null is a name of its own."""
    name = F.when(source.isNull(), F.lit(f"{seed}-null")).otherwise(F.concat(F.lit(f"{seed}:"), source))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Rows (source, source_size, n_docs, weight, target) from (source, size) rows.

    Sources take the weights in turn, by code point, null last. `share` times all sizes is spread by weight; a target
    stops at `most` times its source's size, and the excess is spread again over the rest: the level L for which the
    sum of min(most * size, L * weight) meets the total, found by raising L until no further source stops. A round
    is one aggregation whose two sums reach the driver.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = [F.col("source").isNull(), F.col("source"), F.col("source_size")]
    placed, _ = ranked(totals.withColumn("all", F.lit(0)), [F.col("all"), *order], ["all"], "place", "mix-sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    placed = cut(placed.select("source", "source_size", "n_docs", weight.alias("weight")), "mix-weights", narrow=True)
    row = placed.agg(F.sum("source_size"), F.sum("weight")).first()
    total, open_weight, stopped = share * (row[0] or 0), row[1] or 0, 0
    cap = F.col("source_size") * most
    level = total / open_weight if open_weight else 0.0
    while open_weight:
        full = cap <= F.lit(level) * F.col("weight")
        row = placed.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if row[0] == stopped and row[1] == open_weight or not row[1]:
            break
        stopped, open_weight = row
        level = (total - stopped) / open_weight
    return placed.withColumn("target", F.least(cap.cast("double"), F.lit(float(level)) * F.col("weight")))


def systematic_copies(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """(id, source, size) rows with source_size, target and copies, the times that the mix emits the row.

    Within a source, ordered by size and id so that neighbours weigh about the same, every document expects
    target / source_size copies; with their prefix sum c and the source's offset u, it is emitted once for each integer
    in (c_before + u, c + u]. No document is emitted more than `most` (rounded up) times, and reruns agree. Null
    sources form a source; sources of size 0 have target 0; an empty table gives no rows.
    """
    own = sized.select("id", "source", "size").repartition(shuffle_width(sized.sparkSession))  # the scan keeps its tasks, the rows are few numbers
    own = cut(own, "mix-sizes", narrow=True)
    targets = source_targets(own.select("source", "size"), weights, share, most)
    order = [F.col("source").isNull(), F.col("source"), F.col("size"), F.col("id")]
    rows, _ = ranked(own, order, ["source"], "rank", "mix-ranks")
    t = targets.select(F.col("source").alias("s"), "source_size", "target")
    joined = rows.join(t, F.col("source").eqNullSafe(F.col("s")))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = offset(F.col("source"), seed)
    copies = F.floor(F.col("rank") * each + u) - F.floor((F.col("rank") - 1) * each + u)
    return joined.select("id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs, all columns kept whatever their names, each as often as the mix takes it.

    Repeated rows are told apart by counting them on both sides, which costs a shuffle only where an id repeats.
    """
    before = cuts_so_far()
    key, words, nth_row, copy = (unused(docs.columns, x) for x in ("key", "words", "nth", "copy"))
    keyed = docs.withColumns({key: F.col(id_col).cast("long"), words: word_count(F.col("text"))})
    mixed = systematic_copies(keyed.select(F.col(key).alias("id"), "source", F.col(words).alias("size")), **options)
    mixed = cut(mixed.select("id", F.col("source").alias("__source"), "size", F.col("copies").cast("int").alias("__copies")), "mix-copies", narrow=True)
    drop_cuts_since(before, mixed)
    same = keyed[key].eqNullSafe(mixed["id"])
    if not mixed.groupBy("id").count().where("count > 1").isEmpty():
        nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*by))
        mixed = mixed.withColumn("__k", nth("id", "__source", "size"))
        keyed = keyed.withColumn(nth_row, nth(key, "source", words))
        same = keyed[key].eqNullSafe(mixed["id"]) & keyed["source"].eqNullSafe(mixed["__source"]) & (keyed[words] == mixed["size"]) & (keyed[nth_row] == mixed["__k"])
    taken = keyed.join(mixed.where("__copies > 0").hint("merge"), same)
    return taken.select(*[keyed[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(1), mixed["__copies"])).alias(copy)).drop(copy)


def op7_source_mixing(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken over all `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select(F.col("doc_id").cast("long").alias("id"), "source", word_count(F.col("text")).alias("size"))
    mixed = systematic_copies(sized)
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY (source IS NULL), encode(source)) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, coalesce(sum(2 * source_size) OVER w, 0)::BIGINT AS before, (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::BIGINT AS open_weight,
         row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source) AS k,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total
  FROM s WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT (total - before) / open_weight AS level FROM r WHERE 2 * source_size > (total - before) / open_weight * weight ORDER BY k LIMIT 1
), t AS (
  SELECT source, source_size, least((2 * source_size)::DOUBLE, coalesce((SELECT level FROM l), 0)::DOUBLE * weight) AS target,
         ('0x' || substr(md5(CASE WHEN source IS NULL THEN 'mix-null' ELSE 'mix:' || source END), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM s
), k AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, d.source, t.u,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id)::DOUBLE AS rank,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS each
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (floor(rank * each + u) - floor((rank - 1) * each + u))::BIGINT * size AS taken,
       source, (floor(rank * each + u) - floor((rank - 1) * each + u))::BIGINT AS copies
FROM k
"""
