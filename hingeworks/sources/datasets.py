"""Data sets as (row_id, dataset, variant, features, label) tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The four variants of a data set, by ordinal, and their display names.
VARIANTS = ("original", "noise", "outlier", "both")
VARIANT_NAMES = ("Not noise", "Noise", "Outlier", "Noise + Outlier")


class DatasetMissing(Exception):
    """A data set's file can't be read."""


@dataclass(frozen=True)
class DatasetSpec:
    """How to read one delimited file: where its features and label are, and which labels are positive."""

    name: str
    n_features: int
    first_feature: int = 0
    label_at: int = -1  # behind the features
    positive: str | None = None  # this letter is +1; None: any non-zero number is
    header: bool = False
    sep: str = ","

    @property
    def label_index(self) -> int:
        return self.first_feature + self.n_features if self.label_at < 0 else self.label_at

    @property
    def width(self) -> int:
        return max(self.first_feature + self.n_features, self.label_index + 1)

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(self.width)])


#: Separators, positions and label rules of the six sets.
REGISTRY = {
    s.name: s
    for s in (
        DatasetSpec("wdbc", 30, first_feature=2, label_at=1, positive="M"),
        DatasetSpec("diabetes", 8, header=True),
        DatasetSpec("cleveland", 13, header=True),
        DatasetSpec("ionosphere", 34, positive="g"),
        DatasetSpec("sonar", 60, positive="M"),
        DatasetSpec("australia", 14),
    )
}


def spec_for(dataset: str, variant: str = "original") -> DatasetSpec:
    """The registered spec; the original australia file is separated by blanks."""
    spec = REGISTRY[dataset]
    if dataset == "australia" and variant == "original":
        return DatasetSpec(**(spec.__dict__ | {"sep": " "}))
    return spec


def variant_name(ordinal: Column) -> Column:
    """Display name of a file by its ordinal; anything past the third is the mixture."""
    return F.when(ordinal == 0, VARIANT_NAMES[0]).when(ordinal == 1, VARIANT_NAMES[1]).when(ordinal == 2, VARIANT_NAMES[2]).otherwise(VARIANT_NAMES[3])


def display_name(variant: Column) -> Column:
    """Display name of a variant key; Unknown for others."""
    pairs = [F.lit(x) for kv in zip(VARIANTS, VARIANT_NAMES) for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), variant), F.lit("Unknown"))


def encode_label(label: Column, positive: str | None = None, keep_others: bool = False) -> Column:
    """+1 for the positive value (or any non-zero number), else -1.

    keep_others maps 0 to -1 and leaves every other number as it is.
    """
    if positive is not None:
        return F.when(label == positive, 1).otherwise(-1)
    number = label.cast("double")
    return F.when(number == 0, -1).otherwise(number.cast("int") if keep_others else F.lit(1))


def scan(spark: SparkSession, path: str, spec: DatasetSpec, variant: str = "original", on_missing: str = "raise", keep_others: bool = False, lenient: bool = False) -> DataFrame | None:
    """Read a file as (row_id, dataset, variant, features, label). Bad numbers raise, or become null if lenient.

    path is a file or a folder of files; row_id is the position in the order of files and lines, however many tasks read.
    """
    try:
        raw = spark.read.csv(path, schema=spec.schema(), header=spec.header, sep=spec.sep)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        if on_missing == "skip":
            return None
        raise DatasetMissing(f"{spec.name}/{variant}: {path}") from e
    number = (lambda c: F.expr(f"try_cast({c} AS DOUBLE)")) if lenient else (lambda c: F.col(c).cast("double"))
    features = F.array(*[number(f"_c{i}") for i in range(spec.first_feature, spec.first_feature + spec.n_features)])
    label = encode_label(F.col(f"_c{spec.label_index}"), spec.positive, keep_others)
    with_id = in_file_order(raw.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block")))
    return with_id.select("row_id", F.lit(spec.name).alias("dataset"), F.lit(variant).alias("variant"), features.alias("features"), label.cast("int").alias("label"))


def in_file_order(rows: DataFrame) -> DataFrame:
    """row_id from 0 by file (by path), block of the file and line, for rows with the columns __file and __block.

    A block is read by one task in the order of its lines, so a row's place is its place in the block behind the rows of
    the blocks before; no more than a count a block is gathered.
    """
    by = ["__file", "__block"]
    read = rows.withColumn("__line", F.monotonically_increasing_id())
    before = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).select(*by, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))  # a row a block
    placed = read.join(F.broadcast(starts), by).withColumn("row_id", F.col("__start") + F.row_number().over(Window.partitionBy(*by).orderBy("__line")) - 1)
    return placed.drop(*by, "__line", "__start")


def named_features(df: DataFrame, label: str, name: str = "Target", features: list[str] | None = None) -> DataFrame:
    """The label first, as `name`, then the other columns (or the given ones) as Feature_1, Feature_2 and so on."""
    rest = features if features is not None else [c for c in df.columns if c != label]
    return df.select(F.col(f"`{label}`").alias(name), *[F.col(f"`{c}`").alias(f"Feature_{i}") for i, c in enumerate(rest, 1)])


def target_last(df: DataFrame, label: str, name: str = "Target", drop: tuple[str, ...] = ()) -> DataFrame:
    """The label renamed and moved behind all other columns; columns in drop (such as ids) go."""
    rest = [c for c in df.columns if c != label and c not in drop]
    return df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{label}`").alias(name))


def features_of(df: DataFrame, key: Column, columns: list[str], label: Column, dataset: str, variant: str = "original") -> DataFrame:
    """Any table as a data set, by a natural key."""
    features = F.array(*[F.col(c).cast("double") for c in columns])
    return df.select(key.alias("row_id"), F.lit(dataset).alias("dataset"), F.lit(variant).alias("variant"), features.alias("features"), label.cast("int").alias("label"))


def perturbed(df: DataFrame, key: Column, columns: list[str], label: str, variant: str, every: int = 20, factor: float = 10.0) -> DataFrame:
    """A deterministic variant: noise flips the label of every `every`-th key, outlier multiplies its features, both does both."""
    hit = F.pmod(key, F.lit(every)) == 0
    out = df
    if variant in ("noise", "both"):
        out = out.withColumn(label, F.when(hit, -F.col(label)).otherwise(F.col(label)))
    if variant in ("outlier", "both"):
        out = out.withColumns({c: F.when(hit, F.col(c) * factor).otherwise(F.col(c)) for c in columns})
    return out


def lineitem_problem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tall problem on the test tables: five numbers of a line item; +1 if it was returned."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select(
        "l_orderkey",
        F.col("l_linenumber").cast("long").alias("l_linenumber"),
        F.col("l_quantity").alias("f1"),
        (F.col("l_extendedprice") / 1000).alias("f2"),
        F.col("l_discount").alias("f3"),
        F.col("l_tax").alias("f4"),
        F.col("l_linenumber").cast("double").alias("f5"),
        encode_label(F.col("l_returnflag"), "R").alias("label"),
    )


FEATURES = ["f1", "f2", "f3", "f4", "f5"]
