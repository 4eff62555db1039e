"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a skewed join may be split even where that costs one more shuffle after it
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # text rows are wide and regex work is CPU bound: keep scan tasks small
    "spark.sql.files.maxPartitionBytes": "32m",
}


#: Rows whose running sum one window makes.
RUN = 1 << 16


def build_session(name: str = "corpusveil", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this package is tuned for."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir.

    Only a local session may go without the setting (then a temporary folder is
    made); on a cluster a machine-local folder would be lost with its machine.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    made = tempfile.mkdtemp(prefix="corpusveil-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, as --py-files would, for
    sessions that were started without it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    packed = Path(tempfile.mkdtemp(prefix="corpusveil-")) / "corpusveil.zip"
    with zipfile.ZipFile(packed, "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, file.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(packed))
    _shipped.add(app)


def parallelism(spark: SparkSession) -> int:
    """Tasks for work that is heavy per byte: every core, or more if the session says so."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def new_table_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/corpusveil/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write df once to the shared folder and read it back.

    Cuts the lineage, survives the loss of executors and computes df once
    (checkpoint() would compute it twice).
    """
    spark = df.sparkSession
    path = new_table_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucket_count(spark: SparkSession) -> int:
    """Buckets of a table that is joined without being moved: as many as a shuffle has parts, so
    that what was grouped by the keys meets them as it is."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_bucketed(
    df: DataFrame, name: str, path: str, keys: list[str], parts: list[str] | None = None, buckets: int | None = None
) -> None:
    """Add df to a table of the catalog that is bucketed by `keys`, with its files below `path` in
    the shared folder. df should be partitioned by the keys, else each task writes to each bucket."""
    spark = df.sparkSession
    out = df.write.mode("append").format("parquet").option("path", path).bucketBy(buckets or bucket_count(spark), *keys)
    (out.partitionBy(*parts) if parts else out).saveAsTable(name)
    spark.catalog.refreshTable(name)


def read_or_first(spark: SparkSession, schema, path: str, first: bool) -> DataFrame:
    """The stored table; where nothing is stored yet an empty one, but only if this is declared
    to be the first run. A moved or mistyped path must not pass for a new beginning."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if not first or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def number_rows(df: DataFrame, order: list, column: str, start: int = 0) -> DataFrame:
    """Number all rows densely from `start` in the given total order, without one task
    seeing them all: range sort, position within partition, partition offsets.

    The positions are written with the rows, so the second pass over them cannot
    disagree with the first. Offsets are one row per partition.
    """
    sorted_df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(
        sorted_df.withColumn("_part", F.spark_partition_id()).withColumn(
            "_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        ),
        column,
    )
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # at most one row per shuffle partition, so one array holds all offsets
    ordered = sizes.agg(F.array_sort(F.collect_list(F.struct("_part", "_n"))).alias("_sizes"))
    offsets = ordered.select(
        F.explode(
            F.transform(
                "_sizes",
                lambda s, i: F.struct(
                    s["_part"].alias("_part"),
                    F.aggregate(
                        F.slice(F.col("_sizes"), F.lit(1), i),
                        F.lit(start).cast("bigint"),
                        lambda acc, x: acc + x["_n"],
                    ).alias("_base"),
                ),
            )
        ).alias("_o")
    ).select("_o.*")
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(column, F.col("_base") + F.col("_pos"))
        .drop("_part", "_pos", "_base")
    )


def running_sums(df: DataFrame, order: list, value: str, place: str, before: str) -> DataFrame:
    """df with each row's position in the total order and the sum of `value` over the rows before
    it, without one task seeing all rows: as number_rows, with partial sums per partition."""
    numbered = number_rows(df, order, place)
    stored = materialize(numbered.withColumn("_part", F.floor(F.col(place) / RUN)), before)
    within = Window.partitionBy("_part").orderBy(place)
    sums = stored.groupBy("_part").agg(F.sum(value).alias("_s"))
    # a row for each RUN rows: they are summed up the same way until few are left
    few = sums.limit(RUN + 1).count() <= RUN
    if few:
        bases = sums.select("_part", (F.sum("_s").over(Window.orderBy("_part")) - F.col("_s")).alias("_base"))
    else:
        bases = running_sums(sums.withColumnRenamed("_part", "_of"), ["_of"], "_s", "_place", "_begin").select(F.col("_of").alias("_part"), F.col("_begin").alias("_base"))
    return (
        stored.withColumn("_own", F.sum(value).over(within) - F.col(value)).join(bases, "_part")
        .withColumn(before, F.col("_base") + F.col("_own")).drop("_part", "_own", "_base")
    )
