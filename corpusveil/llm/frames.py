"""DataFrame helpers of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusveil.session import materialize, ship_package

#: Rows of an Arrow batch; Spark's default of 10,000 is meant for rows without texts.
ARROW_ROWS = 1000
#: Bytes of an Arrow batch: a batch ends early where texts are long.
ARROW_BYTES = 4 << 20

#: Slots of the filter that is broadcast before a large table is shuffled: at most so many longs.
SLOTS = 1 << 20


def prepare(spark: SparkSession) -> None:
    """Package on the executors, and Arrow batches that fit a worker's memory with whole texts."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def only_keys(df: DataFrame, key: str, keys: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The rows of df whose key may be among `keys` (a column of the same name): all that are,
    and a few others whose hash falls in a taken slot. The broadcast side holds one long for
    each taken slot, so its size does not grow with the data. A join on the key must follow."""
    slot = F.pmod(F.xxhash64(key), F.lit(slots))
    taken = keys.select(slot.alias("_slot")).distinct()
    return df.withColumn("_slot", slot).join(F.broadcast(taken), "_slot", "left_semi").drop("_slot")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the undirected edges (a, b): comp is the smallest node
    that its links reach. Labels travel along edges and then jump to their own label, so
    the rounds grow with the logarithm of a component's width. A round is a stored table."""
    both = materialize(
        edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "links",
    )
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = both.join(labels, both.a == labels.node).select(F.col("b").alias("node"), "comp")
        least = labels.unionByName(near).groupBy("node").agg(F.min("comp").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("_up"))
        old = labels.select("node", F.col("comp").alias("_old"))
        fresh = materialize(
            least.join(up, "comp", "left").join(old, "node")
            .select("node", F.least("comp", F.coalesce("_up", "comp")).alias("comp"), "_old"),
            "labels",
        )
        labels = fresh.select("node", "comp")
        if fresh.where("comp <> _old").isEmpty():
            return labels
