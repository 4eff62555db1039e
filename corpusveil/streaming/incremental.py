"""Clean files as they arrive, with a dictionary that only ever grows.

The dictionary is a folder of Parquet parts, one per micro-batch. A batch numbers the
literals that earlier batches do not have and writes part `batch_id`; when a batch is
replayed after a failure it reads the parts before it only and overwrites its own, so
numbers are never given twice and never reused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusveil.operators import literals as L
from corpusveil.operators import sanitize as S
from corpusveil.session import materialize, read_or_first


def read_dictionary(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The stored dictionary; with `before`, as it was before that batch. Only before batch 0
    may there be none: numbering must not start again because a path has moved."""
    schema = L.DICTIONARY_SCHEMA + ", batch_id BIGINT"
    stored = read_or_first(spark, schema, path, before == 0)
    if before is not None:
        stored = stored.where(F.col("batch_id") < before)
    return stored.drop("batch_id")


def extend_dictionary(spark: SparkSession, literals: DataFrame, order: list[str], path: str, batch_id: int) -> DataFrame:
    """Store the literals that are new in this batch; the entries of all its literals."""
    known = read_dictionary(spark, path, batch_id)
    grown = L.build_dictionary(literals, order, known)
    fresh = grown.join(known.select("token"), "token", "left_anti")
    fresh.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")
    wanted = literals.select("literal").distinct()
    return read_dictionary(spark, path, batch_id + 1).join(wanted, "literal", "left_semi")


def clean_batch(
    batch: DataFrame, batch_id: int, id_cols: list[str], col: str, mappings: DataFrame, options: S.Options,
    lang, order: list[str], dictionary_path: str, out_path: str,
) -> None:
    """One micro-batch: extend the dictionary, then write the cleaned texts of the batch."""
    spark = batch.sparkSession
    staged = S.before_mask(batch, id_cols, col, mappings, options, lang)
    if options.mask_strings:
        staged = materialize(staged, "renamed")
        keys = list(dict.fromkeys([*id_cols, *order]))
        found = L.extract_literals(staged, keys, col, lang)
        dictionary = extend_dictionary(spark, found, [*order, "pos"], dictionary_path, batch_id)
        staged = L.mask_literals(staged, id_cols, col, lang, dictionary)
    S.after_mask(staged, col, options, lang).write.mode("overwrite").parquet(
        f"{out_path.rstrip('/')}/batch_id={batch_id}"
    )


def sanitize_stream(
    stream: DataFrame, id_cols: list[str], col: str, mappings: DataFrame, options: S.Options, lang, order: list[str],
    dictionary_path: str, out_path: str, checkpoint: str, once: bool = True,
) -> StreamingQuery:
    """Start cleaning a stream of texts; `once` processes what is there and stops."""
    def run(batch: DataFrame, batch_id: int) -> None:
        clean_batch(batch, batch_id, id_cols, col, mappings, options, lang, order, dictionary_path, out_path)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
