"""Reverse a returned corpus: ledger check, snapshot, staged texts and paths, summary, files, ledger.

What is reversed is staged beside the ledger and announced by one row of a log of stages. Files go
out of the stage only; then the ledger is told and the stage closed. A run that finds an open stage
takes up there, so a reversal that broke off is neither lost nor done to files already reversed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from corpusveil.operators import reverse as V
from corpusveil.operators import rules as R
from corpusveil.session import new_table_path, read_or_first
from corpusveil.sources.files import snapshot


STAGES_SCHEMA = "dataset_id string, mapping_sha256 string, stage string, snapshot string, state string"


@dataclass
class Reversal:
    refused: bool
    files: DataFrame | None = None
    plan: DataFrame | None = None
    leftovers: DataFrame | None = None
    summary: DataFrame | None = None
    snapshot_path: str | None = None


def log_stage(batch: DataFrame, folder: str, stage: str, saved: str | None, state: str) -> None:
    """Announce one state of a stage: one row in one file, seen whole or not at all."""
    batch.select(
        "dataset_id", "mapping_sha256", F.lit(stage).alias("stage"), F.lit(saved).cast("string").alias("snapshot"), F.lit(state).alias("state")
    ).coalesce(1).write.mode("append").parquet(f"{folder}/log")


def open_stage(batch: DataFrame, folder: str) -> Row | None:
    """The stage of this dataset and mapping that was announced and not closed, if there is one.
    Runs of one dataset must not overlap, so there is at most one."""
    log = read_or_first(batch.sparkSession, STAGES_SCHEMA, f"{folder}/log", True)
    closed = log.where("state = 'closed'").select("stage")
    return log.where("state = 'staged'").join(batch, ["dataset_id", "mapping_sha256"], "left_semi").join(closed, "stage", "left_anti").first()


def restore(
    files: DataFrame,
    dataset_id: str,
    mappings: DataFrame,
    dictionary: DataFrame | None,
    lang: str,
    ledger_path: str,
    snapshot_base: str | None = None,
    dry_run: bool = False,
    force: bool = False,
    sink: Callable[[DataFrame], object] | None = None,
    first_run: bool = False,
) -> Reversal:
    """Reverse one dataset and hand its files to `sink`, which writes them. Only then is the
    ledger told. If a step fails, run the job again, with `first_run` if the ledger was not written
    yet: it hands the staged files to `sink` once more, which must therefore overwrite, and reads
    `files` only for a snapshot the first run was not asked for. A forced run also finishes an open stage first; force again to reverse anew.

    A second run with the same mapping is refused unless forced. A missing ledger is an error
    unless `first_run` says that there is none yet. A dry run computes everything, needs no
    sink and writes neither snapshot nor files nor ledger."""
    if sink is None and not dry_run:
        raise ValueError("a reversal needs a sink for its files")
    spark = files.sparkSession
    keyed = mappings.withColumn("set_id", F.lit(dataset_id))
    lits = None if dictionary is None else dictionary.withColumn("set_id", F.lit(dataset_id))
    batch = R.mapping_fingerprint(keyed, lits).withColumnRenamed("set_id", "dataset_id")
    # a dry or forced run asks the ledger nothing
    ledger = read_or_first(spark, V.LEDGER_SCHEMA, ledger_path, first_run or dry_run or force)
    if V.pending_reversals(batch, ledger, force, dry_run).isEmpty():
        return Reversal(refused=True)
    folder = f"{ledger_path.rstrip('/')}-stages"
    begun = None if dry_run else open_stage(batch, folder)
    if begun:
        stage, saved = begun.stage, begun.snapshot
        if snapshot_base and saved is None:
            saved = snapshot(files, snapshot_base)
    else:
        stage = new_table_path(spark, "reversal") if dry_run else f"{folder}/{uuid.uuid4().hex}"
        saved = snapshot(files, snapshot_base, dry_run=dry_run) if snapshot_base else None
        V.reverse_text(files, ["project", "path"], "text", mappings, dictionary).write.parquet(f"{stage}/restored")
        V.rename_plan(files, mappings, lang).write.parquet(f"{stage}/renames")
        if not dry_run:
            log_stage(batch, folder, stage, saved, "staged")
    restored, plan = spark.read.parquet(f"{stage}/restored"), spark.read.parquet(f"{stage}/renames")
    left = V.leftovers(restored, ["project", "path"], "text", dictionary is not None)
    summary = V.reversal_summary(restored, plan)
    moved = V.apply_plan(restored, plan)
    if not dry_run:
        sink(moved)
        totals = summary.groupBy(F.lit(dataset_id).alias("dataset_id")).agg(
            F.sum("n_renamed").alias("renamed"), F.sum("n_changed").alias("changed")
        )
        V.append_ledger(batch.join(totals, "dataset_id"), ledger_path)
        log_stage(batch, folder, stage, saved, "closed")
    return Reversal(False, moved, plan, left, summary, saved)
