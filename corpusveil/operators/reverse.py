"""Undo a cleaning run on files that came back.

Returned files: project, path, lang, text. Literals first, then names, then paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusveil.functions import paths
from corpusveil.operators import literals as L
from corpusveil.operators import rename as W
from corpusveil.operators import rules as R

LEDGER_SCHEMA = "dataset_id STRING, mapping_sha256 STRING, ts TIMESTAMP, renamed BIGINT, changed BIGINT"


def reverse_text(
    df: DataFrame, id_cols: list[str], col: str, mappings: DataFrame, dictionary: DataFrame | None, join: bool = False
) -> DataFrame:
    """df with the restored text in `col` and: changed, strings_restored, substitutions."""
    # a digest tells whether a text changed; the text itself need not travel twice
    staged = df.withColumn("_original", F.sha2(F.col(col), 256))
    if dictionary is None:
        staged = staged.withColumn("strings_restored", F.lit(0))
    else:
        staged = L.unmask_literals(staged, id_cols, col, dictionary, count="strings_restored", join=join)
    back = R.content_rules(R.invert_mappings(mappings))
    restored = W.rename_text(staged, id_cols, col, back, count="substitutions", join=join)
    return restored.withColumn("changed", F.sha2(F.col(col), 256) != F.col("_original")).drop("_original")


def leftovers(restored: DataFrame, id_cols: list[str], col: str, has_dictionary: bool) -> DataFrame:
    """Texts with tokens that could not be restored, and why."""
    reason = (
        "unrestorable placeholder(s) left in place"
        if has_dictionary
        else "placeholder(s) found but the mapping has no literals — left as-is"
    )
    found = restored.select(*id_cols, L.leftover_tokens(F.col(col)).alias("tokens"))
    return found.where(F.size("tokens") > 0).select(
        *id_cols, F.lit(reason).alias("reason"), F.array_join("tokens", ", ").alias("tokens")
    )


def target_paths(files: DataFrame, mappings: DataFrame, lang: str) -> DataFrame:
    """(project, path, target) of the files whose path changes when the renaming is undone."""
    back = R.invert_mappings(mappings)
    named = W.rename_path(files.select("project", "path"), ["project", "path"], "path", back, lang, "target")
    return named.where(F.col("target") != F.col("path"))


def rename_plan(files: DataFrame, mappings: DataFrame, lang: str) -> DataFrame:
    """Target path per file to rename, with `collision` true where the target is the path
    of a present file or was taken by an earlier file (deepest path, then path order)."""
    wanted = target_paths(files, mappings, lang)
    present = files.select("project", F.col("path").alias("target")).withColumn("_present", F.lit(True))
    checked = wanted.join(present, ["project", "target"], "left")
    # sorts like (deepest, path); the winner of a target is a plain minimum, no sorting per target
    turn = F.struct((-paths.depth(F.col("path"))).alias("d"), F.col("path").alias("p"))
    winners = wanted.groupBy("project", "target").agg(F.min(turn)["p"].alias("_winner"))
    return checked.join(winners, ["project", "target"]).select(
        "project", "path", "target",
        (F.col("_present").isNotNull() | (F.col("_winner") != F.col("path"))).alias("collision"),
    )


def collisions(plan: DataFrame) -> DataFrame:
    return plan.where("collision").select("project", "path", "target")


def reversal_summary(restored: DataFrame, plan: DataFrame) -> DataFrame:
    """One row per project: files, changed, renamed, collisions, literals and substitutions
    (of changed files only)."""
    texts = restored.groupBy("project").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if("changed").alias("n_changed"),
        F.sum(F.when(F.col("changed"), F.col("strings_restored")).otherwise(0)).alias("strings_restored"),
        F.sum(F.when(F.col("changed"), F.col("substitutions")).otherwise(0)).alias("substitutions"),
    )
    moves = plan.groupBy("project").agg(
        F.count_if(~F.col("collision")).alias("n_renamed"), F.count_if("collision").alias("n_collisions")
    )
    none = F.lit(0).cast("bigint")
    return texts.join(moves, "project", "left").select(
        "project", "n_files", "n_changed",
        F.coalesce("n_renamed", none).alias("n_renamed"),
        F.coalesce("n_collisions", none).alias("n_collisions"),
        "strings_restored", "substitutions",
    )


def apply_plan(restored: DataFrame, plan: DataFrame) -> DataFrame:
    """Restored files under their final paths; collisions keep their path."""
    moves = plan.where(~F.col("collision")).select("project", "path", "target")
    return restored.join(moves, ["project", "path"], "left").withColumn(
        "path", F.coalesce("target", "path")
    ).drop("target")


def pending_reversals(batch: DataFrame, ledger: DataFrame, force: bool = False, dry_run: bool = False) -> DataFrame:
    """Datasets of the batch (dataset_id, mapping_sha256) that may be reversed now: not
    those already reversed with the same mapping, unless forced or on a dry run."""
    if force or dry_run:
        return batch
    # only the last reversal of a dataset counts
    last = ledger.groupBy("dataset_id").agg(F.max_by("mapping_sha256", "ts").alias("mapping_sha256"))
    return batch.join(last, ["dataset_id", "mapping_sha256"], "left_anti")


def append_ledger(summary: DataFrame, path: str) -> None:
    """Record finished reversals (dataset_id, mapping_sha256, renamed, changed). Nothing is
    recorded for datasets without files: they have no summary row."""
    summary.select(
        "dataset_id", "mapping_sha256", F.current_timestamp().alias("ts"),
        F.col("renamed").cast("bigint").alias("renamed"), F.col("changed").cast("bigint").alias("changed"),
    ).write.mode("append").parquet(path)
