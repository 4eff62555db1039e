"""Checks on whole corpora: nothing leaked, everything comes back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusveil.functions import paths
from corpusveil.functions.columns import let
from corpusveil.functions.text import strip_spaces
from corpusveil.operators.rename import rename_text
from corpusveil.session import materialize

#: A hash is summed in so many parts of 60 bits, so sums tell sets apart without an order.
LANES = 4


def leak_audit(clean: DataFrame, id_cols: list[str], col: str, rules: DataFrame, join: bool = False) -> DataFrame:
    """Rows of a cleaned corpus that renaming would still touch. A clean corpus is a fixed
    point of its rules, so this table is empty for it."""
    checked = rename_text(clean.select(*id_cols, col), id_cols, col, rules, "_again", "n_hits", join)
    return checked.where(F.col("n_hits") > 0).select(
        *id_cols, "n_hits", (F.col("_again") != F.col(col)).alias("would_change")
    )


def round_trip_audit(original: DataFrame, restored: DataFrame, id_cols: list[str], col: str) -> DataFrame:
    """Rows where the restored text is not the trimmed original, or one side is missing.
    Only hashes and lengths are joined, not the texts."""
    def digest(df: DataFrame, text, name: str) -> DataFrame:
        return df.select(*id_cols, F.sha2(text, 256).alias(name))

    both = digest(original, strip_spaces(F.col(col)), "_was").join(
        digest(restored, F.col(col), "_is"), id_cols, "full_outer"
    )
    problem = (
        F.when(F.col("_is").isNull(), "missing")
        .when(F.col("_was").isNull(), "unexpected")
        .when(F.col("_was") != F.col("_is"), "differs")
    )
    return both.select(*id_cols, problem.alias("problem")).where(F.col("problem").isNotNull())


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys that may be null; the left side's keys stay."""
    named = right.select(*[F.col(c).alias(f"_r_{c}" if c in keys else c) for c in right.columns])
    met = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(named, met, how).drop(*[f"_r_{k}" for k in keys])


def _changed(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """Subtrees whose two sides hold other files: hashes of path and text count up for the
    original and down for the restored side, and a subtree that came back whole sums to nothing."""
    name = F.sha2(F.concat(F.col("digest"), F.coalesce(F.concat(F.lit("/"), "path"), F.lit(""))), 256)
    lanes = [
        F.sum(F.conv(F.substr(name, F.lit(15 * i + 1), F.lit(15)), 16, 10).cast("decimal(20,0)") * F.col("sign")).alias(f"_{i}")
        for i in range(LANES)
    ]
    sums = leaves.groupBy(*keys).agg(F.sum("sign").alias("_n"), *lanes)
    return sums.where(" OR ".join(f"_{i} <> 0" for i in ["n", *range(LANES)])).select(*keys)


def _first_difference(was: Column, now: Column) -> Column:
    """Number of the first line (from 1) that two texts do not share."""
    lines = F.struct(F.split(was, "\n", -1).alias("a"), F.split(now, "\n", -1).alias("b"))

    def first(both: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(both["a"]), F.size(both["b"])) - 1)
        other = F.filter(places, lambda i: ~F.get(both["a"], i).eqNullSafe(F.get(both["b"], i)))
        return F.array_min(other) + 1

    return let(lines, first)


def merkle_audit(original: DataFrame, restored: DataFrame, col: str = "text") -> DataFrame:
    """Files (project, path) that did not come back as the trimmed original: project, path,
    problem (missing, unexpected, differs), line (the first that differs, else null).

    Hashes are rolled up by project, then by folder in projects that differ, then by file in
    folders that differ; texts are joined for files that differ only. The hashes are stored once,
    and so are the restored texts: their restoring is what costs, and they are read more than once.
    Files are multisets: a row that comes back once too few is missing, once too many unexpected.
    Of several texts of a path the one with the smallest hash that the other side lacks is
    compared. Null projects and paths are names like others; a null text is no file.
    """
    def hashed(df: DataFrame, text: Column) -> DataFrame:
        return df.select("project", "path", text.alias("text")).where(F.col("text").isNotNull()).withColumn(
            "digest", F.sha2("text", 256)
        )

    # stored before the filter, which would restore each text once more to see whether it is null
    back = materialize(restored.select("project", "path", col), "restored")
    was, now = hashed(original, strip_spaces(F.col(col))), hashed(back, F.col(col))
    row = ["project", paths.parent(F.col("path")).alias("folder"), "path", "digest"]
    leaves = materialize(
        was.select(*row, F.lit(1).alias("sign")).unionByName(now.select(*row, F.lit(-1).alias("sign"))), "leaves"
    )
    for keys in (["project"], ["project", "folder"]):
        leaves = _same(leaves, _changed(leaves, keys), keys, "left_semi")
    odd = leaves.groupBy("project", "path", "digest").agg(F.sum("sign").alias("n")).where("n <> 0")
    found = materialize(
        odd.groupBy("project", "path").agg(
            F.min(F.when(F.col("n") > 0, F.col("digest"))).alias("was"), F.min(F.when(F.col("n") < 0, F.col("digest"))).alias("now")
        ),
        "differing",
    )
    both = found.where("was IS NOT NULL AND now IS NOT NULL")

    def opened(df: DataFrame, side: str) -> DataFrame:
        wanted = both.select("project", "path", F.col(side).alias("digest"))
        texts = _same(df, wanted, ["project", "path", "digest"], "left_semi")
        # rows that share path and hash are one text
        return texts.groupBy("project", "path").agg(F.min("text").alias(f"_{side}"))

    pairs = _same(opened(was, "was"), opened(now, "now"), ["project", "path"], "inner")
    lines = pairs.select("project", "path", F.lit("differs").alias("problem"), _first_difference(F.col("_was"), F.col("_now")).alias("line"))
    alone = found.where("was IS NULL OR now IS NULL").select(
        "project", "path", F.when(F.col("now").isNull(), "missing").otherwise("unexpected").alias("problem"), F.lit(None).cast("int").alias("line")
    )
    return lines.unionByName(alone)
