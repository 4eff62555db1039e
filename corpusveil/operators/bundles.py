"""Hand-over texts and extraction plans per closure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusveil import values as v
from corpusveil.functions import paths
from corpusveil.operators import rename as W
from corpusveil.operators import rules as R

NAMES_PER_PART = 5_000


def dependency_names(closure: DataFrame, mappings: DataFrame, lang: str) -> DataFrame:
    """Renamed short names of a closure's modules, entry and missing ones included,
    without the type that is never replaced by a stand-in."""
    kept = closure.where(F.col("type") != v.BUNDLE_EXCLUDED_TYPE[lang])
    module = F.col("module_id")
    if lang == v.SPRING:
        name = F.element_at(F.split(module, r"\.", -1), -1)
    else:
        folder = paths.basename(paths.parent(module))
        stem = paths.stem(module)
        name = F.when((stem == "index") & (folder != ""), folder).otherwise(stem)
    named = kept.select("project", "entry", "seq", name.alias("name"))
    return W.rename_text(named, ["project", "entry", "seq"], "name", R.variable_rules(mappings))


def bundles(
    closure: DataFrame, mappings: DataFrame, lang: str, framework: str = "jest", names_per_part: int = NAMES_PER_PART
) -> DataFrame:
    """The bundle text of every entry as parts (project, entry, part, text): joined in part
    order they give the text. A part holds at most names_per_part names, so an entry with
    millions of dependencies is spread over many rows and tasks."""
    label, mock = v.TEST_FRAMEWORKS.get(framework, v.TEST_FRAMEWORKS["jest"])
    head = v.BUNDLE_HEAD[lang].replace("{framework}", label).replace("{mock}", mock)
    tail = v.BUNDLE_TAIL[lang]
    names = dependency_names(closure, mappings, lang)
    part = F.floor(F.col("seq") / names_per_part).cast("bigint") + 1
    middle = (
        names.withColumn("part", part)
        .groupBy("project", "entry", "part")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "name"))).alias("_n"))
        .select("project", "entry", "part", F.array_join(F.col("_n")["name"], ", ").alias("text"))
    )
    sizes = closure.groupBy("project", "entry").agg(F.max("seq").alias("_last"))
    first = middle.groupBy("project", "entry").agg(F.min("part").alias("_first"))
    frame = sizes.join(first, ["project", "entry"], "left")
    # a later part continues the list of an earlier one
    body = middle.join(first, ["project", "entry"]).select(
        "project", "entry", "part",
        F.when(F.col("part") > F.col("_first"), F.concat(F.lit(", "), "text")).otherwise(F.col("text")).alias("text"),
    )
    last_part = F.floor(F.col("_last") / names_per_part).cast("bigint") + 2
    ends = frame.select(
        "project", "entry",
        F.explode(
            F.array(
                F.struct(F.lit(0).cast("bigint").alias("part"), F.lit(head).alias("text")),
                F.struct(
                    last_part.alias("part"),
                    F.when(F.col("_first").isNull(), F.lit(v.BUNDLE_EMPTY[lang] + tail)).otherwise(F.lit(tail)).alias("text"),
                ),
            )
        ).alias("e"),
    ).select("project", "entry", "e.part", "e.text")
    return body.unionByName(ends)


def extraction_plan(closure: DataFrame, files: DataFrame, mappings: DataFrame, lang: str) -> DataFrame:
    """What a cleaning run would write: per module its target path and the number of
    substitutions; modules without a file are skipped."""
    sources = files.select("project", "path", "text")
    # a file that several entries reach is counted once, without its text travelling further
    counted = W.count_substitutions(sources, ["project", "path"], "text", R.content_rules(mappings), "substitutions").drop("text")
    ids = closure.select("project", "module_id").distinct()
    targets = W.output_path(ids, ["project", "module_id"], "module_id", mappings, lang, "target")
    return (
        closure.join(targets.hint("merge"), ["project", "module_id"])
        .join(counted.hint("merge"), ["project", "path"], "left")
        .select(
            "project", "entry", "module_id",
            F.when(F.col("found"), "write").otherwise("skip").alias("action"),
            F.when(F.col("found"), F.col("target")).alias("target"),
            "substitutions",
        )
    )
