"""Trace, clean and store: everything a hand-over needs, as tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusveil import values as v
from corpusveil.operators import bundles as B
from corpusveil.operators import graph as G
from corpusveil.operators import literals as L
from corpusveil.operators import rename as W
from corpusveil.operators import rules as R
from corpusveil.operators import sanitize as S
from corpusveil.session import materialize


@dataclass
class Extraction:
    closure: DataFrame
    clean: DataFrame
    dictionary: DataFrame | None
    bundles: DataFrame
    problems: DataFrame
    mappings: DataFrame

    def save(self, path: str, write: Callable[[DataFrame], object]) -> None:
        """Store what a reversal needs under `path`, then hand the cleaned files to `write`. Files are
        never out without the mapping and the literals that undo them."""
        none = L.empty_dictionary(self.clean.sparkSession)
        self.mappings.write.parquet(f"{path}/mappings")
        (self.dictionary or none).write.parquet(f"{path}/literals")
        write(self.clean)


def saved(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """Mappings and dictionary that Extraction.save stored; None for a dictionary without literals."""
    literals = spark.read.parquet(f"{path}/literals")
    return spark.read.parquet(f"{path}/mappings"), None if literals.isEmpty() else literals


def edges_of(files: DataFrame, lang: str, scope: str) -> DataFrame:
    """Resolved import edges; scope is the base package or the path alias."""
    if lang == v.SPRING:
        return G.resolve_java(G.java_imports(files, scope), files)
    return G.resolve_react(G.react_imports(files), files, scope or v.DEFAULT_ALIAS)


def trace(files: DataFrame, entries: DataFrame, lang: str, scope: str, bucketed: bool | None = None) -> DataFrame:
    modules = materialize(G.module_table(files, lang), "modules")
    return G.trace_closure(entries, edges_of(files, lang, scope), modules, lang, bucketed=bucketed)


def extract(
    files: DataFrame,
    entries: DataFrame,
    lang: str,
    scope: str,
    mappings: DataFrame,
    options: S.Options = S.Options(),
    existing: DataFrame | None = None,
    framework: str = "jest",
) -> Extraction:
    """Clean every file some entry depends on. A file shared by several entries is cleaned
    once; literals are numbered in the order in which the closures discover their files.
    `problems` lists what is odd about the mappings; nothing is refused for it."""
    closure = trace(files, entries, lang, scope)
    reached = (
        closure.where("found")
        .groupBy("project", "path")
        .agg(F.min(F.struct("entry", "seq")).alias("_s"), F.min("module_id").alias("module_id"))
        .select("project", "path", "module_id", "_s.entry", "_s.seq")
    )
    sources = files.select("project", "path", "text").join(reached, ["project", "path"])
    clean, dictionary = S.sanitize_corpus(
        sources, ["project", "path"], "text", mappings, options, lang, ["project", "entry", "seq"], existing
    )
    placed = W.output_path(
        clean.select("project", "path", "module_id", "text"), ["project", "path"], "module_id", mappings, lang, "target"
    )
    out = placed.select(
        "project", F.col("path").alias("source_path"), F.col("target").alias("path"), F.lit(lang).alias("lang"), "text"
    )
    return Extraction(closure, out, dictionary, B.bundles(closure, mappings, lang, framework), R.validate_mappings(mappings), mappings)
