"""Mapping sets: JSON documents, name=name pairs, and tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusveil import values as v
from corpusveil.operators.literals import with_index
from corpusveil.plans.joins import dictionary_join
from corpusveil.session import materialize, read_or_first, running_sums

#: Bytes of a mapping document, one entry over at most; a larger set comes in several.
DOCUMENT_BYTES = 4_000_000
KINDS = ("package", "variable", "literal")
PAIRS = "set_id string, kind string, ord int, `from` string, `to` string"


def parse_mappings(docs: DataFrame) -> DataFrame:
    """(set_id, doc) -> set_id, version, language, package, variable, strings, and the places of the
    first pairs in their set. A bare list holds package pairs; absent sections become empty;
    the version becomes current."""
    failfast = {"mode": "FAILFAST"}
    text = F.btrim("doc", F.lit(v.SPACE_CHARS))
    is_list = F.startswith(text, F.lit("["))
    pair_list = "array<struct<`from`: string, `to`: string>>"
    listed = F.from_json(F.when(is_list, text), pair_list, failfast)
    whole = F.from_json(F.when(~is_list, text), v.MAPPING_JSON_SCHEMA, failfast)
    none = F.array().cast(pair_list)
    first = F.from_json(F.when(~is_list, text), "at struct<package: int, variable: int>")
    return docs.select("set_id", listed.alias("l"), whole.alias("d"), first.alias("f")).select(
        "set_id",
        F.lit(v.MAPPING_VERSION).alias("version"),
        F.col("d.language").alias("language"),
        F.coalesce("l", "d.package", none).alias("package"),
        F.coalesce("d.variable", none).alias("variable"),
        F.coalesce("d.strings", F.from_json(F.lit("{}"), "map<string,string>")).alias("strings"),
        *[F.coalesce(F.col(f"f.at.{kind}"), F.lit(0)).alias(f"at_{kind}") for kind in ("package", "variable")],
    )


def pairs_of(parsed: DataFrame) -> DataFrame:
    """Parsed sets -> mappings (set_id, kind, ord, from, to). Pairs stay as they are; those
    with an empty side are dropped where rules are made."""
    def side(kind: str) -> DataFrame:
        return parsed.select("set_id", F.lit(kind).alias("kind"), f"at_{kind}", F.posexplode(kind).alias("ord", "p")).select(
            "set_id", "kind", (F.col("ord") + F.col(f"at_{kind}")).alias("ord"), F.col("p.from").alias("from"), F.col("p.to").alias("to")
        )

    return side("package").unionByName(side("variable"))


def literals_of(parsed: DataFrame) -> DataFrame:
    """Parsed sets -> dictionary rows with their set."""
    rows = parsed.select("set_id", F.explode("strings").alias("token", "literal"))
    indexed = with_index(rows.select("token", "literal").distinct())
    return rows.join(indexed, ["token", "literal"]).select("set_id", "token", "idx", "literal")


def read_mappings(spark: SparkSession, path: str, set_id: str = "") -> DataFrame:
    """Parsed mapping document. A path that does not exist is an error: going on without a
    mapping would let sensitive names through."""
    docs = spark.read.text(path, wholetext=True).select(F.lit(set_id).alias("set_id"), F.col("value").alias("doc"))
    return parse_mappings(docs)


def mappings_from_pairs(df: DataFrame, col: str, kind: str, set_id: str = "", ord_col: str | None = None, start: int = 0) -> DataFrame:
    """FROM=TO texts -> mappings, split at the first '='. Texts without '=' or with an empty
    side are errors; see rejected_pairs. `ord_col` gives the order of the pairs."""
    parts = F.split(F.col(col), "=", 2)
    frm, to = F.get(parts, 0), F.get(parts, 1)
    bad = to.isNull() | (frm == "") | (to == "")
    message = F.concat(F.lit("not of the form FROM=TO: "), F.col(col))
    checked = F.when(bad, F.raise_error(message)).otherwise(frm)
    place = F.col(ord_col) if ord_col else F.lit(0)
    return df.select(
        F.lit(set_id).alias("set_id"), F.lit(kind).alias("kind"),
        (place + start).cast("int").alias("ord"), checked.cast("string").alias("from"), to.alias("to"),
    )


def rejected_pairs(df: DataFrame, col: str) -> DataFrame:
    return df.where(~F.rlike(F.col(col), F.lit(r"(?s)^[^=]+=.")))


def append_pairs(mappings: DataFrame, more: DataFrame) -> DataFrame:
    """Put further pairs after those of the same set and kind."""
    last = mappings.groupBy("set_id", "kind").agg((F.max("ord") + 1).alias("_next"))
    moved = more.join(last, ["set_id", "kind"], "left").withColumn(
        "ord", (F.col("ord") + F.coalesce("_next", F.lit(0))).cast("int")
    )
    return mappings.unionByName(moved.select(*mappings.columns))


def mapping_documents(mappings: DataFrame, literals: DataFrame | None, language: str, size: int = DOCUMENT_BYTES) -> DataFrame:
    """(set_id, part, doc): JSON documents of at most `size` bytes and one entry, with all pairs of
    every set in order, then its literals. Each part is a mapping document of its own; `at`
    says where its pairs stand in the set. Running sums plan the parts, so a set of any size is
    never one row."""

    def entries(rows: DataFrame, kind: int, order: str, left: str, right: str) -> DataFrame:
        return rows.select("set_id", F.lit(kind).alias("kind"), F.col(order).cast("bigint").alias("ord"), F.col(left).alias("a"), F.col(right).alias("b"))

    every = entries(mappings.where("kind = 'package'"), 0, "ord", "from", "to").unionByName(entries(mappings.where("kind = 'variable'"), 1, "ord", "from", "to"))
    if literals is not None:
        every = every.unionByName(entries(literals, 2, "idx", "token", "literal"))
    sized = every.withColumn("bytes", F.coalesce(F.octet_length("a"), F.lit(0)) + F.coalesce(F.octet_length("b"), F.lit(0)) + F.lit(20))
    placed = materialize(running_sums(sized, ["set_id", "kind", "ord", "a", "b"], "bytes", "place", "before"), "entries")
    starts = placed.groupBy("set_id", "kind").agg(F.min("place").alias("first"), F.min("before").alias("begin"))
    sets = starts.groupBy("set_id").agg(F.min("begin").alias("begin"), *[F.min(F.when(F.col("kind") == k, F.col("first"))).alias(f"first_{k}") for k in (0, 1)])
    parted = dictionary_join(placed.drop("bytes"), materialize(sets, "sets"), ["set_id"], ["place"]).withColumn(
        "part", F.floor((F.col("before") - F.col("begin")) / size)
    )

    def of(kind: int, entry: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("place", "a", "b")))), lambda e: F.struct(*entry(e)))

    def pairs(kind: int) -> Column:
        return of(kind, lambda e: [e["a"].alias("from"), e["b"].alias("to")]).alias(KINDS[kind])

    def at(kind: int) -> Column:
        return F.coalesce(F.min(F.when(F.col("kind") == kind, F.col("place") - F.col(f"first_{kind}"))), F.lit(0)).cast("int").alias(KINDS[kind])

    made = parted.groupBy("set_id", "part").agg(
        pairs(0), pairs(1), F.map_from_entries(of(2, lambda e: [e["a"], e["b"]])).alias("strings"), F.struct(at(0), at(1)).alias("at")
    )
    return made.select(
        "set_id", "part",
        F.to_json(F.struct(F.lit(v.MAPPING_VERSION).alias("version"), F.lit(language).alias("language"), "package", "variable", "strings", "at")).alias("doc"),
    )


def write_mappings(mappings: DataFrame, literals: DataFrame | None, language: str, path: str, size: int = DOCUMENT_BYTES) -> None:
    """Mapping sets as JSON documents, one per line; see mapping_documents."""
    mapping_documents(mappings, literals, language, size).select("doc").write.mode("overwrite").text(path)


MANIFEST = "version bigint, folder string, documents bigint"


def publish_mappings(mappings: DataFrame, literals: DataFrame | None, language: str, path: str, size: int = DOCUMENT_BYTES) -> int:
    """Store all sets under `path` as a new version and return its number. Documents are written
    to a folder of their own first; one more row of the manifest then makes them the current
    version at once. Whoever reads meanwhile sees the version before."""
    spark = mappings.sparkSession
    known = _manifest(spark, path)
    version = 1 + max((r["version"] for r in known), default=0)  # one row per version
    folder = f"documents-{version}-{uuid.uuid4().hex}"
    mapping_documents(mappings, literals, language, size).write.parquet(f"{path}/{folder}")
    n = spark.read.parquet(f"{path}/{folder}").count()
    spark.createDataFrame([(version, folder, n)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return version


def published_mappings(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Parsed sets of a published version (the last one): (set_id, package, variable, strings, ...). Nothing
    published, and documents that are no longer whole, are errors."""
    wanted = [r for r in _manifest(spark, path) if version is None or r["version"] == version]
    if not wanted:
        raise ValueError(f"no mapping published under {path}")
    last = max(wanted, key=lambda r: (r["version"], r["folder"]))
    docs = spark.read.schema("set_id string, part bigint, doc string").parquet(f"{path}/{last['folder']}")
    if docs.count() != last["documents"]:
        raise ValueError(f"{path}/{last['folder']} does not hold the {last['documents']} documents of its manifest")
    return parse_mappings(docs)


def _manifest(spark: SparkSession, path: str) -> list:
    return read_or_first(spark, MANIFEST, f"{path}/manifest", True).collect()


def write_mapping_tables(mappings: DataFrame, literals: DataFrame, path: str) -> None:
    mappings.write.mode("overwrite").parquet(f"{path}/mappings")
    literals.write.mode("overwrite").parquet(f"{path}/literals")


def read_mapping_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/mappings"), spark.read.parquet(f"{path}/literals")
