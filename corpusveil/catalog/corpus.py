"""Source corpora, names and mapping sets that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusveil import values as v
from corpusveil.functions.columns import let
from corpusveil.session import materialize, number_rows, parallelism

TEXT_MAPPING = [
    ("package", 0, "example.com", "zq-host.test"),
    ("package", 1, "example.net", "zq-net.test"),
    ("variable", 0, "The", "Zqunit"),
    ("variable", 1, "that", "zqway"),
    ("variable", 2, "Ander", "Zqside"),
    ("variable", 3, "Les", "Zqlots"),
    ("variable", 4, "thereThe", "Zqlong"),
]
CODE_MAPPING = [
    ("package", 0, "com.myco", "org.safe"),
    ("variable", 0, "Part", "Unit"),
    ("variable", 1, "PartService", "Worker"),
    ("variable", 2, "label", "tag"),
]
WEB_MAPPING = [
    ("package", 0, "components", "widgets"),
    ("package", 1, "lib", "shared/code"),
    ("variable", 0, "Part", "Unit"),
    ("variable", 1, "label", "tag"),
]


def mapping_set(spark: SparkSession, pairs: list[tuple], set_id: str) -> DataFrame:
    rows = [(set_id, kind, n, frm, to) for kind, n, frm, to in pairs]
    return spark.createDataFrame(rows, "set_id string, kind string, ord int, `from` string, `to` string")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts, spread over all tasks: a part takes few bytes to read, but what is made of it is a
    text that costs milliseconds, so the splits of the scan are far too large."""
    return table(spark, sf_dir, "part").repartition(parallelism(spark), "p_partkey")


def spread_texts(df: DataFrame, *columns: str) -> DataFrame:
    """Rows spread over all tasks by `columns`, which should tell them apart: a text costs far more to
    clean than to read, and a file may have fewer row groups than there are tasks."""
    return df.repartition(parallelism(df.sparkSession), *columns)


def _numbered_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = parts(spark, sf_dir)
    placed = part.select(
        (F.col("p_partkey") % 10).cast("string").alias("project"),
        F.floor(F.col("p_partkey") / 10).cast("bigint").alias("i"),
        "p_name", "p_brand", "p_type", "p_size",
    )
    # ten projects, whatever the size of part
    sizes = placed.groupBy("project").agg(F.count(F.lit(1)).alias("n"))
    return placed.join(F.broadcast(sizes), "project")


def _targets() -> Column:
    """Numbers of the modules that module i imports: a tree, some cycles, some missing."""
    i, n = F.col("i"), F.col("n")
    return F.array_compact(
        F.array(
            F.when(2 * i + 1 < n + 3, 2 * i + 1),
            F.when(2 * i + 2 < n + 3, 2 * i + 2),
            F.when((i % 11 == 0) & (i > 0), (i * i + 1) % n),
        )
    )


def _java_name(i: Column) -> Column:
    suffix = F.element_at(F.array(*[F.lit(s) for s in ["Service", "Repository", "Controller", "Enum", "Util", "Item"]]), (i % 6 + 1).cast("int"))
    return F.concat(F.lit("Part"), suffix, i.cast("string"))


def _java_package(i: Column) -> Column:
    return F.concat(F.lit("com.myco.m"), (i % 7).cast("string"))


def java_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _numbered_parts(spark, sf_dir)
    i = F.col("i")
    lines = F.transform(
        _targets(), lambda t: F.concat(F.lit("import "), _java_package(t), F.lit("."), _java_name(t), F.lit(";\n"))
    )
    text = F.concat(
        F.lit("package "), _java_package(i), F.lit(";\n\n"),
        F.array_join(lines, ""),
        F.lit("import com.myco2.ext.E"), i.cast("string"), F.lit(";\n\n// "), F.col("p_name"),
        F.lit("\n/**\n * @author "), F.col("p_brand"), F.lit("\n */\npublic class "), _java_name(i),
        F.lit(" {\n    String label = \""), F.col("p_brand"), F.lit(" "), F.col("p_type"),
        F.lit("\";\n    String url = \"http://com.myco/part/"), i.cast("string"),
        F.lit("\"; /* size "), F.col("p_size").cast("string"), F.lit(" */\n\n\n\n    void run() {\n        log.info(\"run {}\", "),
        F.col("p_size").cast("string"), F.lit(");\n        part_count = PARTS + myPart;\n    }\n}\n"),
    )
    path = F.concat(F.replace(_java_package(i), F.lit("."), F.lit("/")), F.lit("/"), _java_name(i), F.lit(".java"))
    return parts.select("project", path.alias("path"), F.lit(v.SPRING).alias("lang"), text.alias("text"), "i")


def _react_folder(i: Column) -> Column:
    return F.element_at(
        F.array(
            F.lit("components"), F.lit("hooks"), F.lit("api"), F.concat(F.lit("types/part-"), i.cast("string")), F.lit("lib"), F.lit("pages")
        ),
        (i % 6 + 1).cast("int"),
    )


def _react_name(i: Column) -> Column:
    num = i.cast("string")
    return F.element_at(
        F.array(
            F.concat(F.lit("PartView"), num), F.concat(F.lit("usePart"), num), F.concat(F.lit("partApi"), num), F.lit("index"),
            F.concat(F.lit("part_"), num), F.concat(F.lit("partPage"), num),
        ),
        (i % 6 + 1).cast("int"),
    )


def _react_extension(i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(e) for e in [".tsx", ".ts", ".ts", ".ts", ".js", ".jsx"]]), (i % 6 + 1).cast("int"))


def _react_spec(t: Column, i: Column) -> Column:
    """How module i names module t: folders with an index by folder, .js files with their ending."""
    target = F.when(t % 6 == 3, _react_folder(t)).otherwise(
        F.concat(_react_folder(t), F.lit("/"), _react_name(t), F.when(t % 6 == 4, ".js").otherwise(""))
    )
    up = F.when(i % 6 == 3, "../../").otherwise("../")
    return F.when(i % 2 == 0, F.concat(F.lit("@/"), target)).otherwise(F.concat(up, target))


def react_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _numbered_parts(spark, sf_dir)
    i = F.col("i")
    lines = F.transform(
        _targets(),
        lambda t: F.concat(F.lit("import {\n  a"), t.cast("string"), F.lit(",\n} from '"), _react_spec(t, i), F.lit("';\n")),
    )
    num = i.cast("string")
    text = F.concat(
        F.lit("import React from 'react';\n"), F.array_join(lines, ""),
        F.lit("import './part"), num, F.lit(".css';\n{/* "), F.col("p_name"), F.lit(" */}\n// size "), F.col("p_size").cast("string"),
        F.lit("   \n\n\n\nconst label = '"), F.col("p_brand"), F.lit(" "), F.col("p_type"),
        F.lit("';\nconst tpl = `"), F.col("p_name"), F.lit("`;\nconst url = \"http://part/"), F.col("p_size").cast("string"),
        F.lit("\"; /* PART_SIZE */\nconst live = `n ${label} "), F.col("p_size").cast("string"),
        F.lit("`;\nconsole.log('part ", ) , num, F.lit("');\nexport const value"), num, F.lit(" = myPart"),
        F.when(i % 4 == 0, "(<Panel />)").otherwise(""), F.lit(";\n"),
    )
    path = F.concat(_react_folder(i), F.lit("/"), _react_name(i), _react_extension(i))
    return parts.select("project", path.alias("path"), F.lit(v.REACT).alias("lang"), text.alias("text"), "i")


def java_entries(files: DataFrame) -> DataFrame:
    return files.where(F.col("i").isin(1, 2, 5)).select("project", F.col("path").alias("entry"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct identifier-like names: words of all texts, table names, compounds of them."""
    words = table(spark, sf_dir, "documents").select(
        F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))).alias("name")
    )
    part = table(spark, sf_dir, "part")
    snake = part.select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"))
    upper = part.select(F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name"))
    pascal = part.select(F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")).alias("name"))
    mixed = part.select(F.concat(F.lower("p_type"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))).alias("name"))
    priority = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name"))
    region = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))
    nation = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))
    out = words
    for more in (snake, upper, pascal, mixed, priority, region, nation, customer):
        out = out.unionByName(more)
    return out.distinct()


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The package pairs of mappings()."""
    host = F.regexp_extract("url", "^https?://([^/?#]*)", 1)
    page = F.col("page_id") % 3
    return (
        table(spark, sf_dir, "pages")
        .select("page_id", host.alias("host"))
        .select(
            F.regexp_extract("host", r"([^.]*)\z", 1).alias("set_id"), F.lit("package").alias("kind"),
            F.col("page_id").cast("int").alias("ord"), F.col("host").alias("from"),
            F.when(page == 0, F.regexp_replace("host", r"^[^.]*\.", ""))
            .when(page == 1, F.concat(F.lit("safe."), "host"))
            .otherwise(F.col("host")).alias("to"),
        )
    )


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping sets found in the data. Identifiers, one set per language: the first word of
    a document stands for the second. Packages, one set per top-level domain: hosts stand
    for their domain, for a prefixed host or for themselves."""
    first = F.regexp_extract("text", "([A-Za-z]{2,})", 1)
    second = F.regexp_extract("text", "(?s)[A-Za-z]{2,}+.*?([A-Za-z]{2,})", 1)
    variable = (
        table(spark, sf_dir, "documents")
        .select(
            F.col("lang").alias("set_id"), F.lit("variable").alias("kind"), F.col("doc_id").cast("int").alias("ord"),
            first.alias("from"), second.alias("to"),
        )
        .where(F.col("to") != "")
    )
    return variable.unionByName(_hosts(spark, sf_dir))


def whole_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As mappings, from whole texts and as one set: every word of a document stands for the next
    one. The first rule of a literal wins and all rules of a word are made of it alone, so a word
    has the pair of its first place (by document, then by place in it); hosts keep all pairs."""
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), F.lit(0))
    pairs = let(words, lambda w: F.arrays_zip(w.alias("from"), F.slice(w, 2, F.size(w)).alias("to")))
    placed = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(pairs).alias("k", "pair"))
    # the last word of a text has none after it
    first = (
        placed.where(F.col("pair.to").isNotNull())
        .groupBy(F.col("pair.from").alias("from"))
        .agg(F.min(F.struct("doc_id", "k", "pair.to")).alias("at"))
        .select("from", "at.*")
    )
    numbered = number_rows(materialize(first, "pairs"), ["doc_id", "k", "from"], "ord")
    # few bytes a word, but its forms and their rules are made in the tasks of this side
    spread = numbered.repartition(parallelism(spark), "from")
    variable = spread.select(F.lit("variable").alias("kind"), "ord", "from", "to")
    return variable.unionByName(_hosts(spark, sf_dir).drop("set_id")).select(F.lit("all").alias("set_id"), "*")
