"""Corpus-wide literal dictionary: extract, number, mask, unmask.

Literals: <id columns>, pos, literal (quotes included).
Dictionary: token ('STR_n'), idx (n), literal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusveil import values as v
from corpusveil.functions.columns import collect_dictionary, is_match, pieces
from corpusveil.functions.text import segments
from corpusveil.operators.profiles import by_lang
from corpusveil.plans.joins import substitute
from corpusveil.session import number_rows

DICTIONARY_SCHEMA = "token STRING, idx BIGINT, literal STRING"


def segment_table(df: DataFrame, id_cols: list[str], col: str) -> DataFrame:
    """One row per typed segment of JS/TS text."""
    return df.select(*id_cols, F.posexplode(segments(F.col(col))).alias("pos", "s")).select(
        *id_cols, "pos", "s.kind", "s.text"
    )


def extract_literals(df: DataFrame, id_cols: list[str], col: str, lang: Column | str) -> DataFrame:
    """One row per maskable literal occurrence, in text order."""
    found = F.filter(by_lang(lang, "literals", F.col(col)), lambda p: p["literal"].isNotNull())
    return df.select(*id_cols, F.posexplode(found["literal"]).alias("pos", "literal"))


def empty_dictionary(spark) -> DataFrame:
    return spark.createDataFrame([], DICTIONARY_SCHEMA)


def with_index(dictionary: DataFrame) -> DataFrame:
    """Dictionary rows from (token, literal); idx is null for tokens of another shape."""
    number = F.try_to_number(F.nullif(F.regexp_extract("token", v.TOKEN_NUMBER, 1), F.lit("")), F.lit("999999999999999999"))
    return dictionary.select("token", number.cast("bigint").alias("idx"), "literal")


def build_dictionary(literals: DataFrame, order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """Extend `existing` by the literals it lacks, numbered densely in order of first sight
    after its highest number. The first sight of a literal is found with a map-side
    combined minimum, so only distinct literals are shuffled and sorted."""
    first = literals.groupBy("literal").agg(F.min(F.struct(*order)).alias("_first"))
    start = 0
    if existing is not None:
        first = first.join(existing.select("literal"), "literal", "left_anti")
        highest = existing.agg(F.max("idx").alias("m")).first()["m"]
        start = 0 if highest is None else highest + 1
    places = [f"_o{i}" for i in range(len(order))]
    flat = first.select("literal", *[F.col("_first")[c].alias(p) for c, p in zip(order, places)])
    fresh = number_rows(flat, places, "idx", start).select(
        F.concat(F.lit(v.TOKEN_PREFIX + "_"), F.col("idx").cast("string")).alias("token"),
        F.col("idx").cast("bigint").alias("idx"),
        "literal",
    )
    if existing is None:
        return fresh
    return existing.select("token", F.col("idx").cast("bigint").alias("idx"), "literal").unionByName(fresh)


def _by_literal(dictionary: DataFrame) -> DataFrame:
    return dictionary.groupBy("literal").agg(F.max_by("token", F.coalesce("idx", F.lit(-1))).alias("token"))


def _requote(literal: Column, token: Column) -> Column:
    quote = F.left(literal, F.lit(1))
    return F.concat(quote, token, quote)


def _mask_parts(parts: Column, lookup) -> Column:
    return F.array_join(
        F.transform(
            parts,
            lambda p: F.when(
                p["literal"].isNotNull(), F.coalesce(_requote(p["literal"], lookup(p["literal"])), p["text"])
            ).otherwise(p["text"]),
        ),
        "",
    )


def mask_literals(
    df: DataFrame, id_cols: list[str], col: str, lang: Column | str, dictionary: DataFrame, out: str | None = None, join: bool = False
) -> DataFrame:
    """Replace each literal by its token in the same quotes. A small dictionary stands in the
    plan; a larger one is joined, as any is with `join`."""
    out = out or col
    tokens = _by_literal(dictionary)
    parts = by_lang(lang, "literals", F.col(col))
    lookup = None if join else collect_dictionary(tokens, "literal", "token")
    if lookup:
        return df.withColumn(out, _mask_parts(parts, lookup))
    keyed = F.transform(parts, lambda p: F.struct(p["text"].alias("text"), p["literal"].alias("key")))
    known = tokens.select(F.col("literal").alias("key"), F.col("token").alias("value"), F.lit(1).alias("n"))
    return substitute(df, id_cols, col, keyed, known, out, _requote)


def _inside(quoted: Column) -> Column:
    return F.substr(quoted, F.lit(2), F.length(quoted) - 2)


def _unmask(text: Column, lookup) -> tuple[Column, Column]:
    parts = pieces(text, v.QUOTED_TOKEN)
    restored = F.array_join(
        F.transform(parts, lambda p, i: F.when(is_match(i), F.coalesce(lookup(_inside(p)), p)).otherwise(p)), ""
    )
    hits = F.regexp_extract_all(text, F.lit(v.QUOTED_TOKEN), F.lit(0))
    return restored, F.size(F.filter(hits, lambda p: lookup(_inside(p)).isNotNull()))


def unmask_literals(
    df: DataFrame, id_cols: list[str], col: str, dictionary: DataFrame, out: str | None = None, count: str | None = None, join: bool = False
) -> DataFrame:
    """Put the stored literal back for every quoted token, whatever its quotes; unknown
    tokens stay. `count` receives the number of restored literals."""
    out = out or col
    known = dictionary.groupBy("token").agg(F.max("literal").alias("literal"))
    lookup = None if join else collect_dictionary(known, "token", "literal")
    if lookup:
        text, hits = _unmask(F.col(col), lookup)
        result = df.withColumn("_text", text)
        result = result.withColumn(count, hits) if count else result
        return result.withColumn(out, F.col("_text")).drop("_text")
    keyed = F.transform(
        pieces(F.col(col), v.QUOTED_TOKEN),
        lambda p, i: F.struct(p.alias("text"), F.when(is_match(i), _inside(p)).alias("key")),
    )
    values = known.select(F.col("token").alias("key"), F.col("literal").alias("value"), F.lit(1).alias("n"))
    tokens = F.transform(F.regexp_extract_all(F.col(col), F.lit(v.QUOTED_TOKEN), F.lit(0)), _inside)
    return substitute(df, id_cols, col, keyed, values, out, lambda old, new: new, count, tokens)


def leftover_tokens(text: Column) -> Column:
    """Distinct bare tokens still in a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(v.BARE_TOKEN), F.lit(0))))
