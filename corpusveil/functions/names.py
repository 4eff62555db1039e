"""Identifier case, plural and singular forms as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusveil.functions.columns import let
from corpusveil.values import IRREGULAR_PLURALS


def is_upper(c: Column) -> Column:
    return (c == F.upper(c)) & (c != F.lower(c))


def starts_upper(c: Column) -> Column:
    return is_upper(F.left(c, F.lit(1)))


def starts_lower(c: Column) -> Column:
    first = F.left(c, F.lit(1))
    return (first == F.lower(first)) & (first != F.upper(first))


def _rest(c: Column, start: int = 2) -> Column:
    return F.substr(c, F.lit(start))


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(_rest(c)))


def snake_case(c: Column) -> Column:
    spaced = F.regexp_replace(c, F.lit("(?d)(.)([A-Z][a-z]+)"), F.lit("$1_$2"))
    return F.lower(F.regexp_replace(spaced, F.lit("([a-z0-9])([A-Z])"), F.lit("$1_$2")))


def upper_snake_case(c: Column) -> Column:
    return F.upper(snake_case(c))


def kebab_case(c: Column) -> Column:
    return F.translate(snake_case(c), "_", "-")


def pascal_case(c: Column) -> Column:
    joined = F.array_join(F.transform(F.split(c, "_", -1), capitalize), "")
    return F.when(F.contains(c, F.lit("_")), joined).otherwise(
        F.concat(F.upper(F.left(c, F.lit(1))), _rest(c))
    )


def camel_case(c: Column) -> Column:
    lowered_first = let(pascal_case(c), lambda p: F.concat(F.lower(F.left(p, F.lit(1))), _rest(p)))
    return F.when(is_upper(c), F.lower(c)).otherwise(lowered_first)


def match_case(pattern_word: Column, replacement: Column) -> Column:
    return (
        F.when(is_upper(pattern_word), F.upper(replacement))
        .when(starts_upper(pattern_word), capitalize(replacement))
        .otherwise(replacement)
    )


def _irregular(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


_PLURALS = IRREGULAR_PLURALS
_SINGULARS = {plural: singular for singular, plural in IRREGULAR_PLURALS.items()}


def pluralize(c: Column) -> Column:
    low = F.lower(c)
    known = F.element_at(_irregular(_PLURALS), low)

    def suffix(s: str) -> Column:
        return F.when(is_upper(c), F.lit(s.upper())).otherwise(F.lit(s))

    return (
        F.when(known.isNotNull(), match_case(c, known))
        .when(F.rlike(low, F.lit(r"(?:s|x|z|ch|sh)\z")), F.concat(c, suffix("es")))
        .when(
            F.rlike(low, F.lit(r"(?s)[^aeiou]y\z")),
            F.concat(F.left(c, F.length(c) - 1), suffix("ies")),
        )
        .otherwise(F.concat(c, suffix("s")))
    )


def singularize(c: Column) -> Column:
    low = F.lower(c)
    known = F.element_at(_irregular(_SINGULARS), low)
    return (
        F.when(known.isNotNull(), match_case(c, known))
        .when(
            F.rlike(low, F.lit(r"(?s)[^aeiou]ies\z")),
            F.concat(F.left(c, F.length(c) - 3), F.when(is_upper(c), F.lit("Y")).otherwise(F.lit("y"))),
        )
        .when(F.rlike(low, F.lit(r"(?:ches|shes|xes|zes|sses)\z")), F.left(c, F.length(c) - 2))
        .when(
            F.rlike(low, F.lit(r"(?s).s\z")) & ~F.rlike(low, F.lit(r"(?:ss|us|is)\z")),
            F.left(c, F.length(c) - 1),
        )
        .otherwise(c)
    )


FAMILIES = [
    ("pascal", pascal_case),
    ("camel", camel_case),
    ("upper_snake", upper_snake_case),
    ("snake", snake_case),
    ("kebab", kebab_case),
]


def with_forms(df: DataFrame, col: str, out: str = "forms") -> DataFrame:
    """df with `out`: array<struct<family, form, tag>>, every case family of df[col] as
    given, in the plural and in the singular; empty forms dropped; the first derivation of
    a form is kept. The steps are separate projections, so each form is computed once."""
    kept = df.columns
    based = df.select(*kept, *[fn(F.col(col)).alias(f"_{family}") for family, fn in FAMILIES])

    def entry(family: str, form: Column, tag: str) -> Column:
        return F.struct(F.lit(family).alias("family"), form.alias("form"), F.lit(tag).alias("tag"))

    every = [
        entry(family, form, tag)
        for family, _ in FAMILIES
        for base in [F.col(f"_{family}")]
        for form, tag in [(base, "as_is"), (pluralize(base), "plural"), (singularize(base), "singular")]
    ]
    full = based.select(*kept, F.array(*every).alias("_forms")).withColumn("_texts", F.col("_forms")["form"])
    first = F.filter(
        "_forms", lambda x, i: (x["form"] != "") & (F.array_position(F.col("_texts"), x["form"]) == i + 1)
    )
    return full.select(*kept, first.alias(out))


def with_form_set(df: DataFrame, col: str, out: str) -> DataFrame:
    """df with one row per distinct form of df[col]."""
    exploded = with_forms(df, col, "_f").select(*df.columns, F.explode_outer("_f").alias("_one"))
    return exploded.where(F.col("_one").isNotNull()).select(*df.columns, F.col("_one")["form"].alias(out))


def name_forms(df: DataFrame, col: str) -> DataFrame:
    """df with one column per case family and the plural and singular of `col`."""
    c = F.col(col)
    return df.select(
        "*",
        *[fn(c).alias(family) for family, fn in FAMILIES],
        pluralize(c).alias("plural"),
        singularize(c).alias("singular"),
    )
