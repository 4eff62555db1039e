"""The cleaning job: rename, strip, mask, strip loggers, trim - in this order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusveil.functions.text import strip_spaces
from corpusveil.operators import literals as L
from corpusveil.operators.profiles import by_lang
from corpusveil.operators.rename import rename_text
from corpusveil.operators.rules import content_rules
from corpusveil.session import materialize


@dataclass(frozen=True)
class Options:
    strip_comments: bool = True
    strip_doc_tags: bool = True
    strip_loggers: bool = True
    mask_strings: bool = False


KEEP_ALL = Options(strip_comments=False, strip_doc_tags=False, strip_loggers=False)
STRIP_ALL = Options(mask_strings=True)


def before_mask(
    df: DataFrame, id_cols: list[str], col: str, mappings: DataFrame, options: Options, lang: Column | str
) -> DataFrame:
    """Renamed text without comments and doc tags: the state in which literals are recorded."""
    renamed = rename_text(df, id_cols, col, content_rules(mappings))
    text = F.col(col)
    if options.strip_comments:
        text = by_lang(lang, "strip_comments", text)
    if options.strip_doc_tags:
        text = by_lang(lang, "strip_doc_tags", text)
    return renamed.withColumn(col, text)


def after_mask(df: DataFrame, col: str, options: Options, lang: Column | str) -> DataFrame:
    text = F.col(col)
    if options.strip_loggers:
        text = by_lang(lang, "strip_loggers", text)
    return df.withColumn(col, strip_spaces(text))


def sanitize(
    df: DataFrame,
    id_cols: list[str],
    col: str,
    mappings: DataFrame,
    options: Options,
    lang: Column | str,
    dictionary: DataFrame | None = None,
) -> DataFrame:
    """Clean texts with a given dictionary."""
    if options.mask_strings and dictionary is None:
        raise ValueError("masking without a dictionary cannot be undone: pass a dictionary or use sanitize_corpus")
    staged = before_mask(df, id_cols, col, mappings, options, lang)
    if options.mask_strings:
        staged = L.mask_literals(staged, id_cols, col, lang, dictionary)
    return after_mask(staged, col, options, lang)


def sanitize_corpus(
    df: DataFrame,
    id_cols: list[str],
    col: str,
    mappings: DataFrame,
    options: Options,
    lang: Column | str,
    order: list[str],
    existing: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """Clean a corpus and build the dictionary it needs. `order` are columns of df that
    say which text is seen first; numbering continues after `existing`."""
    staged = before_mask(df, id_cols, col, mappings, options, lang)
    dictionary = existing
    if options.mask_strings:
        # read twice, once for its literals and once to mask them: cheaper stored than renamed again
        staged = materialize(staged, "renamed")
        keys = list(dict.fromkeys([*id_cols, *order]))
        found = L.extract_literals(staged, keys, col, lang)
        dictionary = L.build_dictionary(found, [*order, "pos"], existing)
        staged = L.mask_literals(staged, id_cols, col, lang, dictionary)
    return after_mask(staged, col, options, lang), dictionary
