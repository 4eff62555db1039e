"""Language, identity and type of a source file as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusveil import values as v
from corpusveil.functions import paths


def infer_lang(path: Column) -> Column:
    ext = F.lower(paths.suffix(path))
    chain = F
    for lang, known in v.EXTENSIONS.items():
        chain = chain.when(ext.isin(known), lang)
    return chain.otherwise(v.DEFAULT_LANG)


def resolve_lang(flag: Column, stored: Column) -> Column:
    """Explicit choice, else the stored language, else the default; unknown means default."""
    wanted = F.coalesce(F.nullif(flag, F.lit("")), F.nullif(stored, F.lit("")), F.lit(v.DEFAULT_LANG))
    return F.when(wanted.isin(list(v.EXTENSIONS)), wanted).otherwise(v.DEFAULT_LANG)


def module_id_java(text: Column, path: Column) -> Column:
    package = F.regexp_extract(text, v.JAVA_PACKAGE, 1)
    declared = F.regexp_extract(text, v.JAVA_CLASS, 1)
    name = F.when(declared == "", paths.stem(path)).otherwise(declared)
    return F.when(package == "", name).otherwise(F.concat(package, F.lit("."), name))


def module_id_react(path: Column, root: Column) -> Column:
    """Path below the source root, or the bare file name outside of it."""
    clean, top = paths.normalize(path), paths.normalize(root)
    below = F.startswith(clean, F.concat(top, F.lit("/")))
    return (
        F.when((top == "") & ~F.startswith(clean, F.lit("../")), clean)
        .when(below, F.substr(clean, F.length(top) + 2))
        .otherwise(paths.basename(clean))
    )


def classify_java(module_id: Column) -> Column:
    low = F.lower(module_id)
    chain = F
    for kind, words in v.JAVA_TYPE_WORDS:
        chain = chain.when(reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in words]), kind)
    return chain.otherwise(v.JAVA_TYPE_DEFAULT)


def classify_react(module_id: Column, text: Column) -> Column:
    low = F.lower(module_id)
    segments = F.split(low, "/", -1)

    def has_segment(kind: str) -> Column:
        return F.arrays_overlap(segments, F.array(*[F.lit(s) for s in v.REACT_SEGMENTS[kind]]))

    def ends(*endings: str) -> Column:
        return reduce(Column.__or__, [F.endswith(low, F.lit(e)) for e in endings])

    in_context = reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in v.REACT_CONTEXT_WORDS])
    return (
        F.when(F.rlike(paths.stem(module_id), F.lit(v.HOOK_STEM)) | has_segment("hook"), "hook")
        .when(in_context, "context")
        .when(ends(".d.ts") | has_segment("types"), "types")
        .when(has_segment("api"), "api")
        .when(has_segment("util"), "util")
        .when(
            ends(".tsx", ".jsx") | has_segment("component") | F.rlike(text, F.lit(v.JSX_ELEMENT)),
            "component",
        )
        .when(F.rlike(text, F.lit(v.API_CALL)), "api")
        .otherwise("module")
    )
