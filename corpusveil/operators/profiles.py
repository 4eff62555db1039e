"""Per-language choice of Column builders; further languages register a profile."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusveil import values as v
from corpusveil.functions import modules, text


@dataclass(frozen=True)
class Profile:
    key: str
    label: str
    extensions: list[str]
    default_src: str
    type_order: list[str]
    type_labels: dict[str, str]
    strip_comments: Callable[[Column], Column]
    strip_doc_tags: Callable[[Column], Column]
    strip_loggers: Callable[[Column], Column]
    literals: Callable[[Column], Column]
    # (module_id, text) -> type
    classify: Callable[[Column, Column], Column]
    # (text, path below the source root) -> module id
    module_id: Callable[[Column, Column], Column]
    # module id -> path expected for it
    expected_path: Callable[[Column], Column]


PROFILES: dict[str, Profile] = {}


def register(profile: Profile) -> None:
    PROFILES[profile.key] = profile


register(
    Profile(
        key=v.SPRING,
        label="Spring Boot (Java)",
        extensions=v.EXTENSIONS[v.SPRING],
        default_src="src/main/java",
        type_order=v.TYPE_ORDER[v.SPRING],
        type_labels=v.TYPE_LABELS[v.SPRING],
        strip_comments=text.strip_comments_java,
        strip_doc_tags=text.strip_doc_tags,
        strip_loggers=text.strip_loggers_java,
        literals=text.java_literals,
        classify=lambda module_id, source: modules.classify_java(module_id),
        module_id=modules.module_id_java,
        expected_path=lambda m: F.concat(F.replace(m, F.lit("."), F.lit("/")), F.lit(".java")),
    )
)
register(
    Profile(
        key=v.REACT,
        label="React (JS/TS)",
        extensions=v.EXTENSIONS[v.REACT],
        default_src="src",
        type_order=v.TYPE_ORDER[v.REACT],
        type_labels=v.TYPE_LABELS[v.REACT],
        strip_comments=text.strip_comments_react,
        strip_doc_tags=text.strip_doc_tags,
        strip_loggers=text.strip_loggers_react,
        literals=text.react_literals,
        classify=modules.classify_react,
        module_id=lambda source, path: modules.module_id_react(path, F.lit("")),
        expected_path=lambda m: m,
    )
)


def by_lang(lang: Column | str, name: str, *args: Column) -> Column:
    """Apply the profile function `name`: fixed for a language name, chosen per row for a
    language column (unknown languages use the default profile)."""
    if isinstance(lang, str):
        return getattr(PROFILES[lang], name)(*args)
    chain = F
    for key, profile in PROFILES.items():
        if key != v.DEFAULT_LANG:
            chain = chain.when(lang == key, getattr(profile, name)(*args))
    return chain.otherwise(getattr(PROFILES[v.DEFAULT_LANG], name)(*args))
