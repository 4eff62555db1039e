"""Small Column helpers shared by the operators."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "\u0001"
INLINE_MAX_ENTRIES = 20_000
INLINE_MAX_CHARS = 1_000_000


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pieces(text: Column, pattern: str) -> Column:
    """Split text into [gap, match, gap, match, ..., gap].

    One regex pass marks the matches, a plain one-character split takes the
    marked text apart. Texts that contain the mark itself take the second branch.
    """
    marked = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(MARK + "$0" + MARK)), MARK, -1)
    gaps = F.split(text, pattern, -1)
    hits = F.concat(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array(F.lit("")))
    zipped = F.flatten(F.zip_with(gaps, hits, lambda g, h: F.array(g, h)))
    exact = F.slice(zipped, F.lit(1), F.size(zipped) - 1)
    return F.when(F.contains(text, F.lit(MARK)), exact).otherwise(marked)


def is_match(index: Column) -> Column:
    """Matches sit at the odd places of pieces()."""
    return index % 2 == 1


def replace_matches(text: Column, pattern: str, replace) -> Column:
    """Rewrite every match of pattern with replace(match)."""
    return F.array_join(
        F.transform(
            pieces(text, pattern),
            lambda p, i: F.when(is_match(i), replace(p)).otherwise(p),
        ),
        "",
    )


def collect_dictionary(df: DataFrame, key: str, value: str):
    """A lookup function Column -> Column over a small dictionary carried in the plan.

    The size is checked before anything is read. Returns None when the dictionary is
    over the bounds, so the caller joins instead. Entries are spread over buckets
    because a map lookup scans its keys.
    """
    entries = df.select(F.col(key).alias("k"), F.col(value).alias("v"), F.xxhash64(key).alias("h"))
    size = (
        entries.limit(INLINE_MAX_ENTRIES + 1)
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("k") + F.length("v")), F.lit(0)).alias("chars"))
        .first()
    )
    if size.n > INLINE_MAX_ENTRIES or size.chars > INLINE_MAX_CHARS:
        return None
    rows = entries.collect()
    return bucket_lookup([(r.k, r.v, r.h) for r in rows])


def bucket_lookup(entries: list[tuple[str, str, int]]):
    """Lookup function over (key, value, xxhash64 of the key) entries, as one plan literal."""
    n = max(1, len(entries) // 4)
    buckets: list[dict[str, str]] = [{} for _ in range(n)]
    for key, value, code in entries:
        buckets[code % n][key] = value
    stored = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,string>>")

    def lookup(word: Column) -> Column:
        place = F.pmod(F.xxhash64(word), F.lit(n)).cast("int") + 1
        return F.element_at(F.element_at(stored, place), word)

    return lookup
