"""POSIX path helpers as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(p: Column) -> Column:
    return F.element_at(F.split(p, "/", -1), -1)


def parent(p: Column) -> Column:
    """Everything before the last slash; '' at the top."""
    return F.regexp_replace(p, F.lit(r"(?s)(?:^|/)[^/]*+\z"), F.lit(""))



def suffix(p: Column) -> Column:
    return F.regexp_extract(basename(p), r"(?s).(\.[^.]+)\z", 1)


def stem(p: Column) -> Column:
    name = basename(p)
    return F.left(name, F.length(name) - F.length(suffix(p)))


def normalize(p: Column) -> Column:
    """Collapse '.', '..' and empty segments of a relative path; '..' above the top stays."""

    def step(acc: Column, seg: Column) -> Column:
        climbs = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != "..")
        return (
            F.when(seg.isin("", "."), acc)
            .when((seg == "..") & climbs, F.slice(acc, F.lit(1), F.size(acc) - 1))
            .otherwise(F.concat(acc, F.array(seg)))
        )

    empty = F.array().cast("array<string>")
    return F.array_join(F.aggregate(F.split(p, "/", -1), empty, step), "/")


def join(base: Column, rest: Column) -> Column:
    return F.when(base == "", rest).otherwise(F.concat(base, F.lit("/"), rest))


def depth(p: Column) -> Column:
    return F.size(F.split(p, "/", -1))
