"""Literals found inside words by their rarest characters in a row.

Literals: literal (distinct). Words: word (distinct); both are read more than once, so they
should be stored tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusveil.plans.joins import fits_broadcast, salted_join
from corpusveil.session import materialize

GRAM = 4
PIECE_CHARS = 1_024
#: Longest literal that is its own key; a longer one is known by its hash and length.
KEY_CHARS = 64


def grams(text: Column, n: int) -> Column:
    """Every run of n characters, the k-th of which begins at place k. A match takes one whole
    character, so a character outside the basic plane is one place too."""
    return F.regexp_extract_all(text, F.lit("(?s)(?=(.{%d}))." % n), F.lit(1))


def anchor_index(literals: DataFrame, words: DataFrame) -> DataFrame:
    """Where to look for literals in words: gram, skip, len. A literal of GRAM characters or more
    is looked for by the one of its grams that is rarest in the words, `skip` characters into it;
    one with a gram that no word has is not looked for. A shorter literal is its own gram.

    Literals that agree in all three are one row, so a place opens a row per class of length and
    not per literal."""
    known = F.when(F.length("literal") <= KEY_CHARS, F.col("literal")).otherwise(F.sha2("literal", 256))
    long = literals.where(F.length("literal") >= GRAM).select(
        known.alias("key"), F.length("literal").alias("len"), F.posexplode(grams(F.col("literal"), GRAM)).alias("skip", "gram")
    )
    counts = materialize(words.select(F.explode(grams(F.col("word"), GRAM)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "grams")
    # the grams of very many literals stay where they are if those of the words can come to them
    rarest = (
        long.join(F.broadcast(counts) if fits_broadcast(counts) else counts, "gram", "left")
        .groupBy("key", "len")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "skip", "gram")).alias("a"))
        .where("a.n > 0")
    )
    short = literals.where(F.length("literal") < GRAM).select(
        F.col("literal").alias("gram"), F.lit(0).alias("skip"), F.length("literal").alias("len")
    )
    return rarest.select("a.gram", "a.skip", "len").unionByName(short).distinct()


def open_places(words: DataFrame, literals: DataFrame) -> DataFrame:
    """Places that may hold a literal: word, at, len, w (the character before the place, or a
    blank, then `len` characters, then at most two more). Whether those `len` characters are a
    literal is for an equi-join to say. No place that holds one is missing; a place may come twice.

    A word is read in pieces of bounded length with as much around them as the longest literal
    needs, so the work is linear in the length of a word, which may be a whole text."""
    # at most GRAM sizes
    size = literals.agg(F.max(F.length("literal")).alias("longest"), F.collect_set(F.least(F.length("literal"), F.lit(GRAM))).alias("sizes")).first()
    longest, sizes = size.longest or 1, sorted(size.sizes) or [GRAM]
    index = materialize(anchor_index(literals, words), "anchors")
    step = max(PIECE_CHARS, 4 * longest)
    cut = words.where(F.length("word") > 0).select(
        "word", F.explode(F.sequence(F.lit(0), F.floor((F.length("word") - 1) / step).cast("int"))).alias("_piece")
    ).withColumn("_base", F.col("_piece") * step)
    # the character before the word is a blank; `around` begins _low characters into both
    low = F.greatest(F.col("_base") - longest - 1, F.lit(0))
    around = F.substr(F.concat(F.lit(" "), "word"), low + 1, F.lit(step + 2 * longest + GRAM + 4))
    core = F.substr("word", F.col("_base") + 1, F.lit(step + GRAM - 1))
    runs = F.concat(
        *[F.transform(grams(core, n), lambda g, i: F.struct(i.cast("int").alias("at"), g.alias("gram"))) for n in sizes]
    )

    def opened(places: DataFrame) -> DataFrame:
        return places.withColumn("at", F.col("_base") + F.col("_run.at") - F.col("skip")).where("at >= 0")

    if fits_broadcast(index):
        # made before the rows: what stands beside a generator is computed for each of its rows
        whole = cut.select("word", "_base", low.alias("_low"), around.alias("_around"), runs.alias("_runs"))
        seen = whole.select("word", "_base", "_low", "_around", F.explode("_runs").alias("_run"))
        hits = opened(seen.withColumn("gram", F.col("_run.gram")).join(F.broadcast(index), "gram"))
    else:
        # only the name of a piece travels with a place. Words that share a name are opened at each
        # other's places too, where they hold the literals they hold
        named = cut.withColumn("_word", F.xxhash64("word"))
        seen = named.select("_word", "_piece", "_base", F.explode(runs).alias("_run")).withColumn("gram", F.col("_run.gram"))
        places = opened(salted_join(seen, index, ["gram"], ["_word", "_piece", "_run"])).select("_word", "_piece", "at", "len").distinct()
        hits = named.select("_word", "_piece", "word", low.alias("_low"), around.alias("_around")).join(places, ["_word", "_piece"])
    # generated, so that it is cut out once and not for every use
    window = F.substr("_around", F.col("at") - F.col("_low") + 1, F.col("len") + 3)
    return hits.select("word", "at", "len", F.explode(F.array(window)).alias("w")).where(F.length("w") > F.col("len"))
