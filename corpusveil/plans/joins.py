"""Join helpers for keys that may be hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusveil.functions.columns import let
from corpusveil.session import parallelism

SALTS = 8
SMALL_ROWS = 1_000_000


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], spread: list[str], how: str = "inner") -> DataFrame:
    """Equi-join of a side whose keys may be hot (a third of its rows on one key) with a
    side that has few rows per key. Rows of one hot key are spread over SALTS tasks by the
    `spread` columns; the few side is repeated once per salt."""
    salted = many.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    repeated = few.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    # not by the planner's guess of the few side, which is the size of compressed files without their copies
    return salted.join(repeated.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def hot_key_join(
    many: DataFrame, few: DataFrame, keys: list[str], spread: list[str], how: str = "inner", rows: int | None = None
) -> DataFrame:
    """As salted_join for a few side that is large itself: only keys that hold more than a
    thousandth of the many side are spread and repeated. There are at most 1,000 of them,
    so their list may be broadcast. Up to SMALL_ROWS rows no key can hurt and the join is
    plain. `many` is read more than once: pass a stored table, and its `rows` if known."""
    rows = many.count() if rows is None else rows
    if rows <= SMALL_ROWS:
        # not by the planner's guess of the few side, which is the size of compressed files
        return many.join(few.hint("merge"), keys, how)
    least = rows // 1000
    hot = many.groupBy(*keys).count().where(F.col("count") > least).select(*keys, F.lit(True).alias("_hot"))
    spread_salt = F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")
    salted = many.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.when(F.col("_hot"), spread_salt).otherwise(F.lit(0))
    ).drop("_hot")
    everyone = F.array(*[F.lit(i) for i in range(SALTS)])
    repeated = few.join(F.broadcast(hot), keys, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), everyone).otherwise(F.array(F.lit(0))))
    ).drop("_hot")
    return salted.join(repeated.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def bucketed_join(
    many: DataFrame, few: DataFrame, keys: list[str], spread: list[str], rows: int | None = None, buckets: int | None = None
) -> DataFrame:
    """Inner equi-join as hot_key_join with a few side that is a table bucketed by the keys, which
    stays where it is. Of a key that holds more than a thousandth of a large many side only the
    rows of that key move, once per salt. `many` is read more than once: pass a stored table.
    `buckets` is the table's number of buckets where it is not that of a shuffle."""
    rows = many.count() if rows is None else rows
    dealt = many.repartition(buckets, *keys) if buckets else many
    if rows <= SMALL_ROWS:
        return dealt.hint("shuffle_hash").join(few, keys)
    # at most 1,000 keys
    hot = many.groupBy(*keys).count().where(F.col("count") > rows // 1000).select(*keys)
    rest = dealt.join(F.broadcast(hot), keys, "left_anti").join(few.hint("merge"), keys)
    heavy = many.join(F.broadcast(hot), keys, "left_semi")
    return rest.unionByName(salted_join(heavy, few.join(F.broadcast(hot), keys, "left_semi"), keys, spread))


BROADCAST_ROWS = 500_000
BROADCAST_CHARS = 100_000_000


def fits_broadcast(few: DataFrame) -> bool:
    """Whether a table is small enough to be sent to every task. `few` should be a stored table:
    it is measured here."""
    texts = [F.col(c) for c, t in few.dtypes if t == "string"] + [F.array_join(c, "") for c, t in few.dtypes if t == "array<string>"]
    chars = F.sum(sum((F.coalesce(F.length(c), F.lit(0)) for c in texts), F.lit(0)))
    size = few.limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(chars, F.lit(0)).alias("c")).first()
    return size.n <= BROADCAST_ROWS and size.c <= BROADCAST_CHARS


def dictionary_join(many: DataFrame, few: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
    """Inner join of very many rows with a dictionary that is unique by key. A dictionary of
    checked size is broadcast, so the many side is not shuffled at all; a larger one takes
    the salted join. `few` should be a stored table: it is measured first."""
    if fits_broadcast(few):
        return many.join(F.broadcast(few), keys)
    return salted_join(many, few, keys, spread)


CHUNK = 256


def substitute(
    df: DataFrame, id_cols: list[str], col: str, parts: Column, dictionary: DataFrame, out: str, render,
    count: str | None = None, keys: Column | None = None,
) -> DataFrame:
    """Rebuild the texts of `col` from parts (array<struct<text, key>>, which give the text when joined)
    by a dictionary (key, value, n) of any size: a part whose key is known becomes render(text, value).
    `count` receives the sum of n over the replaced parts. `keys`, if given, are the keys of every
    second part in order, for where they are cheaper to read than the parts.

    Rows are told apart by a hash of their ids and text, never by ids alone: ids may be null
    or repeated. Rows that share it (repeated rows, or a collision) share the entries that any
    of them asked for, and an entry says the same in every text.

    Texts are shuffled by that hash before they are cut, so cutting them hangs neither on how the
    input lies nor on the bytes of a shuffle; with a broadcast dictionary the lookup, both groupings
    and the way back to the text need no further shuffle. A text is looked up in chunks of CHUNK parts: a map lookup
    scans its keys, and so a long text costs no more per part than a short one.
    """

    def chunks(ps: Column, size: int, body) -> Column:
        last = F.ceil(F.size(ps) / size).cast("int") - 1
        return F.transform(
            F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: body(i, F.slice(ps, i * size + 1, F.lit(size)))
        )

    row = ["_row"]
    df = df.withColumn("_row", F.xxhash64(*id_cols, col)).repartition(parallelism(df.sparkSession), "_row")
    asked, size = (parts["key"], CHUNK) if keys is None else (keys, CHUNK // 2)
    wanted = let(asked, lambda ks: chunks(ks, size, lambda i, c: F.array_distinct(F.array_compact(c))))
    found = df.select(*row, F.posexplode(wanted).alias("_chunk", "_keys")).select(*row, "_chunk", F.explode("_keys").alias("key"))
    entry = F.struct("key", F.struct("value", "n").alias("v"))
    hits = dictionary_join(found, dictionary.select("key", "value", "n"), ["key"], [*row, "_chunk"])
    # a group is a chunk, then a text
    per_text = (
        hits.groupBy(*row, "_chunk")
        .agg(F.map_from_entries(F.collect_set(entry)).alias("_map"))
        .groupBy(*row)
        .agg(F.map_from_entries(F.collect_list(F.struct("_chunk", "_map"))).alias("_maps"))
    )

    def added(ns: Column) -> Column:
        return F.aggregate(ns, F.lit(0), lambda acc, n: acc + n)

    def same(chunk: Column) -> Column:
        text = F.array_join(chunk["text"], "")
        return F.struct(text.alias("text"), F.lit(0).alias("n")) if count else text

    def changed(chunk: Column, known: Column) -> Column:
        """The text of a chunk, and the sum of n if it is asked for."""

        def text(p: Column, hit: Column) -> Column:
            return F.when(hit.isNotNull(), render(p["text"], hit["value"])).otherwise(p["text"])

        def counted(p: Column) -> Column:
            made = let(F.element_at(known, p["key"]), lambda h: F.struct(text(p, h).alias("text"), F.coalesce(h["n"].cast("int"), F.lit(0)).alias("n")))
            return F.when(p["key"].isNull(), F.struct(p["text"].alias("text"), F.lit(0).alias("n"))).otherwise(made)

        if not count:
            plain = F.transform(chunk, lambda p: F.when(p["key"].isNull(), p["text"]).otherwise(let(F.element_at(known, p["key"]), lambda h: text(p, h))))
            return F.array_join(plain, "")
        return let(F.transform(chunk, counted), lambda ps: F.struct(F.array_join(ps["text"], "").alias("text"), added(ps["n"]).alias("n")))

    def replaced(i: Column, chunk: Column) -> Column:
        return let(F.element_at("_maps", i), lambda known: F.when(known.isNull(), same(chunk)).otherwise(changed(chunk, known)))

    # a text without hits is not cut again
    joined = df.join(per_text, row, "left").withColumn(
        "_made", F.when(F.col("_maps").isNotNull(), let(parts, lambda ps: chunks(ps, CHUNK, replaced)))
    )
    made = F.col("_made")["text"] if count else F.col("_made")
    result = joined.withColumn("_text", F.when(F.col("_made").isNull(), F.col(col)).otherwise(F.array_join(made, "")))
    if count:
        result = result.withColumn(count, F.when(F.col(col).isNotNull(), F.coalesce(added(F.col("_made")["n"]), F.lit(0))))
    return result.withColumn(out, F.col("_text")).drop("_maps", "_made", "_text", "_row")
