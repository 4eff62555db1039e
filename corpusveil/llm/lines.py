"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only.

Distinct lines first, as hashes with the place where each is seen first. Lines within one
edit of each other agree in their first or their last half, so only lines that share half
of their text with another one go on. These emit the hashes of all variants with one
character deleted; equal variants meet, the edit distance is verified, and the earlier line
stays. Lines that differ in the same place all meet in one variant, and a line meets its
own insertions in itself: neither needs pairs within a group, only its earliest line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusveil.functions.columns import let
from corpusveil.llm.frames import only_keys
from corpusveil.session import materialize

#: Shorter lines are compared for equality only: one edit changes what they say.
NEAR_CHARS = 32
#: Characters of a block; of a long line only the block with the deletion is spelled out.
BLOCK = 64


def _halves(line: Column, n: Column) -> list[Column]:
    """Hashes of the first and last m characters for both m that a line one shorter, equal or one
    longer may have as half."""
    out = []
    for m in (F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")):
        out.append(F.xxhash64(F.lit(1), m, F.substring(line, F.lit(1), m)))
        out.append(F.xxhash64(F.lit(2), m, F.substring(line, n - m + 1, m)))
    return out


def _variants(line: Column, n: Column, late: Column, early: Column) -> Column:
    """array<struct<key, i>>: a key for each deleted place i (from 1) of the late or early part, and
    for each block the key (i = 0) that a line one character longer has with that character deleted."""

    def of_block(b: Column) -> Column:
        start = b * BLOCK
        before = F.xxhash64(F.substring(line, F.lit(1), start))

        def inside(block: Column) -> Column:
            places = F.filter(
                F.sequence(F.lit(1), F.greatest(F.length(block), F.lit(1))),
                lambda i: (F.length(block) > 0) & ((late & (start + i > F.floor((n - 1) / 2))) | (early & (start + i <= F.floor(n / 2) + 1))),
            )
            return let(
                F.struct(before.alias("p"), F.xxhash64(F.substring(line, start + BLOCK + 1, n)).alias("s")),
                lambda ends: F.transform(
                    places,
                    lambda i: F.struct(
                        F.xxhash64(n - 1, b, ends["p"], F.concat(F.substring(block, F.lit(1), i - 1), F.substring(block, i + 1, F.lit(BLOCK))), ends["s"]).alias("key"),
                        (start + i).alias("i"),
                    ),
                ),
            )

        own = F.struct(
            F.xxhash64(n, b, before, F.substring(line, start + 1, F.lit(BLOCK - 1)), F.xxhash64(F.substring(line, start + BLOCK, n))).alias("key"),
            F.lit(0).alias("i"),
        )
        return F.concat(let(F.substring(line, start + 1, F.lit(BLOCK)), inside), F.array(own))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.floor(n / BLOCK).cast("int")), of_block))


def _near_lines(uniq: DataFrame, lines: DataFrame) -> DataFrame:
    """(lid): distinct lines that an earlier line is within one edit of."""
    keyed = uniq.where("n >= 0").select("lid", F.posexplode(F.array("k0", "k1", "k2", "k3")).alias("side", "key"))
    shared = materialize(
        keyed.select("lid", "key").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "halves"
    )
    even = (F.col("side") % 2) == 0
    alive = (
        only_keys(keyed, "key", shared).join(shared, "key", "left_semi").groupBy("lid")
        .agg(F.max(even).alias("late"), F.max(~even).alias("early"))
    )
    wanted = materialize(uniq.join(alive, "lid").select("lid", "h1", "doc_id", "row", "pos", "n", "late", "early"), "alive")
    # the first place of each such line, and so its text once
    here = only_keys(lines.select("doc_id", "row", "pos", "line", "h1"), "h1", wanted.select("h1"))
    place = wanted.withColumnRenamed("h1", "_h1").withColumnRenamed("doc_id", "_doc")
    texts = materialize(
        here.join(place, ["row", "pos"]).where((F.col("h1") == F.col("_h1")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
        .dropDuplicates(["lid"]).select("lid", "line", "n", "late", "early", F.struct("doc_id", "row", "pos").alias("place")),
        "alive",
    )
    variants = texts.select("lid", F.explode(_variants(F.col("line"), F.col("n"), F.col("late"), F.col("early"))).alias("v")).select(
        "lid", F.col("v.key").alias("key"), F.col("v.i").alias("i")
    )
    met = variants.groupBy("key").agg(F.min("lid").alias("a"), F.max("lid").alias("b")).where("a < b").select("key")
    met = materialize(met, "variants")
    rows = materialize(
        only_keys(variants, "key", met).join(met, "key", "left_semi").distinct().join(texts.select("lid", "place"), "lid"), "variants"
    )
    first = rows.where("i > 0").groupBy("key", "i").agg(F.min(F.struct("place", "lid")).alias("first"))
    replaced = rows.join(first, ["key", "i"]).select(
        "lid", "place", F.col("first")["lid"].alias("other"), F.col("first")["place"].alias("other_place")
    )
    short = rows.where("i = 0").select("key", F.col("lid").alias("other"), F.col("place").alias("other_place"))
    inserted = rows.where("i > 0").join(short, "key").select("lid", "place", "other", "other_place")
    both = replaced.unionByName(inserted).where("lid <> other")
    later = F.col("place") > F.col("other_place")
    pairs = both.select(F.when(later, F.col("lid")).otherwise(F.col("other")).alias("lid"), F.when(later, F.col("other")).otherwise(F.col("lid")).alias("other")).distinct()
    old = texts.select(F.col("lid").alias("other"), F.col("line").alias("old"))
    verified = pairs.join(texts.select("lid", "line"), "lid").join(old, "other").where(F.levenshtein("line", "old", 1) >= 0)
    return verified.select("lid").distinct()


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_chars: int = NEAR_CHARS) -> DataFrame:
    """df with text_col rebuilt of the lines that stay, and n_lines, n_kept (lines that are not blank).

    Lines end at line feeds. Of equal lines the first stays, in the order of (id, place in the
    text). A line of at least near_chars characters also goes if an earlier line of that length
    is within one edit (insertion, deletion, replacement) of it, whether that line stays or
    not. Blank lines stay; a text without any other line left is empty. A null text stays
    null; a null id comes first. Rows that agree in id and text are one document and keep the
    same lines. Extra columns stay as they are. df is read three times: pass a stored table.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    cut = F.split("text", "\n", -1)
    blank = lambda x: F.trim(F.translate(x, "\t\r\f\v", "")) == ""
    lines = docs.select("doc_id", "row", F.posexplode(cut).alias("pos", "line")).where(~blank(F.col("line")))
    lines = lines.withColumn("h1", F.xxhash64("line"))
    n = F.length("line")
    near = n >= near_chars
    slim = lines.select(
        "doc_id", "row", "pos", "h1", F.xxhash64(F.lit(1), "line").alias("h2"),
        F.when(near, n).otherwise(-1).alias("n"), *[F.when(near, k).otherwise(0).alias(f"k{i}") for i, k in enumerate(_halves(F.col("line"), n))],
    )
    uniq = materialize(
        slim.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "row", "pos")).alias("at"), *[F.max(c).alias(c) for c in ("n", "k0", "k1", "k2", "k3")])
        .select(F.monotonically_increasing_id().alias("lid"), "h1", "at.doc_id", "at.row", "at.pos", "n", "k0", "k1", "k2", "k3"),
        "lines",
    )
    gone = _near_lines(uniq, lines)
    kept = (
        uniq.select("lid", "doc_id", "row", "pos").join(gone, "lid", "left_anti").groupBy(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"))
        .agg(F.collect_list("pos").alias("_kept"))
    )
    whole = df.withColumn("_hash", F.xxhash64(text_col)).join(kept, F.col(id_col).eqNullSafe(F.col("_doc")) & (F.col("_hash") == F.col("_row")), "left")

    def made(parts: Column, flags: Column) -> Column:
        blanks = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.element_at(flags, i + 1))
        text = F.array_join(F.transform(F.array_sort(F.concat("_kept", blanks)), lambda i: F.element_at(parts, i + 1)), "\n")
        return F.struct(F.when(F.col("_kept").isNull(), "").otherwise(text).alias("text"), F.size(F.filter(flags, lambda x: ~x)).alias("n"))

    # the lines and their flags are worked out once for a text
    rebuilt = let(F.split(F.col(text_col).cast("string"), "\n", -1), lambda ps: let(F.transform(ps, blank), lambda flags: made(ps, flags)))
    whole = whole.withColumn("_made", F.when(F.col(text_col).isNotNull(), rebuilt))
    columns = [c for c in df.columns if c not in ("n_lines", "n_kept")]
    return whole.select(
        *[F.col("_made")["text"].alias(c) if c == text_col else F.col(c) for c in columns],
        F.coalesce(F.col("_made")["n"], F.lit(0)).cast("bigint").alias("n_lines"), F.coalesce(F.size("_kept"), F.lit(0)).cast("bigint").alias("n_kept"),
    )
