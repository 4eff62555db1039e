"""Exact Jaccard join of word-shingle sets by a token-group matrix.

Documents with equal sets are one class. Classes that verified links join are one group
("similar documents"). The matrix holds, for every token, the groups whose token union has
it, with the smallest place it takes there for each set size; only the head of a set in
order of rarity is stored, as a partner above the threshold must agree in it. A query set
is counted against the matrix; the count bounds its overlap with every member of a group,
and only groups that reach the bound are opened, member by member, against whole sets.
Nothing is emitted within a group, so a group of n near copies costs n rows, not n^2.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusveil.llm.frames import components, only_keys
from corpusveil.llm.text_hash import mix, shingle_sets
from corpusveil.session import materialize

#: Cells of the token frequency sketch. It only sets the order of tokens, so its size changes
#: speed, never results: the more cells, the fewer common tokens in a head. Its broadcast is 8
#: bytes a cell.
CELLS = 1 << 20
#: Tokens in which the heads of two linked sets must agree.
HITS = 3
_SLICE = 4096
#: Pairs whose sets a task holds at once.
PAIRS = 256
_SEED = np.uint64(0x5BD1E995)


def _long(x) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _signature(tokens: np.ndarray) -> np.ndarray:
    """Two 64-bit sums that equal sets share."""
    if not len(tokens):
        return np.zeros(2, np.int64)
    return _long([mix(tokens).sum(dtype=np.uint64), mix(tokens ^ _SEED).sum(dtype=np.uint64)])


def _profile(size: int):
    """Batches of (doc_id, text) -> one row per document, then the task's token counts by cell."""

    def run(batches):
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            n, sig, cells, held = [], [], [], 0
            for tokens in shingle_sets(batch.column(1), size):
                n.append(len(tokens))
                sig.append(_signature(tokens))
                cells.append((tokens & np.uint64(CELLS - 1)).astype(np.int64))
                held += len(tokens)
                if held > CELLS:
                    counts += np.bincount(np.concatenate(cells), minlength=CELLS)
                    cells, held = [], 0
            counts += np.bincount(np.concatenate(cells), minlength=CELLS) if cells else 0
            sig = np.array(sig, np.int64).reshape(-1, 2)
            rows = len(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(sig[:, 0]), pa.array(sig[:, 1]),
                 pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.list_(pa.int32()))],
                ["doc_id", "n", "node", "check", "slice", "counts"],
            )
        taken = [i for i in range(CELLS // _SLICE) if counts[i * _SLICE : (i + 1) * _SLICE].any()]
        rows = len(taken)
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(rows, pa.int64())] * 4
                + [pa.array(taken, pa.int32()), pa.array([np.minimum(counts[i * _SLICE : (i + 1) * _SLICE], 2**31 - 1) for i in taken], pa.list_(pa.int32()))],
                ["doc_id", "n", "node", "check", "slice", "counts"],
            )

    return run


def _heads(size: int, percent: int, cells):
    """Batches of (doc_id, text) -> (doc_id, node, n, tokens): the rarest tokens of each set, rarest first."""

    def run(batches):
        count = cells.value
        for batch in batches:
            node, sizes, heads = [], [], []
            for tokens in shingle_sets(batch.column(1), size):
                n = len(tokens)
                keep = min(n, n - -(-percent * n // 100) + HITS)
                order = np.lexsort((tokens, count[(tokens & np.uint64(CELLS - 1)).astype(np.int64)]))[:keep]
                node.append(_signature(tokens)[0])
                sizes.append(n)
                heads.append(_long(tokens[order]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(node, pa.int64()), pa.array(sizes, pa.int64()), pa.array(heads, pa.list_(pa.int64()))],
                ["doc_id", "node", "n", "tokens"],
            )

    return run


def _verified(size: int, percent: int):
    """Batches of (a, b, text_a, text_b) -> the pairs (a, b) that link."""

    def run(batches):
        for batch in (whole.slice(k, PAIRS) for whole in batches for k in range(0, whole.num_rows, PAIRS)):
            known: dict[int, np.ndarray] = {}
            for ids, texts in ((0, 2), (1, 3)):
                keys, place = np.unique(batch.column(ids).to_numpy(), return_index=True)
                fresh = [i for k, i in zip(keys, place) if k not in known]
                taken = batch.column(texts).take(pa.array(fresh, pa.int64()))
                known |= zip(batch.column(ids).take(pa.array(fresh, pa.int64())).to_pylist(), shingle_sets(taken, size))
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            linked = []
            for x, y in zip(a, b):
                s, t = known[x], known[y]
                both = len(np.intersect1d(s, t, assume_unique=True))
                linked.append(100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def _need(a: Column, b: Column, percent: int) -> Column:
    """The overlap that two sets of sizes a and b must have to link."""
    return F.ceil(percent * (a + b) / F.lit(100 + percent) - 1e-9).cast("bigint")


def _fits(n: Column, pos: Column, m: Column, at: Column, percent: int) -> Column:
    """Sizes allow a link, and the token is in the part of both heads that must agree."""
    need = _need(n, m, percent)
    hits = F.least(F.lit(HITS), need)
    sizes = (100 * F.least(n, m) >= percent * F.greatest(n, m))
    return sizes & (pos < n - need + hits) & (at < m - need + hits)


def _link(pairs: DataFrame, reps: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets link. Only the texts of nodes in pairs move."""
    pairs = materialize(pairs, "opened")
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = materialize(nodes.join(reps, "node").select("node", "doc_id"), "wanted")
    texts = materialize(
        only_keys(docs, "doc_id", wanted).join(wanted, "doc_id").select("node", "text")
        .mapInArrow(_own(size), "node bigint, text string"),
        "texts",
    )
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    full = pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
    return materialize(full.mapInArrow(_verified(size, percent), "a bigint, b bigint"), "linked")


def _own(size: int):
    """Keeps the rows whose text has the node's set: an id may stand on several texts."""

    def run(batches):
        for batch in batches:
            own = [int(_signature(t)[0]) for t in shingle_sets(batch.column(1), size)]
            yield batch.filter(pa.array([x == y for x, y in zip(own, batch.column(0).to_pylist())], pa.bool_()))

    return run


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: the number of distinct word shingles
    and the smallest id that links of Jaccard >= percent / 100 reach.

    Null and empty texts have no shingles and are linked with nothing. Texts of fewer words
    than a shingle have one. Rows with equal sets are linked, repeated rows and repeated ids
    too. A row without id is linked with nothing and has no component. An empty table gives
    no rows. Other columns are ignored.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scanned = materialize(
        docs.mapInArrow(_profile(size), "doc_id bigint, n bigint, node bigint, check bigint, slice int, counts array<int>"), "profile"
    )
    sets = scanned.where("slice is null").select("doc_id", "n", "node", "check")
    reps = materialize(sets.where("n > 0 and doc_id is not null").groupBy("node", "n", "check").agg(F.min("doc_id").alias("doc_id")), "classes")

    cells = np.zeros(CELLS, np.int64)
    sums = (
        scanned.where("slice is not null").select("slice", F.posexplode("counts").alias("pos", "c")).where("c > 0")
        .groupBy((F.col("slice") * _SLICE + F.col("pos")).alias("cell")).agg(F.sum("c").alias("c"))
        .toArrow()  # at most CELLS rows
    )
    cells[sums["cell"].to_numpy()] = sums["c"].to_numpy()
    shared = spark.sparkContext.broadcast(cells)

    # set sizes below this one link with equal sets only
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 62
    heads = docs.mapInArrow(_heads(size, percent, shared), "doc_id bigint, node bigint, n bigint, tokens array<bigint>").where(F.col("n") >= least)
    one = reps.where(F.col("n") >= least).select("node", "doc_id")
    head_rows = materialize(
        heads.join(one, ["node", "doc_id"]).select("node", "n", F.posexplode("tokens").alias("pos", "token")),
        "heads",
    )
    # tokens of a single set bound nothing; the set in which a token stands first is its most typical holder
    holders = head_rows.groupBy("token").agg(F.count(F.lit(1)).alias("sets"), F.min(F.struct("pos", "n", "node")).alias("first")).where("sets > 1")
    rows = materialize(head_rows.join(holders.select("token", "first"), "token"), "shared")

    first = F.col("first")
    stars = (
        rows.where((F.col("node") != first["node"]) & _fits(F.col("n"), F.col("pos"), first["n"], first["pos"], percent))
        .groupBy(F.col("node").alias("a"), first["node"].alias("b")).agg(F.count(F.lit(1)).alias("hits"))
        .where(F.col("hits") >= 2).select("a", "b")
    )
    links = _link(stars, reps, docs, size, percent)
    groups = components(links)

    grouped = materialize(
        rows.select("token", "node", "n", "pos").join(groups, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "grouped"
    )
    matrix = grouped.groupBy("token", F.col("comp").alias("group"), F.col("n").alias("m")).agg(F.min("pos").alias("at"))
    open_groups = (
        grouped.join(matrix, "token")
        .where((F.col("comp") != F.col("group")) & (F.col("m") <= F.col("n")) & _fits(F.col("n"), F.col("pos"), F.col("m"), F.col("at"), percent))
        .groupBy("node", "n", "group", "m").agg(F.count(F.lit(1)).alias("hits"))
        .where(F.col("hits") >= F.least(F.lit(HITS), _need(F.col("n"), F.col("m"), percent)))
        .select(F.col("node").alias("a"), "group", "m")
    )
    members = grouped.select(F.col("comp").alias("group"), F.col("n").alias("m"), F.col("node").alias("b")).distinct()
    opened = open_groups.join(members, ["group", "m"]).select("a", "b").distinct()
    more = _link(opened, reps, docs, size, percent)
    final = components(links.unionByName(more))

    labelled = reps.join(final, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    names = labelled.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    by_class = labelled.join(names, "comp").select("node", "n", "check", "component_id")
    return sets.join(by_class, ["node", "n", "check"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
