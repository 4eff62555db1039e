"""Prefix trie of conversations, and sums over all its subtrees by parallel tree contraction.

A node is a distinct sequence of turns; its name is a hash chained over them. Sums over
subtrees are made by rounds that alternate rake (leaves give their sum to their parent) and
compress (every other node of an unary chain is spliced out, its weight kept on the edge
to its child). Spliced nodes are then re-expanded by pointer doubling. A round is a few
joins on node names, each with at most one row per name, so no node is hot for its children.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusveil.session import materialize

#: Turns that one task chains before it starts a new chain; chains are then chained likewise.
CHAIN = 1 << 16
#: Bytes of ids in one row while those of a node are put together.
SEGMENT = 1 << 18
#: Rounds whose coin is a bit of the depth, which halves an untouched chain; later ones take a hash.
DEPTH_BITS = 16
ROOT = b""


def turn_hash(*texts: str) -> Column:
    """A hash of the texts' contents and bounds; null is read as empty."""
    whole = [F.coalesce(F.col(t).cast("string"), F.lit("")) for t in texts]
    return F.unhex(F.sha2(F.concat(*[x for t in whole for x in (F.octet_length(t).cast("string"), F.lit(":"), t)]), 256))


# ---- order within a conversation


def _placed(df: DataFrame, order: list[Column], keep: list[str]) -> DataFrame:
    """(*keep, idx): the place of each row in its conv_id, from 0, in the given order. One
    conversation may span any number of tasks: rows are range sorted, and a conversation's first
    position is subtracted."""
    spark = df.sparkSession
    rows = df.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order)
    placed = materialize(
        rows.select(*keep, F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos")), "turns"
    )
    pieces = materialize(placed.groupBy("conv_id", "_part").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n")), "pieces")
    # conversations in more than one task: at most one begins or goes on in each task, so there are fewer rows than two per task
    spans = pieces.join(pieces.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("conv_id"), "conv_id", "left_semi").collect()
    before, shifts = {}, []
    for r in sorted(spans, key=lambda r: (r["conv_id"], r["_part"])):
        shifts.append((r["conv_id"], r["_part"], before.get(r["conv_id"], 0)))
        before[r["conv_id"]] = before.get(r["conv_id"], 0) + r["_n"]
    carried = spark.createDataFrame(shifts, f"conv_id {df.schema['conv_id'].dataType.simpleString()}, _part int, _base bigint")
    firsts = pieces.join(F.broadcast(carried), ["conv_id", "_part"], "left").select("conv_id", "_part", (F.coalesce("_base", F.lit(0)) - F.col("_first")).alias("_shift"))
    # a piece lies in one task of the sort, and is met there again in chunks
    chunk = (F.col("_pos") / CHAIN).cast("bigint")
    last = pieces.select("conv_id", "_part", (F.col("_first") / CHAIN).cast("bigint").alias("_a"), ((F.col("_first") + F.col("_n") - 1) / CHAIN).cast("bigint").alias("_b"))
    spread = firsts.join(last, ["conv_id", "_part"]).withColumn("_chunk", F.explode(F.sequence("_a", "_b"))).drop("_a", "_b")
    return (
        placed.withColumn("_chunk", chunk).join(spread, ["conv_id", "_part", "_chunk"])
        .select(*keep, (F.col("_pos") + F.col("_shift")).alias("idx"))
    )


def _chain(batches):
    """Batches of (seq, chunk, place, hash), in order -> with the hash of the chunk's hashes so far,
    and that of the row before ('' at a chunk's beginning)."""
    at, state = None, ROOT
    for batch in batches:
        prefixes, parents = [], []
        for seq, chunk, _, h in zip(*(c.to_pylist() for c in batch.columns)):
            if (seq, chunk) != at:
                at, state = (seq, chunk), ROOT
            parents.append(state)
            state = hashlib.sha256(state + h).digest()[:16]
            prefixes.append(state)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prefixes, pa.binary()), pa.array(parents, pa.binary())], ["seq", "chunk", "place", "hash", "node", "parent"])


def prefix_names(df: DataFrame, chain: int = CHAIN) -> DataFrame:
    """(seq, place, node, parent) for rows (seq, place, hash), places dense from 0: the name of the
    sequence up to each place, and of the one before it ('' for none). Equal names mean equal
    sequences. A sequence of any length is chained `chain` rows a task, then chunk by chunk."""
    kind = df.schema["seq"].dataType.simpleString()
    rows = df.select("seq", F.floor(F.col("place") / chain).cast("bigint").alias("chunk"), F.col("place").cast("bigint").alias("place"), "hash")
    dealt = rows.repartition("seq", "chunk").sortWithinPartitions("seq", "chunk", "place")
    made = materialize(dealt.mapInArrow(_chain, f"seq {kind}, chunk bigint, place bigint, hash binary, node binary, parent binary"), "chains")
    if made.where("chunk > 0").isEmpty():
        return made.select("seq", "place", "node", "parent")
    ends = made.groupBy("seq", "chunk").agg(F.max_by("node", "place").alias("hash"))
    upper = prefix_names(ends.select("seq", F.col("chunk").alias("place"), "hash"), chain)
    # what a chunk begins with: the name of all chunks before it
    begins = upper.select("seq", F.col("place").alias("chunk"), F.col("parent").alias("_begin"))

    def under(name: Column) -> Column:
        return F.when(F.octet_length("_begin") == 0, name).when(F.octet_length(name) == 0, F.col("_whole")).otherwise(
            F.substring(F.unhex(F.sha2(F.concat(F.col("_begin"), name), 256)), 1, 16)
        )

    joined = made.join(begins, ["seq", "chunk"])
    # the row before a chunk's first one is the last of the chunk before: its name, made alike
    lasts = joined.groupBy("seq", "chunk").agg(F.max_by(F.when(F.octet_length("_begin") == 0, F.col("node")).otherwise(
        F.substring(F.unhex(F.sha2(F.concat(F.col("_begin"), F.col("node")), 256)), 1, 16)), "place").alias("_whole"))
    whole = lasts.select("seq", (F.col("chunk") + 1).alias("chunk"), "_whole")
    return joined.join(whole, ["seq", "chunk"], "left").select("seq", "place", under(F.col("node")).alias("node"), under(F.col("parent")).alias("parent"))


# ---- tree contraction


def _coin(number: int) -> Column:
    if number < DEPTH_BITS:
        return F.shiftright("depth", number).bitwiseAND(F.lit(1)) == 1
    return F.xxhash64("node", F.lit(number)).bitwiseAND(F.lit(1)) == 1


def subtree_sums(nodes: DataFrame, weights: list[str]) -> DataFrame:
    """(node, *weights): each weight summed over the node's subtree, the node included.

    `nodes` has (node, parent, depth, *weights), whole numbers; a root's parent is null. A null
    weight counts as 0. Any number of trees; an empty table gives no rows. A parent that
    is no node, or a cycle, is an error of the caller's: its nodes get no row.
    """
    state = materialize(
        nodes.select("node", "parent", F.col("depth").cast("bigint").alias("depth"), *[F.coalesce(F.col(w).cast("bigint"), F.lit(0)).alias(w) for w in weights],
                     *[F.lit(0).cast("bigint").alias(f"up_{w}") for w in weights]),
        "forest",
    )
    has = nodes.where("parent is not null").select(F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(True))
    state = materialize(state.join(has, "node", "left").withColumn("inner", F.coalesce("inner", F.lit(False))), "forest")
    raked, spliced, number = [], [], 0
    while not state.isEmpty():
        coin = _coin(number)
        # for each parent: what its leaves give, how many children stay, and the only one that does
        given = state.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(
            *[F.sum(F.when(~F.col("inner"), F.col(w) + F.col(f"up_{w}"))).alias(f"got_{w}") for w in weights],
            F.count_if("inner").alias("stay"),
            F.min(F.when(F.col("inner"), F.struct("node", coin.alias("coin"), *[f"up_{w}" for w in weights]))).alias("child"),
        )
        raked.append(state.where("not inner").select("node", *weights))
        one = F.col("child")
        joined = state.where("inner").join(given, "node").select(
            "node", "parent", "depth", *[(F.col(w) + F.coalesce(f"got_{w}", F.lit(0))).alias(w) for w in weights], *[f"up_{w}" for w in weights], "stay",
            F.when((F.col("stay") == 1) & F.col("parent").isNotNull() & coin & ~one["coin"], one).alias("below"),
        )
        left = materialize(joined, "raked")
        out = left.where("below is not null")
        below = F.col("below")
        spliced.append(out.select("node", below["node"].alias("child"), *[(F.col(w) + below[f"up_{w}"]).alias(w) for w in weights]))
        moved = out.select(below["node"].alias("node"), F.col("parent").alias("_to"), *[(F.col(w) + F.col(f"up_{w}")).alias(f"_{w}") for w in weights])
        state = materialize(
            left.where("below is null").join(moved, "node", "left").select(
                "node", F.coalesce("_to", "parent").alias("parent"), "depth", *weights,
                *[(F.col(f"up_{w}") + F.coalesce(f"_{w}", F.lit(0))).alias(f"up_{w}") for w in weights], (F.col("stay") > 0).alias("inner"),
            ),
            "forest",
        )
        number += 1
    if not raked:
        return nodes.select("node", *weights)
    done = raked[0]
    for part in raked[1:]:
        done = done.unionByName(part)
    open_ = spliced[0]
    for part in spliced[1:]:
        open_ = open_.unionByName(part)
    open_ = materialize(open_, "spliced")
    # a spliced node's child was spliced in a later round or raked: double the step until all are raked
    while True:
        step = open_.select(F.col("node").alias("child"), F.col("child").alias("_next"), *[F.col(w).alias(f"_{w}") for w in weights])
        if open_.join(step, "child", "left_semi").isEmpty():
            break
        open_ = materialize(
            open_.join(step, "child", "left").select("node", F.coalesce("_next", "child").alias("child"), *[(F.col(w) + F.coalesce(f"_{w}", F.lit(0))).alias(w) for w in weights]),
            "spliced",
        )
    ends = done.select(F.col("node").alias("child"), *[F.col(w).alias(f"_{w}") for w in weights])
    expanded = open_.join(ends, "child").select("node", *[(F.col(w) + F.col(f"_{w}")).alias(w) for w in weights])
    return done.unionByName(expanded)


# ---- digests of the ids that end in a node


def _segments(batches):
    """Batches of (node, id), in order -> (node, first, ids, digest). A node that is surely whole in
    this task has its digest; the first and the last one of the task come as text, in segments."""
    number, at, first, held, size = 0, None, None, [], 0
    out = {"node": [], "first": [], "ids": [], "digest": []}

    def put(whole: bool):
        text = ",".join(held).encode()
        out["node"].append(at)
        out["first"].append(first)
        out["ids"].append(None if whole else text)
        out["digest"].append(hashlib.sha256(text).hexdigest() if whole else None)

    def batch_of():
        made = pa.RecordBatch.from_pydict(out, pa.schema([("node", pa.binary()), ("first", pa.int64()), ("ids", pa.binary()), ("digest", pa.string())]))
        for column in out.values():
            column.clear()
        return made

    cut = False
    for batch in batches:
        for node, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if node != at or size > SEGMENT:
                if at is not None:
                    # whole: not this task's first node, not cut before, and another node follows
                    put(whole=number > 1 and not cut and node != at)
                cut = node == at
                number += node != at
                at, first, held, size = node, key, [], 0
            held.append(str(key))
            size += len(held[-1]) + 1
        yield batch_of()
    if at is not None:
        put(whole=False)
        yield batch_of()


def _digested(batches):
    """Batches of (node, first, ids), in order -> (node, digest)."""
    at, state = None, None
    for batch in batches:
        nodes, digests = [], []
        for node, ids in zip(batch.column(0).to_pylist(), batch.column(2)):
            if node != at:
                if at is not None:
                    nodes.append(at)
                    digests.append(state.hexdigest())
                at, state = node, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], ["node", "digest"])
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["node", "digest"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(node, digest) of rows (node, id bigint): SHA-256 of the node's ids, ascending, with commas.

    Ids are sorted over all tasks and joined where they stand; only segments of nodes that may
    span tasks meet again, in order, at most a few rows for each task of the sort and a row for
    each SEGMENT bytes. The digest of one node is one pass by its definition.
    """
    rows = ends.select("node", "id").repartitionByRange("node", "id").sortWithinPartitions("node", "id")
    made = materialize(rows.mapInArrow(_segments, "node binary, first bigint, ids binary, digest string"), "segments")
    open_ = made.where("digest is null").select("node", "first", "ids").repartition("node").sortWithinPartitions("node", "first")
    return made.where("digest is not null").select("node", "digest").unionByName(open_.mapInArrow(_digested, "node binary, digest string"))


# ---- the trie of conversations


def _hot_join(rows: DataFrame, side: DataFrame, key: str) -> DataFrame:
    """rows left join side (one row a key): keys with over a thousandth of the rows, at most 1,000,
    are broadcast; their rows do not move."""
    total = rows.count()
    hot = [r[key] for r in rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") * 1000 > max(total, 100_000)).select(key).collect()]
    if not hot:
        return rows.join(side, key, "left")
    often = rows.sparkSession.createDataFrame([(h,) for h in hot], f"{key} {rows.schema[key].dataType.simpleString()}")
    of_hot = materialize(side.join(F.broadcast(often), key, "left_semi"), "hot")
    warm = rows.join(F.broadcast(of_hot), key)
    cold = rows.join(F.broadcast(often), key, "left_anti").join(side, key, "left")
    return warm.unionByName(cold)


def shared_openings(turns: DataFrame, opening: Column, source: Column) -> DataFrame:
    """(conv_id, place, hash, bytes) of every conversation rebuilt from rows (conv_id, idx, hash,
    bytes): the first `opening` turns are those of conversation `source`, the others its own. Both
    columns are made of conv_id; opening is bounded, so few rows of a source are read. Also
    returns the conversations with their number of rebuilt turns."""
    sizes = materialize(turns.groupBy("conv_id").agg(F.max("idx").alias("_last")), "sizes")
    convs = sizes.withColumn("_n", F.col("_last") + 1).withColumn("_h", opening).withColumn("_from", source)
    sources = convs.select(F.col("conv_id").alias("_from"), F.col("_n").alias("_m"))
    plan = materialize(
        convs.join(sources, "_from", "left").select("conv_id", "_from", "_n", "_h", F.least("_h", F.coalesce("_m", F.lit(0))).alias("_k")), "plan"
    )
    most = plan.agg(F.max("_h")).first()[0] or 0
    heads = turns.where(F.col("idx") < most).select(F.col("conv_id").alias("_from"), "idx", "hash", "bytes")
    taken = plan.where("_k > 0").join(heads, "_from").where("idx < _k").select("conv_id", F.col("idx").alias("place"), "hash", "bytes")
    # a conversation's own turns meet its plan in chunks: a long one is not one task
    spread = plan.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - 1) / CHAIN))))
    own = turns.withColumn("_chunk", F.floor(F.col("idx") / CHAIN)).join(spread, ["conv_id", "_chunk"]).where("idx >= _h").select(
        "conv_id", (F.col("_k") + F.col("idx") - F.col("_h")).alias("place"), "hash", "bytes"
    )
    rebuilt = plan.select("conv_id", (F.col("_k") + F.greatest(F.lit(0), F.col("_n") - F.col("_h"))).alias("n"))
    return materialize(taken.unionByName(own), "rebuilt"), rebuilt


def ordered_turns(df: DataFrame) -> DataFrame:
    """(conv_id, idx, hash, bytes): turns in order, null turns first, equal ones by role, then text.
    Null role or text is empty. Rows without a conv_id belong to no conversation and go."""
    rows = df.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    hashed = rows.withColumn("hash", turn_hash("role", "text")).withColumn("bytes", F.octet_length("text").cast("bigint"))
    return materialize(_placed(hashed, [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], ["conv_id", "hash", "bytes"]), "ordered")


def prefix_trie(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row per node of the trie of sequences `rows` (conv_id, place, hash, bytes), the textless
    root included: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, as op12 defines them. `sizes` (conv_id, n) names all members, those without
    rows too. No members give no nodes.
    """
    names = materialize(
        prefix_names(rows.select(F.col("conv_id").alias("seq"), "place", "hash")).join(
            rows.select(F.col("conv_id").alias("seq"), "place", "bytes"), ["seq", "place"]
        ).select(F.col("seq").alias("conv_id"), (F.col("place") + 1).alias("depth"), "node", "parent", "bytes"),
        "names",
    )
    inner = names.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent").alias("parent"),
        F.count(F.lit(1)).alias("n_convs"), F.min("bytes").alias("bytes"),
    )
    root = sizes.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        F.lit(ROOT).alias("node"), "conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("binary").alias("parent"), "n_convs", F.lit(0).cast("bigint").alias("bytes")
    )
    nodes = materialize(inner.unionByName(root), "nodes")
    kids = materialize(nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children")), "kids")
    full = materialize(nodes.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))), "nodes")
    sums = subtree_sums(
        full.select("node", "parent", "depth", (F.col("n_children") == 0).cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens")),
        ["n_leaves", "saved_tokens"],
    )
    last = names.join(sizes.withColumnRenamed("n", "depth"), ["conv_id", "depth"]).select("node", F.col("conv_id").alias("id"))
    without = sizes.where("n = 0").select(F.lit(ROOT).alias("node"), F.col("conv_id").alias("id"))
    digests = end_digests(last.unionByName(without))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    named = full.join(sums, "node").join(digests, "node", "left")
    return _hot_join(materialize(named, "summed"), above, "parent").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("digest", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )
