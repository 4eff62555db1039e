"""Shapes of the physical plans that matter at scale."""

import pytest
from pyspark.sql import functions as F

from corpusveil.catalog import corpus as C
from corpusveil.catalog import queries as K
from corpusveil.operators import audit as A
from corpusveil.operators import graph as G
from corpusveil.operators import literals as L
from corpusveil.operators import rename as W
from corpusveil.operators import rules as R
from corpusveil.plans import joins as J
from corpusveil.session import new_table_path, number_rows, shared_dir, write_bucketed


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return [line.strip(" :+-*") for line in plan(df).splitlines() if "Exchange" in line]


def test_inline_rename_is_narrow_and_pruned(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    rules = R.content_rules(K._text_maps(spark))
    out = W.rename_text(docs, ["doc_id"], "text", rules).select("doc_id", "text")
    text = plan(out)
    assert exchanges(out) == [] and "Python" not in text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_filters_reach_the_scan(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    rules = R.content_rules(K._text_maps(spark))
    out = W.rename_text(docs, ["doc_id"], "text", rules).where("lang = 'en'").select("doc_id", "text")
    assert "EqualTo(lang,en)" in plan(out)


def test_small_dictionary_moves_the_texts_once(spark, sf_dir):
    docs = K._documents(spark, sf_dir)
    maps = C.mappings(spark, sf_dir).where("kind = 'variable'").withColumn("set_id", F.lit("all"))
    voc = W.build_vocabulary(docs, "text", R.content_rules(maps))
    out = W._by_word(docs, ["doc_id"], "text", "text", None, voc)
    kinds = exchanges(out)
    shuffles = {k.split("[")[0] for k in kinds if "hashpartitioning" in k}
    assert all("hashpartitioning(_row" in k for k in kinds if "hashpartitioning" in k) and shuffles
    assert sum("BroadcastExchange" in k for k in kinds) == 1


def test_audit_moves_hashes_not_texts(spark, sf_dir):
    docs = K._documents(spark, sf_dir)
    out = A.round_trip_audit(docs, docs, ["doc_id"], "text")
    for line in plan(out).splitlines():
        if "Exchange hashpartitioning" in line:
            assert "text" not in line


@pytest.mark.parametrize("rows", [0, 1, 1000])
def test_numbering_is_dense_and_ordered(spark, rows):
    df = spark.range(rows).select(((F.col("id") * 7919) % 1009).alias("v"), "id").repartition(7)
    got = number_rows(df, ["v", "id"], "n", 5).orderBy("n").collect()
    assert [r.n for r in got] == list(range(5, 5 + rows))
    assert [(r.v, r.id) for r in got] == sorted((r.v, r.id) for r in got)


def test_hot_keys_join_like_plain_ones(spark, monkeypatch):
    many = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    few = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    few = few.unionByName(few.where("k < 10").withColumn("w", F.lit(-1).cast("bigint")))
    for how in ("inner", "left"):
        want = sorted(map(tuple, many.join(few, "k", how).select("k", "id", "w").collect()), key=str)
        assert sorted(map(tuple, J.salted_join(many, few, ["k"], ["id"], how).select("k", "id", "w").collect()), key=str) == want
        monkeypatch.setattr(J, "SMALL_ROWS", 10)
        assert sorted(map(tuple, J.hot_key_join(many, few, ["k"], ["id"], how).select("k", "id", "w").collect()), key=str) == want
        monkeypatch.undo()


def above(df, mark):
    """Operators above each line of the plan that holds `mark`."""
    lines = plan(df).split("Initial Plan")[-1].splitlines()
    depth = [len(line) - len(line.lstrip(" :+-*")) for line in lines]
    for i, line in enumerate(lines):
        if mark in line:
            found, d = [], depth[i]
            for j in range(i - 1, -1, -1):
                if depth[j] < d:
                    found.append(lines[j].strip(" :+-*"))
                    d = depth[j]
            yield found


def test_a_round_moves_neither_edges_nor_what_is_seen(spark, monkeypatch):
    row = "project string, entry string, module_id string, path string, type string, p_place string, ord int, place string, depth int"
    sofar = spark.createDataFrame([("p", "a", "m", "a", "class", "", 0, "0", 0)], row)
    edges = spark.createDataFrame([("p", "a", 0, "b", "n", "class")], "project string, src_path string, ord int, dep_path string, module_id string, type string")
    write_bucketed(sofar, "plan_seen", new_table_path(spark, "seen"), ["project", "entry", "module_id"], ["depth"])
    write_bucketed(edges, "plan_edges", new_table_path(spark, "edges"), ["project", "src_path"])
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = G.next_round(spark.table("plan_seen"), spark.table("plan_edges"), 0, 1, bucketed=True)
        over_edges = list(above(out, "plan_edges"))
        assert over_edges and not any("Exchange" in op.split("(")[0] for ops in over_edges for op in ops[: next(i for i, o in enumerate(ops) if "Join" in o) + 1])
        # the frontier moves; the table of what is seen meets what was found where it is
        assert any(ops and not any("Exchange" in op for op in ops) for ops in above(out, "plan_seen"))
        assert sum(k.startswith("Exchange") for k in exchanges(out)) == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        for name in ("plan_seen", "plan_edges"):
            spark.sql(f"DROP TABLE {name}")


def test_large_dictionary_takes_the_salted_join(spark, monkeypatch):
    monkeypatch.setattr(J, "BROADCAST_ROWS", 2)
    monkeypatch.setattr("corpusveil.functions.columns.INLINE_MAX_ENTRIES", 1)
    texts = ['a "x" "y"', 'b "y"', 'c "z" ' * 700]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    d = L.build_dictionary(L.extract_literals(df, ["id"], "text", "spring"), ["id", "pos"])
    masked = L.mask_literals(df, ["id"], "text", "spring", d)
    back = L.unmask_literals(masked, ["id"], "text", d, count="n").orderBy("id").collect()
    assert [r.text for r in back] == texts and [r.n for r in back] == [2, 1, 700]


def test_shared_folder_is_taken_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
