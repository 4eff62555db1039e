"""Steps that must not hang on how the input lies or on what the planner takes it for."""

from pyspark.sql import functions as F

from corpusveil import values as v
from corpusveil.catalog import corpus as C
from corpusveil.catalog import queries as K
from corpusveil.functions import text as T
from corpusveil.operators import audit as A
from corpusveil.operators import graph as G
from corpusveil.operators import rename as W
from corpusveil.operators import rules as R
from corpusveil.operators import sanitize as S
from corpusveil.plans import extract as X
from corpusveil.plans import joins as J
from corpusveil.session import materialize, parallelism


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def part_table(spark, folder, n):
    rows = spark.range(n).select(
        F.col("id").alias("p_partkey"), F.lit("a b").alias("p_name"), F.lit("Brand#1").alias("p_brand"),
        F.lit("TIN").alias("p_type"), F.lit(3).alias("p_size"),
    )
    rows.coalesce(1).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_stream_of_a_folder_of_pages(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.test/", '<a href="x">The</a>'), (2, "http://a.test/b", None)], "page_id bigint, url string, html string")
    pages.repartition(2, "page_id").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(r.page_id for r in K.i1_sanitize_stream(spark, str(tmp_path)).collect()) == [1, 2]


def test_one_file_of_parts_is_worked_on_by_all_tasks(spark, tmp_path):
    folder = part_table(spark, tmp_path, 200)
    for files in (C.java_files(spark, folder), C.react_files(spark, folder), K._nested_parts(spark, folder)):
        assert files.rdd.getNumPartitions() >= parallelism(spark)


def test_file_tables_are_not_broadcast(spark, tmp_path):
    files = materialize(C.react_files(spark, part_table(spark, tmp_path, 200)), "files")
    edges = X.edges_of(files, v.REACT, "@")
    assert "BroadcastHashJoin" not in plan(edges) and edges.count() > 0


def test_what_was_seen_is_neither_sorted_nor_broadcast(spark):
    row = "project string, entry string, module_id string, path string, type string, p_place string, ord int, place string, depth int"
    sofar = materialize(spark.createDataFrame([("p", "a", "m", "a", "class", "", 0, "0", 0), ("p", "a", "n", "b", "class", "", 0, "0", 0)], row), "sofar")
    edges = [("p", "a", 0, "b", "n", "class"), ("p", "a", 1, "c", "o", "class"), ("p", "a", 2, None, None, "class")]
    edges = materialize(spark.createDataFrame(edges, "project string, src_path string, ord int, dep_path string, module_id string, type string"), "edges")
    out = G.next_round(sofar, edges, 0, 1)
    assert "ShuffledHashJoin" in plan(out) and "LeftOuter, BuildLeft" in plan(out) and "SortMergeJoin" not in plan(out)
    # a name that is null is met by no other
    assert sorted(r.module_id or "" for r in out.collect()) == ["", "o"]


def test_small_many_sides_do_not_broadcast_the_few_side(spark):
    many = materialize(spark.createDataFrame([("a", 1)], "k string, x int"), "many")
    few = materialize(spark.createDataFrame([("a", 2)], "k string, y int"), "few")
    assert "BroadcastHashJoin" not in plan(J.hot_key_join(many, few, ["k"], ["x"]))


def test_texts_are_cut_after_they_are_spread(spark):
    """Before, texts were cut into parts by the tasks of the scan, for a hash of the parts."""
    rows = [(1, "Lamp Lamp"), (1, "Lamp Lamp"), (None, "no " * 300 + "LampShade" + " Lamp" * 300), (2, ""), (3, None), (4, "no")]
    df = materialize(spark.createDataFrame(rows, "id int, text string").coalesce(1), "texts")
    rules = R.content_rules(C.mapping_set(spark, [("variable", 0, "Lamp", "Torch")], "s"))
    out = W.rename_text(df, ["id"], "text", rules, count="n", join=True)
    lines = plan(out).splitlines()
    spread = [i for i, line in enumerate(lines) if "hashpartitioning(_row" in line and "REPARTITION_BY_NUM" in line]
    assert spread
    for i in spread:
        depth = len(lines[i]) - len(lines[i].lstrip(" :+-*"))
        for line in lines[i + 1:]:
            if len(line) - len(line.lstrip(" :+-*")) <= depth:
                break
            assert "regexp" not in line
    want = [(i, t and t.replace("Lamp", "Torch"), None if t is None else t.count("Lamp")) for i, t in rows]
    assert sorted(map(tuple, out.select("id", "text", "n").collect()), key=str) == sorted(want, key=str)


def chain(spark):
    """A way of 12 modules with ways back and two entries that are far apart."""
    links = [(i, to, k) for i in range(12) for k, to in enumerate([i + 1, (i * 5) % 7, 100 + i % 3])]
    path = lambda m: f"{m}.java" if m < 13 else None
    edges = spark.createDataFrame([("p", path(i), k, f"m.{to}", f"m.{to}", path(to)) for i, to, k in links], "project string, src_path string, ord int, spec string, dep_id string, dep_path string")
    modules = spark.createDataFrame([("p", f"m.{i}", path(i), "class", "spring") for i in range(13)], "project string, module_id string, path string, type string, lang string")
    entries = spark.createDataFrame([("p", "0.java"), ("p", "9.java")], "project string, entry string")
    return materialize(entries, "entries"), materialize(edges, "edges"), materialize(modules, "modules")


def test_rounds_of_few_rows_leave_the_buckets_alone(spark, monkeypatch):
    """Before, each of the many small rounds of a deep graph read a file per bucket and depth."""
    tables = chain(spark)
    want = sorted(map(tuple, G.trace_closure(*tables, bucketed=False).collect()), key=str)
    large = G.next_round
    seen = []
    monkeypatch.setattr(G, "next_round", lambda *a: seen.append(a[3]) or large(*a))
    assert sorted(map(tuple, G.trace_closure(*tables, bucketed=True).collect()), key=str) == want and not seen


def test_small_and_large_rounds_may_take_turns(spark, monkeypatch):
    """Keys go to the buckets before a large round; another number of buckets than a shuffle has parts."""
    tables = chain(spark)
    want = sorted(map(tuple, G.trace_closure(*tables, bucketed=False).collect()), key=str)
    monkeypatch.setattr(G, "bucket_count", lambda _: 3)
    for few, found in ((0, 10), (3, 10), (5, 0)):
        monkeypatch.setattr(G, "FEW_ROWS", few)
        monkeypatch.setattr(G, "FOUND_ROWS", found)
        assert sorted(map(tuple, G.trace_closure(*tables, bucketed=True).collect()), key=str) == want


def test_places_sort_like_the_numbers_they_are_made_of(spark):
    """An import number of more digits comes later; a place is short."""
    n = 300
    edges = spark.createDataFrame([("p", "a", n - i, None, f"m{i}", None) for i in range(n)], "project string, src_path string, ord int, spec string, dep_id string, dep_path string")
    modules = spark.createDataFrame([("p", "a", "a", "class", "spring")], "project string, module_id string, path string, type string, lang string")
    out = G.trace_closure(spark.createDataFrame([("p", "a")], "project string, entry string"), edges, modules)
    assert [r.module_id for r in out.orderBy("seq").collect()] == ["a", *[f"m{i}" for i in reversed(range(n))]]


def test_the_last_join_of_hot_keys_does_not_broadcast_the_few_side(spark, monkeypatch):
    monkeypatch.setattr(J, "SMALL_ROWS", 1)
    many = materialize(spark.range(3000).select(F.lit("a").alias("k"), "id"), "many")
    few = materialize(spark.createDataFrame([("a", 2)], "k string, y int"), "few")
    out = J.hot_key_join(many, few, ["k"], ["id"])
    assert "SortMergeJoin" in plan(out) and out.count() == 3000


def test_deep_templates_need_no_automaton(spark, monkeypatch):
    """Before, the automaton read every template nested more than four levels deep, step by step."""
    deep = [f"a = `{'${x' * n} ` // {'}' * n}`; // c\n'b'" for n in (5, 50, 64)]
    more = f"a = `{'${x' * 65} ` // {'}' * 65}`; // c\n'b'"
    df = spark.createDataFrame([(t,) for t in [*deep, more, "`" + "${" * 70]], "text string")
    pieces = lambda c: F.transform(c, lambda p, i: p)
    for r in df.select("text", pieces(T.js_pieces(F.col("text"))).alias("got"), pieces(T._nested_pieces(F.col("text"))).alias("want")).collect():
        assert r.got == r.want
    monkeypatch.setattr(T, "_nested_pieces", lambda c: F.array(F.lit("automaton")))
    read = {r.text: r.p for r in df.select("text", T.js_pieces(F.col("text")).alias("p")).collect()}
    assert all(read[t] != ["automaton"] for t in deep) and read[more] == ["automaton"]


def test_merkle_audit_restores_a_text_once(spark):
    """Before, each reading of the restored texts restored them again, and so did the test for null."""
    restored = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def restore(text):
        restored.add(1)
        return text

    row = "project string, path string, text string"
    was = spark.createDataFrame([("p", f"a/{i}", f"x\n{i}") for i in range(40)], row)
    back = spark.createDataFrame([("p", f"a/{i}", f"x\n{i % 20}") for i in range(40)], row)
    got = A.merkle_audit(was, back.withColumn("text", restore("text"))).collect()
    assert sorted(map(tuple, got)) == sorted(("p", f"a/{i}", "differs", 2) for i in range(20, 40))
    assert restored.value == 40


def test_documents_of_one_row_group_are_cleaned_by_all_tasks(spark, tmp_path, monkeypatch):
    """Before, the scan of a file of documents had as many tasks as the file has row groups."""
    folder = part_table(spark, tmp_path, 20)
    docs = [(i if i % 7 else None, f"text {i}", "en", "src1") for i in range(60)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.range(60).select(F.col("id").alias("doc_id")).coalesce(1).write.parquet(f"{folder}/labels.parquet")
    seen = []
    clean = S.sanitize
    monkeypatch.setattr(S, "sanitize", lambda df, *a: seen.append(df) or clean(df, *a))
    # documents without an id have no label: one place of the tree, nine rows
    assert K.a2_merkle_audit(spark, folder).where("problem = 'missing'").count() == 1
    assert K.a2_round_trip_audit(spark, folder).where("problem = 'missing'").count() == 9
    for sent in seen:
        assert sent.rdd.getNumPartitions() >= 2 * parallelism(spark)


def test_code_between_strings_is_gathered_once_a_text(spark):
    """Before, each string of a text went over all its pieces: the square of their number."""
    df = materialize(spark.createDataFrame([("from 'm'; " + "call('a', 1);\n" * 3000,)], "text string"), "texts")
    filters = lambda c: plan(df.select(c.alias("c"))).count("filter(")
    assert filters(T.react_literals(F.col("text"))) == filters(T.js_pieces(F.col("text"))) + 1
    found = df.select(F.filter(T.react_literals(F.col("text")), lambda p: p["literal"].isNotNull())["literal"].alias("l")).first().l
    assert found == ["'a'"] * 3000
