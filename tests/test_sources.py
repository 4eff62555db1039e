import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusveil.operators import sanitize as S
from corpusveil.sources import files as SF
from corpusveil.session import running_sums
from corpusveil.sources import mappings as SM
from corpusveil.streaming import incremental as I
from tests.fixtures import JAVA_FILES, JAVA_MAPPING, files_df, mappings_df


def test_read_sources(spark, tmp_path):
    for rel, raw in {
        "a/B.java": b"class B {}\r\n", "a/__tests__/_C.java": b"x\xff\xfey", "D.java": b"", "a/e.txt": b"no", "n/F.JAVA": b"no",
    }.items():
        (tmp_path / rel).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / rel).write_bytes(raw)
    rows = {r.path: r for r in SF.read_sources(spark, str(tmp_path), "spring", "p").collect()}
    assert set(rows) == {"a/B.java", "a/__tests__/_C.java", "D.java"}
    assert rows["a/B.java"].text == "class B {}\n" and not rows["a/B.java"].bad_utf8
    assert rows["a/__tests__/_C.java"].text == "x��y" and rows["a/__tests__/_C.java"].n_replaced == 2


def test_tree_round_trip(spark, tmp_path):
    files = files_df(spark, JAVA_FILES, "spring")
    assert SF.write_tree(files, str(tmp_path / "t")) == len(JAVA_FILES)
    back = SF.read_sources(spark, f"file://{tmp_path}/t", "spring")
    assert {r.path: r.text for r in back.collect()} == JAVA_FILES
    with pytest.raises(Exception, match="leaves the target"):
        SF.write_tree(files.withColumn("path", F.lit("../x")), str(tmp_path / "t"))


def test_clean_and_snapshot(spark, tmp_path):
    files = files_df(spark, JAVA_FILES, "spring").withColumn("path", F.when(F.col("path").contains("Motor"), None).otherwise(F.col("path")))
    SF.write_clean(files, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == len(JAVA_FILES) - 1
    path = SF.snapshot(files, str(tmp_path / "s"), datetime(2024, 1, 2, 3, 4, 5))
    assert path.endswith("s.backup-20240102-030405") and spark.read.parquet(path).count() == len(JAVA_FILES)
    assert SF.snapshot(files, str(tmp_path / "s"), dry_run=True) is None


def test_clean_files_are_cut_by_bytes(spark, tmp_path):
    """One huge project, a hundred tiny ones, and one without a name: as many files as the bytes ask for."""
    huge = spark.range(4000).select(F.lit("huge").alias("project"), F.format_string("a/%05d", "id").alias("path"), F.repeat(F.lit("x"), F.lit(499)).alias("text"))
    tiny = spark.range(100).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("project"), F.lit("f").alias("path"), F.lit("tiny").alias("text"))
    odd = spark.createDataFrame([(None, "n", "nameless"), ("huge", "empty", ""), ("huge", "twice", "same"), ("huge", "twice", "same"), ("huge", "none", None)], "project string, path string, text string")
    files = huge.unionByName(tiny).unionByName(odd).withColumn("lang", F.when(F.col("project") != "t7", "spring")).repartition(9)
    out = tmp_path / "c"
    SF.write_clean(files, str(out), 100_000)
    back = spark.read.parquet(str(out))
    want = files.where("text IS NOT NULL").select("project", "path", "text")
    assert back.count() == 4104 and back.select("project", "path", "text").exceptAll(want).isEmpty()
    count = {p.name: len(list(p.rglob("*.parquet"))) for p in out.iterdir() if p.is_dir()}
    # 2 MB in files of 100 kB; a folder that does not begin with a file has one more
    assert 20 <= count.pop("project=huge") <= 22
    assert len(count) == 101 and sum(count.values()) <= 102
    sizes = sorted(r["count"] for r in back.where("project = 'huge'").groupBy(F.input_file_name()).count().collect())
    assert sizes[-1] <= 260
    SF.write_clean(files.limit(0), str(tmp_path / "none"))


@pytest.mark.parametrize("doc,package,variable,strings,language", [
    ('[{"from": "org.polaris", "to": "net.sample"}]', [("org.polaris", "net.sample")], [], {}, None),
    ('{"package": [], "variable": [{"from": "Shutter", "to": "Gate"}], "language": "spring"}', [], [("Shutter", "Gate")], {}, "spring"),
    ('{"version": 2, "strings": {"STR_0": "\\"x\\""}}', [], [], {"STR_0": '"x"'}, None),
])
def test_read_mappings(spark, tmp_path, doc, package, variable, strings, language):
    (tmp_path / "m.json").write_text(doc)
    parsed = SM.read_mappings(spark, str(tmp_path / "m.json"))
    r = parsed.first()
    assert r.version == 2 and r.language == language and r.strings == strings
    assert [tuple(p) for p in r.package] == package and [tuple(p) for p in r.variable] == variable


def test_missing_mapping_fails(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        SM.read_mappings(spark, str(tmp_path / "none.json")).collect()


def test_broken_mapping_fails(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"package": [')
    with pytest.raises(Exception):
        SM.read_mappings(spark, str(tmp_path / "m.json")).collect()


def test_write_then_read_mappings(spark, tmp_path):
    maps = mappings_df(spark, JAVA_MAPPING)
    lits = spark.createDataFrame([("s", "STR_0", 0, '"x"'), ("s", "STR_10", 10, '"y"'), ("s", "STR_2", 2, '"z"')], "set_id string, token string, idx bigint, literal string")
    SM.write_mappings(maps, lits, "spring", str(tmp_path / "out"))
    parsed = SM.read_mappings(spark, str(tmp_path / "out"), "s")
    assert sorted(map(tuple, SM.pairs_of(parsed).collect())) == sorted(map(tuple, maps.collect()))
    assert sorted(map(tuple, SM.literals_of(parsed).collect())) == sorted(map(tuple, lits.collect()))
    doc = json.loads(next((tmp_path / "out").glob("part-*")).read_text())
    assert doc["version"] == 2 and list(doc["strings"]) == ["STR_0", "STR_2", "STR_10"]
    SM.write_mapping_tables(maps, lits, str(tmp_path / "tables"))
    assert SM.read_mapping_tables(spark, str(tmp_path / "tables"))[1].count() == 3


def test_pairs(spark):
    df = spark.createDataFrame([(0, "org.polaris=net.sample"), (1, "Shutter=Ga=te")], "n int, pair string")
    got = SM.mappings_from_pairs(df, "pair", "variable", ord_col="n").orderBy("ord").collect()
    assert [(r["from"], r["to"]) for r in got] == [("org.polaris", "net.sample"), ("Shutter", "Ga=te")]
    for bad in ["no-separator", "=empty", "empty="]:
        one = spark.createDataFrame([(0, bad)], "n int, pair string")
        assert SM.rejected_pairs(one, "pair").count() == 1
        with pytest.raises(Exception, match="FROM=TO"):
            SM.mappings_from_pairs(one, "pair", "variable").collect()
    more = mappings_df(spark, [("variable", 0, "X", "Y")])
    assert SM.append_pairs(mappings_df(spark, JAVA_MAPPING), more).where("`from` = 'X'").first().ord == 1


def test_sources_from_table(spark):
    df = spark.createDataFrame([("a.ts", "x"), ("b.java", "y")], "p string, t string")
    rows = {r.path: r for r in SF.sources_from_table(df, "p", "t").collect()}
    assert rows["a.ts"].lang == "react" and rows["b.java"].lang == "spring" and not rows["a.ts"].bad_utf8


def test_stream_equals_batch_and_replays(spark, tmp_path):
    src, out, dic, chk = (str(tmp_path / d) for d in ("in", "out", "dic", "chk"))
    maps = mappings_df(spark, JAVA_MAPPING)
    docs = [(i, f'class Shutter{i} {{ s = "lit {i % 7}"; t = "own {i}"; }}') for i in range(40)]
    schema = "id int, text string"
    opts = S.Options(mask_strings=True)
    for k in range(4):
        spark.createDataFrame(docs[k * 10:(k + 1) * 10], schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        I.sanitize_stream(stream, ["id"], "text", maps, opts, "spring", ["id"], dic, out, chk).awaitTermination()
    batch, d = S.sanitize_corpus(spark.createDataFrame(docs, schema), ["id"], "text", maps, opts, "spring", ["id"])
    got = spark.read.parquet(out)
    assert got.select("id", "text").exceptAll(batch.select("id", "text")).collect() == []
    assert got.count() == 40
    stored = I.read_dictionary(spark, dic)
    assert stored.exceptAll(d.select("token", "idx", "literal")).collect() == [] and stored.count() == d.count()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        I.read_dictionary(spark, dic + "-moved", 3)
    # a replayed batch gives the same rows again
    I.clean_batch(spark.createDataFrame(docs[10:20], schema), 1, ["id"], "text", maps, opts, "spring", ["id"], dic, out)
    assert I.read_dictionary(spark, dic).exceptAll(d.select("token", "idx", "literal")).collect() == []
    assert spark.read.parquet(out).count() == 40


def test_published_sets_of_any_size(spark, tmp_path):
    """One set far larger than a document; versions appear at once, and broken ones are told."""
    n = 3000
    maps = spark.range(n).select(
        F.lit("big").alias("set_id"), F.when(F.col("id") % 3 == 0, "package").otherwise("variable").alias("kind"), (n - F.col("id")).cast("int").alias("ord"),
        F.concat(F.lit("from"), "id").alias("from"), F.concat(F.lit("to"), "id").alias("to"),
    )
    lits = spark.range(50).select(F.lit("big").alias("set_id"), F.concat(F.lit("STR_"), "id").alias("token"), F.col("id").alias("idx"), F.repeat(F.lit("x"), F.col("id").cast("int") * 100).alias("literal"))
    path = str(tmp_path / "sets")
    with pytest.raises(ValueError):
        SM.published_mappings(spark, path)
    assert SM.publish_mappings(maps, lits, "spring", path, 2_000) == 1
    docs = SM.mapping_documents(maps, lits, "spring", 2_000).select(F.length("doc").alias("n"), F.col("part")).collect()
    assert len(docs) > 50 and max(r.n for r in docs) < 10_000
    parsed = SM.published_mappings(spark, path)
    want = sorted((r.kind, r["from"], r["to"]) for r in maps.collect())
    got = SM.pairs_of(parsed).collect()
    assert sorted((r.kind, r["from"], r["to"]) for r in got) == want
    for kind in ("package", "variable"):
        of = sorted((r.ord, int(r["from"][4:])) for r in got if r.kind == kind)
        assert [o for o, _ in of] == list(range(len(of))) and [i for _, i in of] == sorted((i for _, i in of), reverse=True)
    assert {(r.token, r.literal) for r in SM.literals_of(parsed).collect()} == {(r.token, r.literal) for r in lits.collect()}
    assert SM.publish_mappings(maps.limit(1), None, "spring", path) == 2
    assert SM.pairs_of(SM.published_mappings(spark, path)).count() == 1 and SM.pairs_of(SM.published_mappings(spark, path, 1)).count() == n
    spark.createDataFrame([(3, "documents-3-gone", 4)], SM.MANIFEST).write.mode("append").parquet(f"{path}/manifest")
    with pytest.raises(Exception):
        SM.published_mappings(spark, path)
    assert SM.mapping_documents(maps.limit(0), None, "spring").count() == 0


def test_running_sums(spark, monkeypatch):
    monkeypatch.setattr("corpusveil.session.RUN", 7)
    df = spark.range(300).select("id", (F.col("id") * 37 % 11).alias("v"))
    got = running_sums(df, [F.col("id").desc()], "v", "place", "before").collect()
    rows = sorted(got, key=lambda r: -r.id)
    assert [r.place for r in rows] == list(range(300))
    assert [r.before for r in rows] == [sum(r.v for r in rows[:k]) for k in range(300)]
