"""Queries against their SQL; the pipeline against a plain version of its stages."""

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from corpusveil.llm import oracles, pii, queries
from tests.llm.test_operators import brute_components, brute_lines


def test_registered():
    names = set(contract.queries())
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.queries()) | {"pipeline"} <= names and set(oracles.oracle_sql()) <= names


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = contract.queries()[name](spark, sf_dir)
    made = con.execute(oracles.oracle_sql()[name])
    names = [d[0] for d in made.description]
    want = [dict(zip(names, r)) for r in made.fetchall()]
    assert sorted(names) == sorted(df.columns)
    assert sorted(str([r[c] for c in names]) for r in df.collect()) == sorted(str([r[c] for c in names]) for r in want)


@pytest.mark.parametrize("name", ["op2_best_fit_packing", "op4_bpe_round_trip", "op9_fingerprints", "op10_pii", "op13_toxicity"])
def test_query_covers_its_table(spark, sf_dir, name):
    ids = {r.doc_id for r in queries.table(spark, sf_dir, "documents").select("doc_id").collect()}
    assert {r.doc_id for r in contract.queries()[name](spark, sf_dir).select("doc_id").collect()} == ids


HARD = [(10**6, None, None), (10**6 + 1, "", "en"), (10**6 + 2, "%% 12", None), (10**6 + 3, "word " * 3000, "en"), (None, "of no id\nmail a@b.cc", "en")]


def test_pipeline_equals_plain_stages(spark, sf_dir, tmp_path):
    docs = queries.table(spark, sf_dir, "documents")
    extra = spark.createDataFrame([(d, t, lang, "s", 0) for d, t, lang in HARD], docs.schema)
    docs.unionByName(extra).write.parquet(str(tmp_path / "documents.parquet"))
    stage, cur = dict(corpus_pipeline.STAGES), spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = cur.columns

    def step(name, df):
        stage[name](spark, df, str(tmp_path)).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    def pairs(df):
        return [(r.doc_id, r.text) for r in df.collect()]

    one = step("language_id", cur)
    assert one.columns == columns
    gone = {d for d, _ in pairs(cur)} - {d for d, _ in pairs(one)}
    assert {10**6, 10**6 + 1, 10**6 + 2} <= gone and len(gone) <= 5
    two = step("line_dedup", one)
    want = [(d, t) for d, t, n, k in brute_lines(pairs(one), 32) if k or not n]
    assert sorted(pairs(two), key=str) == sorted(want, key=str) and two.columns == columns
    three = step("near_duplicates", two)
    comps = brute_components(pairs(two), 5, 80)
    keep = {d for d, _, c in comps if d == c}
    assert sorted(pairs(three), key=str) == sorted((r for r in pairs(two) if r[0] in keep), key=str)
    four = step("mask_pii", three)
    assert sorted(pairs(four), key=str) == sorted(((d, pii.masked(t, [s for p in pii.all_spans(t) for s in p])) for d, t in pairs(three)), key=str)
    assert four.where(F.col("n_chars") != F.length("text")).isEmpty()
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    five = step("best_fit_packing", four)
    sizes = {d: len(tk.encode(t, add_special_tokens=False).ids) + 1 for d, t in pairs(four)}
    assert {r.doc_id: r.n for r in five.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == sizes
    assert sorted(str(tuple(r)) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "start", "length", "ids_crc32").collect()) == sorted(
        str(tuple(r)) for r in five.select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    )


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables(spark, sf_dir, name):
    docs = queries.table(spark, sf_dir, "documents").limit(0)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, sf_dir).count() == 0


def test_near_duplicates_decide_by_row(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(12)) for k in "abcdefg"}
    rows = [
        (2, text["a"], "x"), (5, text["a"], "x"), (5, text["b"], "x"),  # an id on a copy and on a text of its own
        (7, text["c"], "x"), (7, text["c"], "x"), (7, text["c"], "w"),  # repeated rows
        (None, text["d"], "x"), (None, text["d"], "x"), (None, text["e"], "x"), (9, text["e"], "x"),  # copies without an id
        (3, text["f"], "x"), (3, text["f"] + " more", "x"), (None, text["g"], "x"), (8, "", "x"), (8, "", "x"), (None, None, "x"), (None, None, "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = [tuple(r) for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, "").collect()]
    one_of_three = [r for r in got if r[0] == 3]
    assert len(one_of_three) == 1 and one_of_three[0] in rows
    want = [
        (2, text["a"], "x"), (5, text["b"], "x"), (7, text["c"], "w"), (None, text["d"], "x"), (9, text["e"], "x"), (None, text["g"], "x"),
        (8, "", "x"), (8, "", "x"), (None, None, "x"), (None, None, "x"),
    ]
    assert sorted((r for r in got if r[0] != 3), key=str) == sorted(want, key=str)
