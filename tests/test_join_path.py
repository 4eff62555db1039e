"""The ways for large dictionaries against the small ones: null ids, repeated ids, control characters."""

import pytest
from pyspark.sql import functions as F

from corpusveil import values as v
from corpusveil.catalog import corpus as C
from corpusveil.operators import literals as L
from corpusveil.operators import rename as W
from corpusveil.operators import rules as R
from tests.fixtures import mappings_df

ROWS = [(None, 'call("red"); Lamp LampShade'), (1, 'f("red", "blue")'), (1, 'f("blue") + Lamp'), (1, 'f("blue") + Lamp'), (2, None), (3, ""), (None, "none")]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(ROWS, "id bigint, text string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_masking_and_back(spark, texts):
    dictionary = spark.createDataFrame([("s", "STR_0", 0, '"red"'), ("s", "STR_1", 1, '"blue"')], "set_id string, token string, idx bigint, literal string")
    small = L.mask_literals(texts, ["id"], "text", v.SPRING, dictionary)
    joined = L.mask_literals(texts, ["id"], "text", v.SPRING, dictionary, join=True)
    assert rows(joined) == rows(small)
    assert not [t for _, t in rows(joined) if t and ("red" in t or "blue" in t)]
    back = L.unmask_literals(joined, ["id"], "text", dictionary, count="n", join=True)
    assert rows(back.drop("n")) == rows(texts)
    assert rows(back) == rows(L.unmask_literals(small, ["id"], "text", dictionary, count="n"))


def test_renaming(spark, texts):
    rules = R.content_rules(C.mapping_set(spark, [("variable", 0, "Lamp", "Torch")], "s"))
    small = W.rename_text(texts, ["id"], "text", rules, count="n")
    joined = W.rename_text(texts, ["id"], "text", rules, count="n", join=True)
    assert rows(joined) == rows(small)
    assert rows(joined.where("id is null"))[0][1].endswith("Torch TorchShade")


@pytest.mark.parametrize("control", ["\n", "\r", "\t", "\x0b", "\x0c", "\x1f", " "])
def test_literals_with_control_characters(spark, control):
    rules = R.content_rules(C.mapping_set(spark, [("variable", 0, f"lamp{control}shade", "torch")], "s"))
    df = spark.createDataFrame([(1, f"a lamp{control}shade b Lamp")], "id bigint, text string")
    assert rows(W.rename_text(df, ["id"], "text", rules, join=True)) == rows(W.rename_text(df, ["id"], "text", rules))
    assert W.rename_text(df, ["id"], "text", rules, join=True).where(F.col("text").contains("torch")).count() == 1


def test_report_counts_rows_not_ids(spark):
    """Rows with null, repeated and equal ids, and rows alike in all, are texts of their own in both ways."""
    rows = [(1, "Lamp Lamp"), (1, "a Lamp"), (None, "Lamp"), (None, "Lamp"), (2, "no"), (3, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    rules = R.content_rules(mappings_df(spark, [("variable", 0, "Lamp", "Torch")]))
    for join in (False, True):
        got = {r.form: (r.n_hits, r.n_texts) for r in W.substitution_report(df, ["id"], "text", rules, join=join).collect()}
        assert got == {"Lamp": (5, 4)}
