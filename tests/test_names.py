import pytest
from pyspark.sql import functions as F

from corpusveil.functions import names

#: function -> names and what becomes of them
EXPECTED = {
    "snake_case": {"TideTable": "tide_table", "tideTableRow": "tide_table_row", "XMLReader": "xml_reader", "moon": "moon", "low_tide": "low_tide"},
    "upper_snake_case": {"TideTable": "TIDE_TABLE", "moonPhase": "MOON_PHASE", "Moon": "MOON"},
    "kebab_case": {"TideTable": "tide-table", "moonPhase": "moon-phase", "Moon": "moon"},
    "pascal_case": {"moon": "Moon", "low_tide": "LowTide", "LowTide": "LowTide", "": "", "a_bCD": "ABcd"},
    "camel_case": {"Moon": "moon", "LowTide": "lowTide", "low_tide": "lowTide", "GPS": "gps", "LOW_TIDE": "low_tide", "": ""},
    "pluralize": {
        "lantern": "lanterns", "Lantern": "Lanterns", "LANTERN": "LANTERNS",  # case is kept
        "torch": "torches", "brush": "brushes", "lens": "lenses", "fox": "foxes", "waltz": "waltzes",  # hissing ends
        "ferry": "ferries", "FERRY": "FERRIES", "quay": "quays",  # y after a consonant, after a vowel
        "person": "people", "Matrix": "Matrices", "CRITERION": "CRITERIA",  # irregular
        "": "s", "y": "ys",
    },
    "singularize": {
        "lanterns": "lantern", "Lanterns": "Lantern", "LANTERNS": "LANTERN",
        "torches": "torch", "brushes": "brush", "foxes": "fox", "masses": "mass", "waltzes": "waltz",
        "ferries": "ferry", "FERRIES": "FERRY", "quays": "quay",
        "people": "person", "Matrices": "Matrix",
        "campus": "campus", "oasis": "oasis", "moss": "moss", "torch": "torch",  # no plurals
        "s": "s", "ies": "ie",
    },
}


@pytest.mark.parametrize("function", sorted(EXPECTED))
def test_names_become(spark, function):
    rows = spark.createDataFrame(list(EXPECTED[function].items()), "name string, expected string")
    got = {r["name"]: r["made"] for r in rows.select("name", getattr(names, function)(F.col("name")).alias("made")).collect()}
    assert got == EXPECTED[function]


def test_singular_undoes_plural(spark, sf_dir):
    # every word that the parts are named by, in three cases
    words = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    words = words.where("w rlike '^[a-z]+$'").select(F.explode(F.array("w", F.initcap("w"), F.upper("w"))).alias("w"))
    single = words.where(names.singularize(F.col("w")) == F.col("w"))
    assert single.count() > 30
    assert single.where(names.singularize(names.pluralize(F.col("w"))) != F.col("w")).collect() == []


def forms_of(spark, name):
    df = spark.createDataFrame([(name,)], "name string")
    return {f["form"]: f["tag"] for f in names.with_forms(df, "name").first()["forms"]}


def test_forms_of_one_and_two_words(spark):
    assert set(forms_of(spark, "Buoy")) == {"Buoy", "Buoys", "buoy", "buoys", "BUOY", "BUOYS"}
    two = forms_of(spark, "TideTable")
    assert set(two) == {
        "TideTable", "TideTables", "tideTable", "tideTables", "TIDE_TABLE", "TIDE_TABLES",
        "tide_table", "tide_tables", "tide-table", "tide-tables",
    }


def test_the_first_way_to_a_form_names_it(spark):
    assert forms_of(spark, "Buoys")["Buoys"] == "as_is" and forms_of(spark, "Buoys")["Buoy"] == "singular"
    assert forms_of(spark, "Criteria")["Criterion"] == "singular"
