"""Rename rules: expansion of mappings, ranking, validation, inversion.

Mappings: set_id, kind ('package' | 'variable'), ord, from, to.
Rules:    set_id, kind, ord, form_pos, shape_pos, literal, shape, pattern, replacement, core_len.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusveil import values as v
from corpusveil.functions import names
from corpusveil.operators.anchors import open_places
from corpusveil.session import materialize, number_rows

RULE_ORDER = ["kind", "ord", "form_pos", "shape_pos"]  # 'package' sorts before 'variable'


def valid_pairs(mappings: DataFrame) -> DataFrame:
    return mappings.where((F.col("from") != "") & (F.col("to") != ""))


def escape(c: Column) -> Column:
    """Back-slash every character that is special in a regex."""
    special = "[" + "".join("\\" + ch if ch in "[]\\^-&" else ch for ch in v.ESCAPED_CHARS) + "]"
    return F.regexp_replace(c, F.lit(special), F.lit("\\\\$0"))


def expand_forms(mappings: DataFrame) -> DataFrame:
    """One row per form of a variable mapping's source name, with the target in the same form."""
    pairs = valid_pairs(mappings).where(F.col("kind") == "variable")
    formed = names.with_forms(pairs.select("set_id", "kind", "ord", "from", "to"), "from")
    # outer: for a plain explode of a column the optimizer adds a filter on it, and pushing that
    # filter down would repeat every form expression many times over
    forms = formed.select(
        "set_id", "kind", "ord", "from", "to", F.posexplode_outer("forms").alias("form_pos", "f")
    ).where(F.col("f").isNotNull()).select("set_id", "kind", "ord", "from", "to", "form_pos", "f.*")
    form, to = F.col("form"), F.col("to")
    shaped = forms.withColumn(
        "_target",
        F.when(names.is_upper(form), names.upper_snake_case(to))
        .when(F.contains(form, F.lit("-")), names.kebab_case(to))
        .when(F.contains(form, F.lit("_")) & ~names.starts_upper(form), names.snake_case(to))
        .when(names.starts_upper(form), names.pascal_case(to))
        .otherwise(names.camel_case(to)),
    )
    target = F.col("_target")
    return shaped.withColumn(
        "replacement",
        F.when(F.col("tag") == "plural", names.pluralize(target))
        .when(F.col("tag") == "singular", names.singularize(target))
        .otherwise(target),
    ).drop("_target")


def form_shapes(form: Column) -> Column:
    """The surroundings in which a form is renamed."""
    plain = ~F.contains(form, F.lit("-"))
    no_underscore = ~F.contains(form, F.lit("_"))
    long = F.length(form) > 1
    pascal = names.starts_upper(form) & plain & no_underscore & long
    shapes = F.array(
        F.when(names.is_upper(form) & no_underscore, "upper_prefix"),
        F.lit("standalone"),
        F.when(pascal, "pascal_prefix"),
        F.when(pascal, "pascal_suffix"),
        F.when(names.starts_lower(form) & plain & long, "camel_prefix"),
    )
    return F.array_compact(shapes)


def _with_pattern(rules: DataFrame) -> DataFrame:
    before = F.create_map(*[F.lit(x) for s, (b, _) in v.SHAPES.items() for x in (s, b)])
    after = F.create_map(*[F.lit(x) for s, (_, a) in v.SHAPES.items() for x in (s, a)])
    escaped = escape(F.col("literal"))
    return rules.select(
        "set_id", "kind", "ord", "form_pos", "shape_pos", "literal", "shape",
        F.concat(before[F.col("shape")], escaped, after[F.col("shape")]).alias("pattern"),
        "replacement",
        F.length(escaped).alias("core_len"),
    )


def variable_rules(mappings: DataFrame) -> DataFrame:
    rules = expand_forms(mappings).select(
        "set_id", "kind", "ord", "form_pos",
        F.posexplode(form_shapes(F.col("form"))).alias("shape_pos", "shape"),
        F.col("form").alias("literal"),
        "replacement",
    )
    return _with_pattern(rules)


def package_rules(mappings: DataFrame) -> DataFrame:
    return _package_rules(mappings, lambda frm, to: F.array(F.struct(frm.alias("l"), to.alias("r"))))


def _package_rules(mappings: DataFrame, variants) -> DataFrame:
    pairs = valid_pairs(mappings).where(F.col("kind") == "package")
    rules = pairs.select(
        "set_id", "kind", "ord",
        F.posexplode(variants(F.col("from"), F.col("to"))).alias("form_pos", "w"),
        F.lit(0).alias("shape_pos"),
        F.lit("package").alias("shape"),
    ).select("*", F.col("w.l").alias("literal"), F.col("w.r").alias("replacement"))
    return _with_pattern(rules)


def content_rules(mappings: DataFrame) -> DataFrame:
    """Rules for file contents: package names, then identifiers."""
    return package_rules(mappings).unionByName(variable_rules(mappings))


def path_variants(lang: str):
    """How a package mapping is spelled inside a path."""

    def java(frm: Column, to: Column) -> Column:
        return F.array(
            F.struct(F.replace(frm, F.lit("."), F.lit("/")).alias("l"), F.replace(to, F.lit("."), F.lit("/")).alias("r"))
        )

    def react(frm: Column, to: Column) -> Column:
        back = F.lit("\\")
        return F.array_distinct(
            F.array(
                F.struct(frm.alias("l"), to.alias("r")),
                F.struct(F.replace(frm, F.lit("/"), back).alias("l"), F.replace(to, F.lit("/"), back).alias("r")),
            )
        )

    return {v.SPRING: java, v.REACT: react}[lang]


def path_rules(mappings: DataFrame, lang: str) -> DataFrame:
    return _package_rules(mappings, path_variants(lang)).unionByName(variable_rules(mappings))


def distinct_rules(rules: DataFrame) -> DataFrame:
    """One rule per pattern and set; the earliest wins."""
    order = F.struct(*RULE_ORDER)
    rest = [c for c in rules.columns if c not in ("set_id", "pattern")]
    return (
        rules.groupBy("set_id", "pattern")
        .agg(F.min_by(F.struct(*rest), order).alias("_r"))
        .select("set_id", "pattern", "_r.*")
    )


def rank_rules(rules: DataFrame) -> DataFrame:
    """Distinct rules with their 1-based priority per set: longest escaped literal first,
    then rule order."""
    kept = distinct_rules(rules).withColumn("_len", -F.col("core_len"))
    numbered = number_rows(kept, ["set_id", "_len", *RULE_ORDER], "_n")
    first = numbered.groupBy("set_id").agg(F.min("_n").alias("_first"))
    return (
        numbered.join(first, "set_id")
        .withColumn("rank", F.col("_n") - F.col("_first") + 1)
        .drop("_n", "_first", "_len")
    )


def invert_mappings(mappings: DataFrame) -> DataFrame:
    return valid_pairs(mappings).select(
        "set_id", "kind", "ord", F.col("to").alias("from"), F.col("from").alias("to")
    )


# --- validation -----------------------------------------------------------------


def _counted_pairs(mappings: DataFrame) -> DataFrame:
    """Distinct pairs with their number and first place, so that a source mapped a
    million times is a few rows before anything is shuffled."""
    return (
        valid_pairs(mappings)
        .groupBy("set_id", "kind", "from", "to")
        .agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord"))
    )


def self_maps(mappings: DataFrame) -> DataFrame:
    """Pairs that map a name to itself."""
    return (
        _counted_pairs(mappings)
        .where(F.col("from") == F.col("to"))
        .select("set_id", "kind", "from", "to", "n")
    )


def duplicates(mappings: DataFrame) -> DataFrame:
    """Pairs whose source was mapped to something else before; the first one wins."""
    key = ["set_id", "kind", "from"]
    pairs = _counted_pairs(mappings)
    first = (
        pairs.groupBy(*key)
        .agg(F.min_by("to", "ord").alias("first_to"), F.count(F.lit(1)).alias("_targets"))
        .where(F.col("_targets") > 1)
        .drop("_targets")
    )
    return (
        pairs.join(first, key)
        .where(F.col("to") != F.col("first_to"))
        .select(*key, "first_to", "to", "n")
    )


def _pair_counts(hits: DataFrame, pairs: DataFrame) -> DataFrame:
    """Add how many mapping pairs (m1, m2), m1 <> m2, a hit (m1's target, m2's source) stands for.

    The pairs themselves are never listed: a target shared by many mappings and a
    source shared by many mappings stay one row each.
    """
    n_to = pairs.groupBy("set_id", F.col("to").alias("target")).agg(F.count(F.lit(1)).alias("n_targets"))
    n_from = pairs.groupBy("set_id", F.col("from").alias("source")).agg(F.count(F.lit(1)).alias("n_sources"))
    n_both = pairs.groupBy("set_id", F.col("to").alias("target"), F.col("from").alias("source")).agg(
        F.count(F.lit(1)).alias("n_same")
    )
    counted = (
        hits.join(n_to, ["set_id", "target"])
        .join(n_from, ["set_id", "source"])
        .join(n_both, ["set_id", "target", "source"], "left")
    )
    return counted.withColumn(
        "n_pairs", F.col("n_targets") * F.col("n_sources") - F.coalesce("n_same", F.lit(0))
    ).where(F.col("n_pairs") > 0).drop("n_same")


def package_cascades(mappings: DataFrame) -> DataFrame:
    """Package targets that contain another pair's source: one row per (target, source).

    A source is looked for in the targets by its rarest characters in a row, so there is a row
    per place that may hold one, not per substring.
    """
    pairs = materialize(valid_pairs(mappings).where(F.col("kind") == "package").select("set_id", "from", "to"), "packages")
    sources = pairs.select("set_id", F.col("from").alias("source")).distinct()
    targets = pairs.select("set_id", F.col("to").alias("target")).distinct()
    words = materialize(targets.select(F.col("target").alias("word")).distinct(), "targets")
    literals = materialize(sources.select(F.col("source").alias("literal")).distinct(), "sources")
    found = open_places(words, literals).select(F.col("word").alias("target"), F.substr("w", F.lit(2), F.col("len")).alias("source")).distinct()
    hits = found.join(targets, "target").join(sources, ["set_id", "source"], "left_semi")
    return _pair_counts(hits, pairs).select("set_id", "target", "source", "n_targets", "n_sources", "n_pairs")


def variable_overlaps(mappings: DataFrame) -> DataFrame:
    """Target names that share forms with another pair's source name, with the shared forms."""
    # stored: the pairs are read six times, and the forms are costly to compute twice
    pairs = materialize(valid_pairs(mappings).where(F.col("kind") == "variable").select("set_id", "from", "to"), "pairs")
    sources = pairs.select("set_id", F.col("from").alias("source")).distinct()
    targets = pairs.select("set_id", F.col("to").alias("target")).distinct()
    source_forms = materialize(names.with_form_set(sources, "source", "form"), "forms")
    target_forms = materialize(names.with_form_set(targets, "target", "form"), "forms")
    shared = (
        target_forms.join(source_forms, ["set_id", "form"])
        .groupBy("set_id", "target", "source")
        # a name has at most 15 forms
        .agg(F.array_join(F.array_sort(F.collect_set("form")), ", ").alias("shared"))
    )
    return _pair_counts(shared, pairs).select(
        "set_id", "target", "source", "shared", "n_targets", "n_sources", "n_pairs"
    )


def validate_mappings(mappings: DataFrame) -> DataFrame:
    """All problems of the mapping sets as one table: set_id, kind, problem, message, n."""
    selfs = self_maps(mappings).select(
        "set_id", "kind", F.lit("self_map").alias("problem"),
        F.format_string("%s mapping '%s' maps to itself", "kind", "from").alias("message"), "n",
    )
    repeated = duplicates(mappings).select(
        "set_id", "kind", F.lit("duplicate").alias("problem"),
        F.format_string(
            "duplicate %s mapping for '%s' ('%s' vs '%s') — the first one wins",
            "kind", "from", "first_to", "to",
        ).alias("message"), "n",
    )
    cascades = package_cascades(mappings).select(
        "set_id", F.lit("package").alias("kind"), F.lit("cascade").alias("problem"),
        F.format_string(
            "package mapping of '%s' would have cascaded onto the output '%s'; "
            "replacements are applied in a single pass, so it will not", "source", "target",
        ).alias("message"),
        F.col("n_pairs").alias("n"),
    )
    overlaps = variable_overlaps(mappings).select(
        "set_id", F.lit("variable").alias("kind"), F.lit("overlap").alias("problem"),
        F.format_string(
            "variable mapping of '%s' overlaps the output '%s' (%s); "
            "replacements are applied in a single pass, so it will not cascade",
            "source", "target", "shared",
        ).alias("message"),
        F.col("n_pairs").alias("n"),
    )
    return selfs.unionByName(repeated).unionByName(cascades).unionByName(overlaps)


def mapping_fingerprint(mappings: DataFrame, literals: DataFrame | None = None) -> DataFrame:
    """SHA-256 fingerprint per mapping set, literals included; list order matters.

    Every entry is hashed with its place; the entry hashes are added up in eight
    32-bit lanes (so no set is ever gathered in one task) and the sums hashed again.
    """

    hashed = mappings.select(
        "set_id", F.sha2(F.concat_ws("\u001f", "kind", F.col("ord").cast("string"), "from", "to"), 256).alias("h")
    )
    if literals is not None:
        hashed = hashed.unionByName(
            literals.select("set_id", F.sha2(F.concat_ws("\u001f", F.lit("literal"), "token", "literal"), 256).alias("h"))
        )
    lanes = [
        F.sum(F.conv(F.substr("h", F.lit(8 * i + 1), F.lit(8)), 16, 10).cast("bigint")).alias(f"s{i}")
        for i in range(8)
    ]
    sums = hashed.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"), *lanes)
    return sums.select(
        "set_id",
        F.sha2(F.concat_ws(",", "n", *[f"s{i}" for i in range(8)]), 256).alias("mapping_sha256"),
    )
