"""One-pass, non-cascading renaming of text and path columns.

Every rule is a literal plus a condition on its neighbours. Of two literals that
match at the same place one is a prefix of the other, so rule priority means: the
longest literal whose condition holds wins, and on equal literals a package rule
comes before an identifier rule. Both ways below use this:

* few literals: one regex with the literals in a prefix tree, inside the plan;
* many literals: the distinct words of the corpus are renamed by equi-joins and the
  texts are rebuilt from the renamed words.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusveil import values as v
from corpusveil.functions.columns import bucket_lookup, collect_dictionary, is_match, let, pieces, replace_matches
from corpusveil.operators import rules as R
from corpusveil.operators.anchors import open_places
from corpusveil.plans.joins import dictionary_join, fits_broadcast, substitute
from corpusveil.session import materialize, parallelism

INLINE_LITERALS = 600
INLINE_LITERAL_CHARS = 1_000


def literal_table(rules: DataFrame) -> DataFrame:
    """One row per literal and kind: its replacement (first rule wins) and its shapes."""
    order = F.struct(*R.RULE_ORDER)
    return rules.groupBy("literal", "kind").agg(
        F.min_by("replacement", order).alias("replacement"),
        F.array_sort(F.collect_set("shape")).alias("shapes"),
    )


# --- few literals: regex in the plan ------------------------------------------------


def _quote(ch: str) -> str:
    return "\\" + ch if not (ch.isalnum() or ch == "_" or ord(ch) > 127) else ch


def _condition(literal: str, shapes: list[str]) -> str:
    """What must surround the literal just read, as lookarounds behind it."""
    quoted = "".join(map(_quote, literal))
    alternatives = set()
    for shape in shapes:
        before, after = v.SHAPES[shape]
        behind = before[:-1] + quoted + ")" if before else ""
        alternatives.add(behind + after)
    return "(?:" + "|".join(sorted(alternatives)) + ")"


def _tree_pattern(endings: dict[str, str]) -> str:
    """A regex for {literal: condition}: longer literals are tried before their prefixes."""
    root: dict = {}
    for literal, condition in endings.items():
        node = root
        for ch in literal:
            node = node.setdefault(ch, {})
        node[""] = condition

    def render(node: dict) -> str:
        chain = ""
        while len(node) == 1 and "" not in node:
            ch, node = next(iter(node.items()))
            chain += _quote(ch)
        branches = [_quote(ch) + render(node[ch]) for ch in sorted(k for k in node if k)]
        if "" in node:
            branches.append(node[""])
        return chain + (branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")")

    first = "".join(sorted({"\\" + c if c in "[]\\^-&" else c for c in root}))
    return f"(?=[{first}])" + "(?:" + render(root) + ")"


@dataclass
class InlineRename:
    """A rename small enough to live in the query plan."""

    pattern: str
    lookup: object

    def rename(self, text: Column) -> Column:
        return replace_matches(text, self.pattern, self._replacement)

    def count(self, text: Column) -> Column:
        return F.regexp_count(text, F.lit(self.pattern))

    def matches(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))

    def _replacement(self, match: Column) -> Column:
        return F.coalesce(self.lookup(match), match)


@dataclass
class ContestedRename(InlineRename):
    """As InlineRename, where some literal is both a package and an identifier source:
    the neighbours of the match decide which replacement applies."""

    package_lookup: object = None

    def rename(self, text: Column) -> Column:
        word = F.lit(r"[A-Za-z0-9_]")

        def rebuilt(parts: Column) -> Column:
            def one(p: Column, i: Column) -> Column:
                # neighbours: the nearest characters left and right of the match
                left = F.right(F.array_join(F.slice(parts, F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2))), ""), F.lit(1))
                right = F.left(F.array_join(F.slice(parts, i + 2, F.lit(2)), ""), F.lit(1))
                free = ~F.rlike(left, word) & ~F.rlike(right, word)
                package = F.when(free, self.package_lookup(p))
                return F.when(is_match(i), F.coalesce(package, self.lookup(p), p)).otherwise(p)

            return F.array_join(F.transform(parts, one), "")

        return let(pieces(text, self.pattern), rebuilt)


def compile_inline(rules: DataFrame) -> InlineRename | None:
    """The in-plan rename for these rules, or None when they are too many."""
    longest = INLINE_LITERAL_CHARS + 1
    rows = (
        literal_table(rules)
        .select(
            F.left("literal", F.lit(longest)).alias("literal"), "kind", F.left("replacement", F.lit(longest)).alias("replacement"),
            "shapes", F.xxhash64("literal").alias("code"),
        )
        .limit(INLINE_LITERALS + 1)
        .collect()
    )
    if len(rows) > INLINE_LITERALS or any(max(len(r.literal), len(r.replacement)) == longest for r in rows):
        return None
    if not rows:
        return InlineRename(r"(?!)", lambda m: m)
    shapes: dict[str, list[str]] = {}
    lookups: dict[str, list] = {"package": [], "variable": []}
    for r in rows:
        shapes.setdefault(r.literal, []).extend(r.shapes)
        lookups[r.kind].append((r.literal, r.replacement, r.code))
    pattern = _tree_pattern({literal: _condition(literal, found) for literal, found in shapes.items()})
    if len(shapes) < len(rows):
        return ContestedRename(pattern, bucket_lookup(lookups["variable"]), bucket_lookup(lookups["package"]))
    return InlineRename(pattern, bucket_lookup(lookups["package"] + lookups["variable"]))


# --- many literals: rename the vocabulary ---------------------------------------------


@dataclass
class Vocabulary:
    """Distinct words of a corpus that change: word, renamed, n (substitutions in it), forms (what they replace)."""

    word_pattern: str
    words: DataFrame


def _word_class(literals: DataFrame) -> str:
    """Letters, digits, underscore and every other character used in a literal. Rules look
    at letters, digits and underscores only, so a word's edge acts like the text's edge."""
    others = (
        literals.select(F.explode(F.array_distinct(F.split("literal", ""))).alias("ch"))
        .where(~F.rlike("ch", F.lit(r"\A[A-Za-z0-9_]?\z")))
        .distinct()
    )
    extra = "".join(sorted("\\" + r.ch if ord(r.ch) < 128 else r.ch for r in others.collect()))
    return f"[A-Za-z0-9_{extra}]"


def _inner_places(words: DataFrame, literals: DataFrame) -> DataFrame:
    """Places inside words where a literal may stand: word, at, len, literal, and which
    surroundings hold there."""
    placed = open_places(words, literals)

    def between(c: Column, *ranges: str) -> Column:
        return reduce(Column.__or__, [(c >= r[0]) & (c <= r[-1]) for r in ranges])

    before, first = F.substr("w", F.lit(1), F.lit(1)), F.substr("w", F.lit(2), F.lit(1))
    one, two = F.substr("w", F.col("len") + 2, F.lit(1)), F.substr("w", F.col("len") + 3, F.lit(1))
    opens, closes = ~between(before, "az", "AZ", "09"), ~between(one, "az", "AZ", "09")
    flags = {
        "package": opens & (before != "_") & closes & (one != "_"),
        "standalone": opens & (before != "_") & closes,
        "upper_prefix": (one == "_") & between(two, "AZ"),
        "prefix": between(one, "AZ"),
        "pascal_suffix": between(before, "az") & between(first, "AZ"),
    }
    return placed.where(reduce(Column.__or__, flags.values())).select(
        "word", "at", "len", F.substr("w", F.lit(2), F.col("len")).alias("literal"), *[c.alias(name) for name, c in flags.items()]
    )


def build_vocabulary(texts: DataFrame, col: str, rules: DataFrame) -> Vocabulary:
    """Rename every distinct word of texts[col] once."""
    table = literal_table(rules)
    by_kind = table.groupBy("literal").agg(
        F.max(F.when(F.col("kind") == "package", F.col("replacement"))).alias("as_package"),
        F.max(F.when(F.col("kind") == "variable", F.col("replacement"))).alias("as_variable"),
        F.max(F.when(F.col("kind") == "variable", F.col("shapes"))).alias("shapes"),
    )
    literals = materialize(by_kind, "literals")
    cls = _word_class(literals)
    longest = literals.agg(F.max(F.length("literal")).alias("n")).first().n or 1

    words = texts.select(
        F.explode(F.array_distinct(F.regexp_extract_all(F.col(col), F.lit(cls + "++"), F.lit(0)))).alias("word")
    ).distinct()
    # few bytes but much work per word: do not let the planner merge them into few tasks
    words = materialize(words.repartition(parallelism(texts.sparkSession), "word"), "words")
    yes, no = F.lit(True), F.lit(False)
    # most words have no inner capital, underscore or other edge: only the whole word can match
    plain = F.rlike("word", F.lit("^[A-Za-z]?[a-z0-9]*$"))
    whole = words.where(plain & (F.length("word") <= longest)).select(
        "word", F.lit(0).alias("at"), F.length("word").alias("len"), F.col("word").alias("literal"),
        yes.alias("package"), yes.alias("standalone"), no.alias("upper_prefix"), no.alias("prefix"), no.alias("pascal_suffix"),
    )

    inner = _inner_places(words.where(~plain), literals)
    edged = whole.unionByName(inner)
    if not fits_broadcast(literals):
        # most forms of very many names stand in no word: the join need not repeat them
        edged = materialize(edged, "places")
        literals = materialize(literals.join(edged.select("literal").distinct().hint("merge"), "literal", "left_semi"), "found")
    hits = dictionary_join(edged, literals, ["literal"], ["word"])
    by_shape = F.lit(False)
    for shape, flag in [
        ("standalone", "standalone"), ("upper_prefix", "upper_prefix"), ("pascal_prefix", "prefix"),
        ("camel_prefix", "prefix"), ("pascal_suffix", "pascal_suffix"),
    ]:
        by_shape = by_shape | (F.array_contains("shapes", shape) & F.col(flag))
    chosen = F.coalesce(F.when(F.col("package"), F.col("as_package")), F.when(by_shape, F.col("as_variable")))
    winners = (
        hits.withColumn("new", chosen)
        .where(F.col("new").isNotNull())
        .groupBy("word", "at")
        .agg(F.max_by(F.struct("len", "new"), "len").alias("hit"))
    )

    def take(acc: Column, h: Column) -> Column:
        free = h["at"] >= acc["end"]
        gap = F.substr(F.col("word"), acc["end"] + 1, h["at"] - acc["end"])
        return F.when(
            free,
            F.struct(
                (h["at"] + h["hit"]["len"]).alias("end"),
                F.concat(acc["out"], gap, h["hit"]["new"]).alias("out"),
                (acc["n"] + 1).alias("n"),
                F.concat(acc["forms"], F.array(F.substr(F.col("word"), h["at"] + 1, h["hit"]["len"]))).alias("forms"),
            ),
        ).otherwise(acc)

    start = F.struct(F.lit(0).alias("end"), F.lit("").alias("out"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("forms"))
    # a group is one word: it has no more hits than characters
    folded = winners.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("at", "hit"))).alias("hits")).select(
        "word", F.aggregate("hits", start, take).alias("r")
    )
    renamed = folded.select(
        "word", F.concat(F.col("r.out"), F.substr("word", F.col("r.end") + 1)).alias("renamed"), F.col("r.n").alias("n"), "r.forms"
    )
    return Vocabulary(cls + "++", materialize(renamed, "vocabulary"))


def _by_vocabulary(df: DataFrame, id_cols: list[str], col: str, out: str, count: str | None, voc: Vocabulary, join: bool = False) -> DataFrame:
    """Rebuild texts from renamed words: within the plan while the changing words are few
    (checked), by a join beyond that or if asked for."""
    lookup = None if join else collect_dictionary(voc.words, "word", "renamed")
    number = lookup and count and collect_dictionary(voc.words.withColumn("n", F.col("n").cast("string")), "word", "n")
    if lookup is None or (count and number is None):
        return _by_word(df, id_cols, col, out, count, voc)
    text = replace_matches(F.col(col), voc.word_pattern, lambda w: F.coalesce(lookup(w), w))
    if count:
        found = F.regexp_extract_all(F.col(col), F.lit(voc.word_pattern), F.lit(0))
        total = F.aggregate(found, F.lit(0), lambda acc, w: acc + F.coalesce(number(w).cast("int"), F.lit(0)))
        df = df.withColumn("_n", total)
    df = df.withColumn(out, text)
    return df.withColumnRenamed("_n", count) if count else df


def _by_word(df: DataFrame, id_cols: list[str], col: str, out: str, count: str | None, voc: Vocabulary) -> DataFrame:
    """As _by_vocabulary, with the words joined."""
    parts = F.transform(
        pieces(F.col(col), voc.word_pattern),
        lambda p, i: F.struct(p.alias("text"), F.when(is_match(i), p).alias("key")),
    )
    dictionary = voc.words.select(F.col("word").alias("key"), F.col("renamed").alias("value"), "n")
    words = F.regexp_extract_all(F.col(col), F.lit(voc.word_pattern), F.lit(0))
    return substitute(df, id_cols, col, parts, dictionary, out, lambda old, new: new, count, words)


# --- operators --------------------------------------------------------------------------


def rename_text(
    df: DataFrame, id_cols: list[str], col: str, rules: DataFrame, out: str | None = None, count: str | None = None, join: bool = False
) -> DataFrame:
    """df with texts renamed in `out` (default: in place) and, when asked for, the number
    of substitutions in `count`. Picks the way by the checked number of literals; `join`
    takes the one for any number."""
    out = out or col
    inline = None if join else compile_inline(rules)
    if inline:
        source = F.col(col)
        df = df.withColumn(count, inline.count(source)) if count else df
        return df.withColumn(out, inline.rename(source))
    return _by_vocabulary(df, id_cols, col, out, count, build_vocabulary(df, col, rules), join)


def count_substitutions(df: DataFrame, id_cols: list[str], col: str, rules: DataFrame, out: str, join: bool = False) -> DataFrame:
    inline = None if join else compile_inline(rules)
    if inline:
        return df.withColumn(out, inline.count(F.col(col)))
    return _by_vocabulary(df, id_cols, col, "_renamed", out, build_vocabulary(df, col, rules), join).drop("_renamed")


def substitution_report(df: DataFrame, id_cols: list[str], col: str, rules: DataFrame, join: bool = False) -> DataFrame:
    """Per matched form: occurrences and texts it occurs in, over the whole table. Every row is a
    text of its own, whatever its ids."""
    inline = None if join else compile_inline(rules)
    if inline:
        # count inside each text first: one row per text and form instead of one per hit
        hits = df.select(inline.matches(F.col(col)).alias("_hits"))
        per_text = hits.select(F.explode(F.array_distinct("_hits")).alias("form"), "_hits").select(
            "form", F.size(F.filter("_hits", lambda h: h == F.col("form"))).alias("_n")
        )
        return per_text.groupBy("form").agg(F.sum("_n").alias("n_hits"), F.count(F.lit(1)).alias("n_texts"))
    voc = build_vocabulary(df, col, rules)
    found = df.select(_row_key(id_cols, col), F.explode(F.regexp_extract_all(F.col(col), F.lit(voc.word_pattern), F.lit(0))).alias("word"))
    # a word of a text is one row before it meets what it holds
    counted = found.groupBy("_row", "word").agg(F.count(F.lit(1)).alias("_c"))
    hits = dictionary_join(counted, voc.words.select("word", "forms"), ["word"], ["_row"])
    forms = hits.select("_row", "_c", F.explode("forms").alias("form")).groupBy("_row", "form").agg(F.sum("_c").alias("_n"))
    # rows alike in ids and text share a key: each of them is a text
    copies = df.select(_row_key(id_cols, col)).groupBy("_row").agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    return forms.join(copies, "_row", "left").groupBy("form").agg(
        F.sum("_n").alias("n_hits"), F.sum(F.coalesce("_copies", F.lit(1).cast("bigint"))).alias("n_texts")
    )


def _row_key(id_cols: list[str], col: str) -> Column:
    return F.xxhash64(*id_cols, col).alias("_row")


def rename_path(df: DataFrame, id_cols: list[str], col: str, mappings: DataFrame, lang: str, out: str, join: bool = False) -> DataFrame:
    """Rename all segments of a path below its base directory."""
    return rename_text(df, id_cols, col, R.path_rules(mappings, lang), out, join=join)


def java_output_path(df: DataFrame, id_cols: list[str], col: str, mappings: DataFrame, out: str, join: bool = False) -> DataFrame:
    """Module id -> cleaned file path: package rules on the whole name, identifier rules
    on its last segment only, then path rules on the path made of it."""
    named = rename_text(df, id_cols, col, R.package_rules(mappings), "_fqn", join=join)
    dot = r"(?s)^(.*\.)?([^.]*)\z"
    split = named.withColumn("_pkg", F.regexp_extract("_fqn", dot, 1)).withColumn(
        "_cls", F.regexp_extract("_fqn", dot, 2)
    )
    cleaned = rename_text(split, id_cols, "_cls", R.variable_rules(mappings), join=join)
    path = F.concat(F.replace(F.concat("_pkg", "_cls"), F.lit("."), F.lit("/")), F.lit(".java"))
    pathed = cleaned.withColumn("_path", path).drop("_fqn", "_pkg", "_cls")
    return rename_path(pathed, id_cols, "_path", mappings, v.SPRING, out, join).drop("_path" if out != "_path" else "")


def output_path(df: DataFrame, id_cols: list[str], col: str, mappings: DataFrame, lang: str, out: str) -> DataFrame:
    if lang == v.SPRING:
        return java_output_path(df, id_cols, col, mappings, out)
    return rename_path(df, id_cols, col, mappings, lang, out)
