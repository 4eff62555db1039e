"""Module table, import edges, resolution and dependency closure.

Files:   project, path (below the source root), lang, text.
Modules: project, module_id, path, type, lang.
Edges:   project, src_path, ord, spec, dep_id, dep_path (null = not found).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from corpusveil import values as v
from corpusveil.functions import paths
from corpusveil.operators.profiles import PROFILES, by_lang
from corpusveil.plans.joins import SMALL_ROWS, bucketed_join, hot_key_join
from corpusveil.session import bucket_count, materialize, new_table_path, number_rows, write_bucketed

PLACE_ROUNDS = 16
#: A frontier of so many rows is sent to the edges, and what it finds to the rows seen.
FEW_ROWS = 50_000
#: What few rows may find in one round before it is sent around by its keys instead.
FOUND_ROWS = 200_000
#: Edges in a bucket.
BUCKET_ROWS = 50_000
KEY = ["project", "entry", "module_id"]
CLOSURE = ["project", "entry", "module_id", "path", "type", "found", "depth"]
#: What an import is looked up by.
SOURCE = ["project", "src_path"]


def module_table(files: DataFrame, lang: Column | str | None = None) -> DataFrame:
    lang = F.col("lang") if lang is None else lang
    named = files.select(
        "project", by_lang(lang, "module_id", F.col("text"), F.col("path")).alias("module_id"), "path", "lang", "text"
    )
    return named.select(
        "project", "module_id", "path", by_lang(lang, "classify", F.col("module_id"), F.col("text")).alias("type"), "lang"
    )


# --- imports ---------------------------------------------------------------------


def java_imports(files: DataFrame, base: Column | str) -> DataFrame:
    """In-project imports of Java files: project, src_path, ord, spec. The dot after the
    base package is part of the prefix, so a.b does not take in a.b2."""
    prefix = F.concat(F.lit(base) if isinstance(base, str) else base, F.lit("."))
    found = F.regexp_extract_all("text", F.lit(v.JAVA_IMPORT), F.lit(1))
    specs = F.filter(found, lambda s: F.startswith(s, prefix) & F.rlike(s, F.lit(r"\.[A-Z][^.]*\z")))
    return files.select("project", F.col("path").alias("src_path"), F.posexplode(specs).alias("ord", "spec"))


def react_imports(files: DataFrame) -> DataFrame:
    """Distinct import specifiers per JS/TS file, in pattern order, then text order."""
    found = F.array_distinct(
        F.concat(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in v.REACT_IMPORTS])
    )
    return files.select("project", F.col("path").alias("src_path"), F.posexplode(found).alias("ord", "spec"))


# --- resolution --------------------------------------------------------------------


def resolve_java(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Exact path first; else the first file of that name (smallest path); else missing.
    Each distinct import is resolved once, however many files contain it; the imports are
    stored first so that the texts are scanned once."""
    imports = materialize(imports, "imports")
    known = files.select("project", "path")
    wanted = imports.select("project", "spec").distinct().withColumn(
        "want", F.concat(F.replace("spec", F.lit("."), F.lit("/")), F.lit(".java"))
    )
    # tables of files and imports are never broadcast: the planner takes them for far smaller than they are
    exact = wanted.join(known.withColumn("hit", F.col("path")).withColumnRenamed("path", "want").hint("merge"), ["project", "want"], "left")
    by_name = known.groupBy("project", paths.basename(F.col("path")).alias("name")).agg(F.min("path").alias("near"))
    # only what the exact path left open takes part in the second join
    name = F.when(F.col("hit").isNull(), paths.basename(F.col("want")))
    resolved = (
        exact.withColumn("name", name)
        .join(by_name.hint("merge"), ["project", "name"], "left")
        .select("project", "spec", F.coalesce("hit", "near").alias("dep_path"))
    )
    joined = hot_key_join(imports, resolved, ["project", "spec"], ["src_path"])
    return joined.select("project", "src_path", "ord", "spec", F.col("spec").alias("dep_id"), "dep_path")


def _react_candidates(base: Column) -> Column:
    """Candidate files of a normalized import target, best first."""
    ext = F.lower(paths.suffix(base))
    bare = F.left(base, F.length(base) - F.length(paths.suffix(base)))
    swapped = F.when(
        ext.isin(".js", ".jsx"), F.array(base, F.concat(bare, F.lit(".ts")), F.concat(bare, F.lit(".tsx")))
    ).otherwise(F.array(base))
    named = F.array(*[F.concat(base, F.lit(e)) for e in v.EXTENSIONS[v.REACT]])
    indexed = F.array(*[paths.join(base, F.lit("index" + e)) for e in v.EXTENSIONS[v.REACT]])
    return (
        F.when(ext.isin(v.EXTENSIONS[v.REACT]), swapped)
        .when(base == "", indexed)
        .otherwise(F.concat(named, indexed))
    )


def resolve_react(imports: DataFrame, files: DataFrame, alias: str = v.DEFAULT_ALIAS) -> DataFrame:
    """Relative and alias imports against the file table; bare modules and assets are
    outside the project and dropped."""
    spec = F.col("spec")
    relative = F.startswith(spec, F.lit("."))
    aliased = (spec == alias) | F.startswith(spec, F.lit(alias + "/"))
    target = F.when(relative, paths.join(paths.parent(F.col("src_path")), spec)).otherwise(
        F.substr(spec, F.lit(len(alias) + 1))
    )
    asset = F.lower(paths.suffix(F.rtrim(spec, F.lit("/")))).isin(v.ASSET_EXTENSIONS)
    inside = materialize(
        imports.where((relative | aliased) & ~asset)
        .withColumn("base", paths.normalize(target))
        .withColumn("_relative", relative),
        "imports",
    )
    options = inside.select("project", "base").distinct().select(
        "project", "base", F.posexplode(_react_candidates(F.col("base"))).alias("rank", "path")
    )
    resolved = (
        options.join(files.select("project", "path").hint("merge"), ["project", "path"])
        .groupBy("project", "base")
        .agg(F.min_by("path", "rank").alias("dep_path"))
    )
    joined = hot_key_join(inside, resolved, ["project", "base"], ["src_path"], "left")
    outside = (F.col("base") == "..") | F.startswith("base", F.lit("../"))
    guess = F.when(F.col("_relative") & ~outside, F.col("base")).otherwise(spec)
    return joined.select(
        "project", "src_path", "ord", "spec", F.coalesce("dep_path", guess).alias("dep_id"), "dep_path"
    )


def missing_modules(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Modules that are referred to but have no file."""
    wanted = edges.where(F.col("dep_path").isNull()).select("project", F.col("dep_id").alias("module_id")).distinct()
    return wanted.join(modules.select("project", "module_id").hint("merge"), ["project", "module_id"], "left_anti")


# --- closure ---------------------------------------------------------------------------


def trace_closure(
    entries: DataFrame, edges: DataFrame, modules: DataFrame, lang: str = v.DEFAULT_LANG, sequence: bool = True,
    bucketed: bool | None = None,
) -> DataFrame:
    """Breadth-first closure of every entry (project, entry = path of a file).

    One round per depth over all entries at once: frontier joined to the edges,
    deduplicated by the first parent, minus what was seen. Every round is written to the
    shared folder, so plans stay short and a lost executor costs one round at most.
    `seq` is the order of discovery: missing modules come right after the module that
    first names them, found ones in queue order.

    Beyond SMALL_ROWS edges (or with `bucketed`) edges and keys seen are bucketed tables: a
    round moves its frontier and what that finds, never the edges or what is seen already.
    There are as many buckets as the edges ask for. Rounds of few rows, of which a deep graph
    has many, leave the buckets alone: they read edges and keys once and move neither.
    """
    spark = edges.sparkSession
    adjacency = materialize(
        edges.join(
            # there are as many modules as files, however few bytes the planner thinks they take
            modules.select("project", F.col("path").alias("dep_path"), F.col("module_id").alias("_mid"), F.col("type").alias("_type")).hint("merge"),
            ["project", "dep_path"],
            "left",
        ).select(
            "project", "src_path", "ord", "dep_path",
            F.coalesce("_mid", "dep_id").alias("module_id"),
            F.coalesce("_type", by_lang(lang, "classify", F.col("dep_id"), F.lit(""))).alias("type"),
        ),
        "adjacency",
    )
    n_edges = adjacency.count()
    if bucketed is None:
        bucketed = n_edges > SMALL_ROWS

    base = new_table_path(spark, "closure")
    # names in the catalog for the time of the rounds
    seen, known = (f"corpusveil_{label}_{base[-32:]}" for label in ("seen", "edges"))
    row = "project STRING, entry STRING, module_id STRING, path STRING, type STRING, p_place STRING, ord INT, place STRING"

    def store(df: DataFrame, depth: int) -> int:
        """Write the rows of one depth; returns how many. `place` sorts like the order of
        discovery within a depth: the place of the first parent and the import number, in hex
        after the count of its digits. Every PLACE_ROUNDS rounds it becomes a rank, so it stays
        short on deep graphs."""
        number = F.hex("ord")
        df = df.withColumn("place", F.concat("p_place", F.length(number).cast("string"), number))
        if depth and depth % PLACE_ROUNDS == 0:
            order = ["project", "entry", "place"]
            ranked = df.repartitionByRange(*order).sortWithinPartitions(*order)
            df = ranked.withColumn("place", F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))
        written = Observation()
        df.observe(written, F.count(F.lit(1)).alias("n")).write.parquet(f"{base}/depth={depth}")
        return written.get["n"]

    def stored(first: int = 0) -> DataFrame:
        """The rounds from depth `first` on as one scan, with their depth."""
        return spark.read.schema(row + ", depth INT").parquet(base).where(F.col("depth") >= first)

    start = entries.select("project", "entry", F.col("entry").alias("path")).distinct().join(
        modules.select("project", "path", "module_id", "type").hint("merge"), ["project", "path"]
    ).select(*KEY, "path", "type", F.lit("").alias("p_place"), F.lit(0).alias("ord"))
    buckets = min(bucket_count(spark), max(spark.sparkContext.defaultParallelism, n_edges // BUCKET_ROWS))
    # depths below `indexed` are in the bucketed table of keys, those below `packed` in one table of few files
    indexed = packed = 0
    settled = None
    try:
        depth, rows = 0, store(start, 0)
        while rows:
            if not bucketed:
                fresh = next_round(stored(), adjacency, depth, rows)
            elif rows <= FEW_ROWS:
                if packed < indexed:
                    packed, settled = depth + 1, materialize(stored().select(*KEY), "seen")
                sofar = stored(packed).select(*KEY)
                fresh = few_round(sofar.unionByName(settled) if settled else sofar, adjacency, _frontier(stored(), depth))
            else:
                if not indexed:
                    write_bucketed(adjacency.repartition(buckets, *SOURCE), known, f"{base}-edges", SOURCE, buckets=buckets)
                late = stored(indexed).select(*KEY).repartition(buckets, *KEY)
                write_bucketed(late, seen, f"{base}-seen", KEY, buckets=buckets)
                indexed = depth + 1
                fresh = next_round(spark.table(seen), spark.table(known), depth, rows, True, _frontier(stored(), depth), buckets)
            depth += 1
            rows = store(fresh, depth)
    finally:
        for name in (seen, known):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    reached = stored().withColumn("found", F.col("path").isNotNull())
    if not sequence:
        return reached.select(*CLOSURE)
    # a missing module is listed with its parent, a found one when its turn comes
    ordered = reached.select(
        *CLOSURE,
        (F.col("depth") - F.when(F.col("found"), 0).otherwise(1)).alias("_d"),
        F.when(F.col("found"), F.col("place")).otherwise(F.col("p_place")).alias("_p"),
        F.when(F.col("found"), F.lit(-1)).otherwise(F.col("ord")).alias("_o"),
    )
    numbered = number_rows(ordered, ["project", "entry", "_d", "_p", "_o"], "_n")
    first = numbered.groupBy("project", "entry").agg(F.min("_n").alias("_first"))
    return numbered.join(first, ["project", "entry"]).select(*CLOSURE, (F.col("_n") - F.col("_first")).alias("seq"))


def _frontier(sofar: DataFrame, depth: int) -> DataFrame:
    """The files that the rows of `depth` open."""
    return sofar.where((F.col("depth") == depth) & F.col("path").isNotNull()).select(
        "project", "entry", F.col("path").alias("src_path"), F.col("place").alias("p_place")
    )


def _first_parents(opened: DataFrame) -> DataFrame:
    return opened.groupBy(*KEY).agg(F.min(F.struct("p_place", "ord", F.col("dep_path").alias("path"), "type")).alias("_f"))


def _unknown(found: DataFrame, sofar: DataFrame) -> DataFrame:
    """Hashed is what a round found; what is seen already only passes by, neither sorted nor sent around."""
    known = sofar.select(*KEY, F.lit(True).alias("_known"))
    return found.hint("shuffle_hash").join(known, KEY, "left").where(F.col("_known").isNull())


def next_round(
    sofar: DataFrame, adjacency: DataFrame, depth: int, rows: int, bucketed: bool = False,
    frontier: DataFrame | None = None, buckets: int | None = None,
) -> DataFrame:
    """What the rows of `depth` find first: each module once an entry, by its first parent.
    `sofar` may be keys alone if the frontier is given."""
    frontier = _frontier(sofar, depth) if frontier is None else frontier
    if bucketed:
        opened = bucketed_join(frontier, adjacency, SOURCE, ["entry"], rows, buckets)
    elif rows <= FEW_ROWS:
        opened = adjacency.join(F.broadcast(frontier), SOURCE)
    else:
        opened = hot_key_join(frontier, adjacency, SOURCE, ["entry"], rows=rows)
    found = _first_parents(opened)
    if buckets:
        # combined first, then dealt as the table is: the number of buckets need not be that of a shuffle
        found = found.repartition(buckets, *KEY)
    return _unknown(found, sofar).select(*KEY, "_f.path", "_f.type", "_f.p_place", "_f.ord")


def few_round(sofar: DataFrame, adjacency: DataFrame, frontier: DataFrame) -> DataFrame:
    """As next_round for a frontier of at most FEW_ROWS rows: edges and keys seen pass by once and
    are not moved, so a round costs one scan of either, whatever it finds."""
    counted = Observation()
    opened = adjacency.join(F.broadcast(frontier), SOURCE)
    found = materialize(_first_parents(opened).observe(counted, F.count(F.lit(1)).alias("n")), "found")
    if counted.get["n"] > FOUND_ROWS:
        fresh = _unknown(found, sofar)
    else:
        # at most as many keys as were found
        met = sofar.join(F.broadcast(found.select(*KEY)), KEY, "left_semi")
        fresh = found.join(F.broadcast(met), KEY, "left_anti")
    return fresh.select(*KEY, "_f.path", "_f.type", "_f.p_place", "_f.ord")


def checklist(closure: DataFrame, lang: str = v.DEFAULT_LANG) -> DataFrame:
    """One row per listed module, with its group, label, shown path and mark."""
    profile = PROFILES[lang]
    labels = F.create_map(*[F.lit(x) for pair in profile.type_labels.items() for x in pair])
    order = F.array(*[F.lit(t) for t in profile.type_order])
    return closure.where(F.col("type").isin(profile.type_order)).select(
        "project", "entry",
        F.array_position(order, F.col("type")).cast("int").alias("type_ord"),
        F.element_at(labels, F.col("type")).alias("label"),
        "seq",
        F.coalesce("path", profile.expected_path(F.col("module_id"))).alias("shown"),
        F.when(F.col("found"), "found").otherwise("not found").alias("status"),
    )


def checklist_summary(closure: DataFrame) -> DataFrame:
    return closure.groupBy("project", "entry", "type").agg(
        F.count(F.lit(1)).alias("n_modules"), F.count_if(~F.col("found")).alias("n_missing")
    )
