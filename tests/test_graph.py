import pytest
from pyspark.sql import functions as F

from corpusveil.operators import audit as A
from corpusveil.operators import bundles as B
from corpusveil.operators import graph as G
from corpusveil.operators import literals as L
from corpusveil.operators import reverse as V
from corpusveil.operators import rules as R
from corpusveil.operators import sanitize as S
from corpusveil.plans import extract as X
from corpusveil.plans import restore as Z
from tests.fixtures import (
    JAVA_ENTRY, JAVA_FILES, JAVA_MAPPING, JAVA_REACHED, REACT_ENTRY, REACT_FILES, REACT_MAPPING, REACT_REACHED, files_df, mappings_df,
)

CASES = {
    "spring": (JAVA_FILES, JAVA_MAPPING, JAVA_ENTRY, "org.polaris"),
    "react": (REACT_FILES, REACT_MAPPING, REACT_ENTRY, "@"),
}


def entry_df(spark, *entries):
    return spark.createDataFrame([("p", e) for e in entries], "project string, entry string")


def ordered(closure):
    return [r.module_id for r in closure.orderBy("seq").collect()]


def test_java_closure(spark):
    files = files_df(spark, JAVA_FILES, "spring")
    assert ordered(X.trace(files, entry_df(spark, JAVA_ENTRY), "spring", "org.polaris")) == JAVA_REACHED


def test_react_closure(spark):
    closure = X.trace(files_df(spark, REACT_FILES, "react"), entry_df(spark, REACT_ENTRY), "react", "@")
    assert ordered(closure) == REACT_REACHED
    assert [r.module_id for r in closure.where("not found").collect()] == ["screens/orchard/weather"]
    listed = G.checklist(closure, "react").collect()
    assert [(r.label, r.status) for r in listed if r.shown == REACT_ENTRY] == [("Components", "found")]
    assert sum(r.n_missing for r in G.checklist_summary(closure).collect()) == 1


#: Class -> the classes it imports. Q is no file; C and A import each other; D imports itself.
IMPORTS = {"A": "B C Q", "B": "D", "C": "A D E", "D": "D F", "E": "", "F": "B", "G": "Q E"}
#: Entry -> all it reaches: nearer before farther, then in the order in which the nearer ones came.
REACHED = {"A": "A B C Q D E F", "B": "B D F", "F": "F B D", "G": "G Q E", "E": "E"}


def test_closure_order(spark):
    files = {
        f"org/g/{c}.java": "package org.g;\n" + "".join(f"import org.g.{t};\n" for t in targets.split()) + f"class {c} {{}}\n"
        for c, targets in IMPORTS.items()
    }
    df = files_df(spark, files, "spring")
    closure = X.trace(df, entry_df(spark, *[f"org/g/{c}.java" for c in REACHED]), "spring", "org.g").collect()
    got = {c: [r for r in sorted(closure, key=lambda r: r.seq) if r.entry == f"org/g/{c}.java"] for c in REACHED}
    assert {r.module_id for r in closure if not r.found} == {"org.g.Q"}
    for c, names in REACHED.items():
        assert set(r.module_id[-1] for r in got[c]) == set(names.split())
    for c in ("B", "E", "F"):
        assert " ".join(r.module_id[-1] for r in got[c]) == REACHED[c]


def graph(spark, links, entries):
    """Edges, modules and entries of one project; a link to a number without links of its own is missing."""
    edges = [("p", f"{a}.java", i, f"{b}", f"m.{b}", f"{b}.java" if b in links else None) for a, to in links.items() for i, b in enumerate(to)]
    modules = [("p", f"m.{a}", f"{a}.java", "class", "spring") for a in links]
    return (
        entry_df(spark, *[f"{e}.java" for e in entries]),
        spark.createDataFrame(edges, "project string, src_path string, ord int, spec string, dep_id string, dep_path string"),
        spark.createDataFrame(modules, "project string, module_id string, path string, type string, lang string"),
    )


def plain_closure(links, entry):
    """Modules in the order of a queue, a missing one right after the module that first names it."""
    depth, queue, out = {entry: 0}, [entry], []
    while queue:
        at = queue.pop(0)
        out.append((at, depth[at]))
        for to in links[at]:
            if to not in depth:
                depth[to] = depth[at] + 1
                if to in links:
                    queue.append(to)
                else:
                    out.append((to, depth[to]))
    return [(entry, f"m.{m}", d, i) for i, (m, d) in enumerate(out)]


@pytest.mark.parametrize("hot", [False, True])
def test_bucketed_closure_is_the_plain_one(spark, monkeypatch, hot):
    """A chain deeper than PLACE_ROUNDS with ways back, a hub that all name, ties between parents, missing ones."""
    links = {i: [99, (i * 7) % 45, i + 1] if i % 3 else [i + 1, 99, 500 + i % 4] for i in range(44)}
    links |= {44: [0], 99: [98, 500], 98: []}
    entries = [0, 5, 30, 99]
    if hot:
        # every key that holds more than a thousandth of so few rows is spread
        monkeypatch.setattr("corpusveil.plans.joins.SMALL_ROWS", 1)
    tables = graph(spark, links, entries)
    got = G.trace_closure(*tables, bucketed=True).collect()
    want = sorted(row for e in entries for row in plain_closure(links, e))
    assert sorted((int(r.entry[:-5]), r.module_id, r.depth, r.seq) for r in got) == want
    assert sorted(map(tuple, G.trace_closure(*tables, bucketed=False).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("corpusveil_")]


def test_bucketed_closure_of_nothing(spark):
    entries, edges, modules = graph(spark, {1: [2], 2: []}, [1])
    assert G.trace_closure(entries.limit(0), edges, modules, bucketed=True).count() == 0
    assert [r.found for r in G.trace_closure(entries, edges.limit(0), modules, bucketed=True).collect()] == [True]
    assert G.trace_closure(entries, edges, modules.limit(0), bucketed=True).count() == 0


def test_merkle_audit_names_place_and_line(spark):
    row = "project string, path string, text string"
    same = [("p", f"a/{i}.java", f"class {i} {{}}") for i in range(30)] + [(None, None, "kept"), ("q", "x", "twice"), ("q", "x", "twice")]
    was = same + [
        ("p", "b/1", "one\ntwo\nthree"), ("p", "b/2", "short"), ("p", "top", "lost"), ("r", None, "a"), (None, "n", " trimmed \n"),
        ("q", "y", "again"), ("q", "y", "again"), ("s", "swap1", "u"), ("s", "swap2", "w"), ("t", "nothing", None), ("t", "empty", ""),
    ]
    now = same + [
        ("p", "b/1", "one\n2\nthree"), ("p", "b/2", "short\nlonger"), ("p", "new", "found"), ("r", None, "b"), (None, "n", "trimmed"),
        ("q", "y", "again"), ("s", "swap1", "w"), ("s", "swap2", "u"), ("t", "empty", "x"), ("t", "other", None),
    ]
    got = A.merkle_audit(spark.createDataFrame(was, row).withColumn("n", F.lit(1)), spark.createDataFrame(now, row)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([
        ("p", "b/1", "differs", 2), ("p", "b/2", "differs", 2), ("p", "top", "missing", None), ("p", "new", "unexpected", None),
        ("r", None, "differs", 1), ("q", "y", "missing", None), ("s", "swap1", "differs", 1), ("s", "swap2", "differs", 1),
        ("t", "empty", "differs", 1),
    ], key=str)
    nothing = spark.createDataFrame([], row)
    assert A.merkle_audit(nothing, nothing).collect() == []


def test_java_imports_rules(spark):
    text = (
        "import com.m.A;\nimport static com.m.B;\nimport com.m.*;\nimport com.m.B.field;\nimport com.m2.C;\n"
        " import com.m.D;\nimport com.m.A;\nimport com.mX;\n"
    )
    got = G.java_imports(files_df(spark, {"x.java": text}, "spring"), "com.m").orderBy("ord").collect()
    assert [r.spec for r in got] == ["com.m.A", "com.m.B", "com.m.A"]


def test_react_imports_rules(spark):
    text = (
        "import {\n  a,\n  b,\n} from '@/f/api';\nexport {\n  X,\n} from './list';\nimport './side';\n"
        "const no = 'plain';\nconst y = require( \"z\" ); import('./dyn')\nimport type T from './list';\n"
    )
    got = G.react_imports(files_df(spark, {"x.ts": text}, "react")).orderBy("ord").collect()
    assert [r.spec for r in got] == ["@/f/api", "./side", "./list", "z", "./dyn"]


def test_react_resolution(spark):
    files = {
        "a/x.ts": "", "b/i.tsx": "", "b/i.js": "", "c/index.jsx": "", "d.ts": "", "e/y.tsx": "", "index.ts": "",
    }
    main = "".join(f"import '{s}';\n" for s in [
        "./x", "../b/i", "@/c", "../d.js", "./y.css", "react", "@x/ui", "../../out", "../e/y.jsx", "@", "./none", "@/none", "./x.ts",
    ])
    df = files_df(spark, {**files, "a/main.ts": main}, "react")
    got = {r.spec: (r.dep_id, r.dep_path) for r in X.edges_of(df, "react", "@").collect()}
    assert got == {
        "./x": ("a/x.ts", "a/x.ts"), "../b/i": ("b/i.tsx", "b/i.tsx"), "@/c": ("c/index.jsx", "c/index.jsx"),
        "../d.js": ("d.ts", "d.ts"), "../../out": ("../../out", None), "../e/y.jsx": ("e/y.tsx", "e/y.tsx"),
        "@": ("index.ts", "index.ts"), "./none": ("a/none", None), "@/none": ("@/none", None), "./x.ts": ("a/x.ts", "a/x.ts"),
    }


def test_java_resolution_falls_back_to_file_name(spark):
    files = {"z/Foo.java": "", "a/Foo.java": "", "m/M.java": "import com.m.Foo;\nimport com.m.Nope;\n"}
    df = files_df(spark, files, "spring")
    edges = X.edges_of(df, "spring", "com.m")
    assert {(r.dep_id, r.dep_path) for r in edges.collect()} == {("com.m.Foo", "a/Foo.java"), ("com.m.Nope", None)}
    missing = G.missing_modules(edges, G.module_table(df))
    assert [r.module_id for r in missing.collect()] == ["com.m.Nope"]


@pytest.mark.parametrize("lang", ["spring", "react"])
def test_full_round_trip(spark, tmp_path, lang):
    sources, pairs, entry, scope = CASES[lang]
    maps = mappings_df(spark, pairs)
    files = files_df(spark, sources, lang)
    options = S.Options(strip_comments=False, strip_doc_tags=False, strip_loggers=False, mask_strings=True)
    done = X.extract(files, entry_df(spark, entry), lang, scope, maps, options)
    files = files.where(~F.col("path").contains("/lab/"))
    clean = done.clean.drop("source_path").cache()
    assert A.leak_audit(clean, ["path"], "text", R.content_rules(maps)).collect() == []
    assert A.leak_audit(clean.withColumn("p", F.col("path")), ["path"], "p", R.path_rules(maps, lang)).collect() == []
    ledger, out = str(tmp_path / "ledger"), str(tmp_path / "out")

    def broken(files):
        raise OSError("no space")

    with pytest.raises(OSError):
        Z.restore(clean, "d1", maps, done.dictionary, lang, ledger, sink=broken, first_run=True)
    back = Z.restore(
        clean, "d1", maps, done.dictionary, lang, ledger, str(tmp_path / "copy"), sink=lambda f: f.write.parquet(out), first_run=True
    )
    assert spark.read.parquet(out).count() == files.count()
    assert not back.refused and back.leftovers.collect() == []
    assert A.round_trip_audit(files, back.files, ["project", "path"], "text").collect() == []
    total = back.summary.first()
    assert total.strings_restored > 0 and total.n_collisions == 0
    assert spark.read.parquet(back.snapshot_path).count() == files.count()
    sink = lambda f: f.write.mode("overwrite").parquet(out)
    assert Z.restore(clean, "d1", maps, done.dictionary, lang, ledger, sink=sink).refused
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        Z.restore(clean, "d1", maps, done.dictionary, lang, str(tmp_path / "elsewhere"), sink=sink)
    with pytest.raises(ValueError):
        Z.restore(clean, "d1", maps, done.dictionary, lang, ledger)
    again = Z.restore(back.files, "d1", maps, done.dictionary, lang, ledger, force=True, sink=sink)
    assert again.summary.first().n_changed == 0


def cleaned(spark, lang):
    sources, pairs, entry, scope = CASES[lang]
    done = X.extract(files_df(spark, sources, lang), entry_df(spark, entry), lang, scope, mappings_df(spark, pairs), S.STRIP_ALL)
    return done, {r.path: r.text for r in done.clean.collect()}


def test_stripped_java(spark):
    done, clean = cleaned(spark, "spring")
    assert set(clean) == {"net/sample/dome/GatePlanner.java", "net/sample/dome/GateMotor.java", "net/sample/sky/Window.java", "net/sample/sky/Arc.java"}
    # literals are recorded before loggers go
    assert {r.literal for r in done.dictionary.collect()} == {'"bus.net.sample.gates"', '"asked at {}"', '"slow gate"'}
    text = clean["net/sample/dome/GatePlanner.java"]
    assert not any(gone in text for gone in ("//", "/*", "@since", "log.", "Shutter", "bus."))
    assert "import org.polaris2.Meteo;" in text and "GateMotor gateMotor;" in text


def test_stripped_react(spark):
    done, clean = cleaned(spark, "react")
    assert set(clean) == {
        "screens/area1/PlotBoard.tsx", "screens/area1/usePlot.ts", "screens/area1/Row.jsx", "lib/clock.ts", "store/index.ts", "store/plotSlice.ts",
    }
    text = clean["screens/area1/PlotBoard.tsx"]
    assert not any(gone in text for gone in ("console", "rchard", "river", "no trees", "rows", "all of them"))
    assert "from './usePlot'" in text and "`${plots.length} at ${now()}`" in text and "from '@/lib/clock'" in text
    plan = B.extraction_plan(done.closure, files_df(spark, REACT_FILES, "react"), mappings_df(spark, REACT_MAPPING), "react")
    rows = {r.module_id: r for r in plan.collect()}
    assert rows["screens/orchard/weather"].action == "skip"
    hook = rows["screens/orchard/useOrchard.ts"]
    assert (hook.target, hook.substitutions) == ("screens/area1/usePlot.ts", 3)


def text_of(parts):
    return "".join(r.text for r in parts.orderBy("part").collect())


@pytest.mark.parametrize("size", [2, 5000])
def test_bundles(spark, size):
    sources, pairs, entry, scope = CASES["spring"]
    closure = X.trace(files_df(spark, sources, "spring"), entry_df(spark, entry), "spring", scope)
    text = text_of(B.bundles(closure, mappings_df(spark, pairs), "spring", names_per_part=size))
    assert "Mock all dependencies: GatePlanner, Window, GateMotor, Arc\n- Do not" in text
    sources, pairs, entry, scope = CASES["react"]
    closure = X.trace(files_df(spark, sources, "react"), entry_df(spark, entry), "react", scope)
    text = text_of(B.bundles(closure, mappings_df(spark, pairs), "react", "vitest", names_per_part=size))
    mocked = text.split("vi.mock: ", 1)[1].split("\n", 1)[0]
    assert "using Vitest and" in text and "weather" in mocked and "usePlot" in mocked and "Orchard" not in text
    lonely = closure.where("type = 'component'")
    assert "[see modules below]" in text_of(B.bundles(lonely, mappings_df(spark, pairs), "react", names_per_part=size))


def test_a_file_that_was_written_elsewhere_comes_back(spark, tmp_path):
    text = "package net.sample.dome;\nclass GateMotorIT {\n  Gate gate;\n  String[] all = {`STR_2`, \"STR_2\", \"STR_7\"};\n}\n"
    files = files_df(spark, {"gates/GateMotorIT.java": text, "README.txt": "none"}, "spring")
    known = L.with_index(spark.createDataFrame([("STR_2", '"slow gate"')], "token string, literal string"))
    maps, ledger, out = mappings_df(spark, JAVA_MAPPING), str(tmp_path / "ledger"), str(tmp_path / "out")
    dry = Z.restore(files, "x", maps, known, "spring", ledger, str(tmp_path / "copy"), dry_run=True)
    assert dry.snapshot_path is None and list(tmp_path.iterdir()) == []
    assert dry.summary.first().n_changed == 1
    back = Z.restore(files, "x", maps, known, "spring", ledger, sink=lambda f: f.write.parquet(out), first_run=True)
    assert {r.path: r.text for r in spark.read.parquet(out).collect()} == {
        "README.txt": "none",
        "shutters/ShutterMotorIT.java": (
            "package org.polaris.dome;\nclass ShutterMotorIT {\n  Shutter shutter;\n"
            '  String[] all = {"slow shutter", "slow shutter", "STR_7"};\n}\n'
        ),
    }
    assert [(r.path, r.tokens) for r in back.leftovers.select("path", "tokens").collect()] == [("gates/GateMotorIT.java", "STR_7")]
    assert back.summary.first().strings_restored == 2
    assert spark.read.parquet(ledger).count() == 1


def test_collisions(spark):
    files = files_df(spark, {p: "" for p in ["Gate.java", "Shutter.java", "a/GateX.java", "a/gate.java", "a/b/Gate.java"]}, "spring")
    both = mappings_df(spark, [("variable", 0, "Shutter", "Gate"), ("variable", 1, "Shutter", "Door")])
    plan = {r.path: (r.target, r.collision) for r in V.rename_plan(files, both, "spring").collect()}
    assert plan["Gate.java"] == ("Shutter.java", True)
    assert plan["a/GateX.java"] == ("a/ShutterX.java", False)
    assert plan["a/b/Gate.java"] == ("a/b/Shutter.java", False)
    files = files_df(spark, {p: "" for p in ["GateX.java", "DoorX.java"]}, "spring")
    plan = {r.path: r.collision for r in V.rename_plan(files, both, "spring").collect()}
    assert plan == {"DoorX.java": False, "GateX.java": True}


@pytest.mark.parametrize("step", ["stage", "sink", "ledger", "close"])
def test_a_reversal_that_breaks_off_ends_in_the_same_state(spark, tmp_path, monkeypatch, step):
    """Left and right trade names, so a second reversal of the same files would undo the first. The
    job is stopped at one step and run again on what then stands in the place of the files."""
    maps = mappings_df(spark, [("variable", 0, "Left", "Right"), ("variable", 1, "Right", "Left")])
    files = files_df(spark, {"a/LeftArm.java": "class LeftArm { Right r; }", "b/Other.java": "none"}, "spring")
    ledger, place = str(tmp_path / "ledger"), str(tmp_path / "files")
    files.write.parquet(place)

    def run(sink):
        now = spark.read.parquet(place).select(*files.columns)
        return Z.restore(now, "x", maps, None, "spring", ledger, sink=sink, first_run=True)

    def write(df):
        df.select(*files.columns).write.mode("overwrite").parquet(place)

    def stop(*_):
        raise OSError("stopped")

    def write_and_stop(df):
        write(df)
        stop()

    log = Z.log_stage
    with monkeypatch.context() as m:
        if step == "ledger":
            m.setattr(Z.V, "append_ledger", stop)
        elif step != "sink":
            m.setattr(Z, "log_stage", lambda *a: stop() if a[-1] == {"stage": "staged", "close": "closed"}[step] else log(*a))
        with pytest.raises(OSError, match="stopped"):
            run(write_and_stop if step == "sink" else write)
    again = run(write)
    assert again.refused == (step == "close")
    assert {r.path: r.text for r in spark.read.parquet(place).collect()} == {
        "a/RightArm.java": "class RightArm { Left r; }", "b/Other.java": "none"}
    assert spark.read.parquet(ledger).count() == 1 and run(write).refused
