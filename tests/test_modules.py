import pytest
from pyspark.sql import functions as F

from corpusveil.functions import modules as M
from corpusveil.functions import paths as P


@pytest.mark.parametrize("path,lang", [
    ("a/B.java", "spring"), ("a/b.TSX", "react"), ("x.js", "react"), ("x.py", "spring"), ("", "spring"), (".ts", "spring"),
])
def test_infer_lang(one, path, lang):
    assert one(M.infer_lang, path) == lang


@pytest.mark.parametrize("flag,stored,lang", [
    ("react", "spring", "react"), (None, "react", "react"), ("", "react", "react"), (None, None, "spring"), ("cobol", "react", "spring"),
])
def test_resolve_lang(one, flag, stored, lang):
    assert one(M.resolve_lang, flag, stored) == lang


@pytest.mark.parametrize("text,path,expected", [
    ("package a.b;\npublic class Foo {}", "x/Y.java", "a.b.Foo"),
    ("// the class of things\npackage a;\nclass Foo", "x/Y.java", "a.of"),
    ("package a;\n", "x/Y.java", "a.Y"),
    ("enum Größe {}", "x/Y.java", "Größe"),
    ("", "x/Y.java", "Y"),
])
def test_module_id_java(one, text, path, expected):
    assert one(M.module_id_java, text, path) == expected


@pytest.mark.parametrize("path,root,expected", [
    ("src/a/b.tsx", "src", "a/b.tsx"), ("src/a/../b.tsx", "src", "b.tsx"), ("lib/b.tsx", "src", "b.tsx"),
    ("a/b.ts", "", "a/b.ts"), ("../b.ts", "", "b.ts"),
])
def test_module_id_react(one, path, root, expected):
    assert one(M.module_id_react, path, root) == expected


@pytest.mark.parametrize("module_id,kind", [
    ("com.report.X", "repository"), ("a.UserDao", "repository"), ("a.OrderService", "service"), ("a.RestThing", "controller"),
    ("a.EnumType", "enum"), ("a.ConfigX", "util"), ("a.Order", "model"), ("a.ResourceService", "service"),
])
def test_classify_java(one, module_id, kind):
    assert one(M.classify_java, module_id) == kind


@pytest.mark.parametrize("module_id,text,kind", [
    ("a/useOrder.ts", "", "hook"), ("a/user.ts", "", "module"), ("hooks/x.ts", "", "hook"), ("a/OrderContext.tsx", "", "context"),
    ("a/x.d.ts", "", "types"), ("models/x.ts", "", "types"), ("services/x.ts", "", "api"), ("lib/x.tsx", "", "util"),
    ("a/x.jsx", "", "component"), ("a/x.js", "<Foo />", "component"), ("a/x.js", "axios.get()", "api"),
    ("a/x.js", "prefetch(", "module"), ("components/x.js", "", "component"),
])
def test_classify_react(one, module_id, text, kind):
    assert one(M.classify_react, module_id, text) == kind


def test_paths(one):
    assert one(P.normalize, "a/./b/../../c//d") == "c/d"
    assert one(P.normalize, "../a/../../b") == "../../b"
    assert one(P.parent, "a/b/c") == "a/b" and one(P.parent, "c") == ""
    assert one(P.stem, "a/index.d.ts") == "index.d" and one(P.suffix, "a/.env") == ""
