"""Whitening, prefix trie and toxicity on small tables, against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusveil.llm import queries, toxicity, trie, whitening
from tests.llm.test_operators import near, words

# ---- whitening

VECS = "vec_id bigint, embedding array<float>, n bigint, x string, block bigint, m int"


def vectors(spark, rows):
    """Embeddings with extra columns whose names clash with those the operator makes."""
    return spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], VECS)


def whitened(rows, k):
    """The query's contract in numpy."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(np.float32(c)) for c in v)]
    x = np.array([np.floor(np.array(v, np.float32).astype(float) * 256) for _, v in good]).astype(np.int64)
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    c = u - s / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes[:, ::-1][:, :k]
    return good, n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ axes / np.sqrt(values[:k]), values[:k] / values.sum()


def embedded(spark, rows, tmp_path):
    vectors(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    return queries.op11_whitening(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("block", [16 * 6, 1 << 17])
def test_whitening(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(whitening, "BLOCK", block)
    rng = np.random.default_rng(7)
    mix = rng.normal(size=(6, 6))
    rows = [(i, [float(a) for a in rng.normal(size=6) @ mix + 3]) for i in range(300)]
    rows += [(500 + i, rows[3][1]) for i in range(200)] + [(None, rows[4][1]), (5, rows[5][1]), (5, rows[6][1])]
    rows += [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5)]
    rows += [(904, [1.0]), (905, []), (906, [-0.0] * 6), (907, [0.0] * 6)]
    good, n, deviation, z, share = whitened([r for r in rows if r[1] is None or len(r[1]) == 6], 4)
    got = embedded(spark, rows, tmp_path)
    assert len(got) == 4 * len(good) and {r.n for r in got} == {n} and all(r.identity_error <= 1e-9 for r in got)
    by_row: dict = {}
    for r in got:
        by_row.setdefault((str(r.vec_id), r.deviation, r.deviation_exact == r.deviation), []).append((r.component, r.whitened, r.explained))
    want: dict = {}
    for (i, _), d, row in zip(good, deviation.tolist(), z.tolist()):
        want.setdefault((str(i), d, True), []).append(row)
    assert by_row.keys() == want.keys()
    signs = None
    for key, values in by_row.items():
        values = np.array([w for _, w, _ in sorted(values)]).reshape(4, -1)
        other = np.array(want[key]).T
        signs = np.sign(values[:, 0] * other[:, 0]) if signs is None else signs
        assert np.allclose(values, other * signs[:, None], rtol=1e-9, atol=1e-9)
    assert np.allclose([e for _, _, e in sorted(by_row[next(iter(by_row))])][:4], share, rtol=1e-9)


def test_whitening_edges(spark, tmp_path):
    assert embedded(spark, [(1, None), (2, [None])], tmp_path / "a") == []
    one = embedded(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])], tmp_path / "b")  # no variance: no direction
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one) == [
        (i, k, 1, 0, 0.0, 0.0, 0.0) for i in (1, 2) for k in (1, 2)
    ]
    line = embedded(spark, [(i, [float(i), float(i)]) for i in range(9)], tmp_path / "c")  # variance in one direction only
    assert {r.whitened for r in line if r.component == 2} == {0.0} and max(r.identity_error for r in line) < 1e-9
    huge = embedded(spark, [(1, [3e38, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 3.0])], tmp_path / "d")
    assert len(huge) == 6 and all(np.isfinite(r.whitened) for r in huge) and {r.deviation for r in huge if r.vec_id == 1} == {None}


def test_whitening_of_doubles(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(80, 3)) * [5, 1, 0.1]
    df = spark.createDataFrame([(str(i), [float(a) for a in v]) for i, v in enumerate(data)], "name string, v array<double>")
    model = whitening.fit(df, "v", 3)
    z = np.array([r.whitened for r in whitening.project(df, model, "name", "v").collect()])
    assert np.allclose(z.T @ z / 80, np.eye(3), atol=1e-9) and model.identity_error < 1e-9
    assert whitening.fit(df.limit(0), "v", 3) is None


# ---- trie

EMPTY = hashlib.sha256(b"").hexdigest()


def plain_trie(members):
    """{conv_id: [(role, text)]} -> rows as op12 returns them."""
    nodes: dict = {}
    for c, turns in members.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    ends: dict = {}
    for c, turns in members.items():
        ends.setdefault(tuple(turns), []).append(c)
    kids: dict = {}
    for path in nodes:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    sums = {}
    for path in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[path]) - 1) * len(path[-1][1].encode()) if path else 0
        below = [sums[k] for k in kids.get(path, [])]
        sums[path] = (sum(b[0] for b in below) or 1, own + sum(b[1] for b in below))
    return sorted(
        (str((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), *sums[p], hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())))
        for p, m in nodes.items()
    )


def rebuilt(rows):
    own: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(t)] for c, t in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        source = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = own.get(source, [])[:h] + turns[h:]
    return out


def conversations(rng):
    rows = []
    for c in [*range(-7, 60), 1000, 1001]:
        first = rng.choice(["hi", "hello", "é" * 5])
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, "assistant" if t % 2 else "user", first if t == 0 else rng.choice(["a", "bb", "ccc", None])))
    rows += [(2000, t, "user", "x") for t in range(60)] + [(2001, t, "user", "x" if t < 40 else "y") for t in range(50)]  # long chains
    rows += [(3000, 0, None, None), (3001, None, "user", "null turn"), (3001, 0, "user", "then"), (3002, 1, "b", "t"), (3002, 1, "a", "t"), (3002, 1, "a", "t"), (None, 0, "user", "of none")]
    rows += [(4000, 0, "z" * 100_000, "q" * 200_000)] + [(5000 + i, t, "user", "copy") for i in range(150) for t in range(3)]
    rng.shuffle(rows)
    return rows


def test_prefix_trie(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trie, "SEGMENT", 20)
    rows = conversations(random.Random(5))
    df = spark.createDataFrame([(*r, 9, "n") for r in rows], "conv_id bigint, turn bigint, role string, text string, node bigint, depth string")
    df.repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op12_prefix_trie(spark, str(tmp_path)).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert sorted(str(tuple(r)) for r in got.collect()) == plain_trie(rebuilt(rows))


def test_prefix_trie_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert queries.op12_prefix_trie(spark, str(tmp_path)).collect() == []


def test_turnless_members_end_in_the_root(spark):
    rows = spark.createDataFrame([(1, 0, bytearray(b"h"), 3)], "conv_id bigint, place bigint, hash binary, bytes bigint")
    sizes = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "conv_id bigint, n bigint")
    got = {r.depth: r for r in trie.prefix_trie(rows, sizes).collect()}
    assert got[0].n_convs == 3 and got[0].ends_sha256 == hashlib.sha256(b"2,3").hexdigest() and got[0].parent_conv_id is None
    assert got[1].parent_conv_id == 1 and got[1].ends_sha256 == hashlib.sha256(b"1").hexdigest()


@pytest.mark.parametrize("chain", [3, 1000])
def test_names_of_sequences(spark, chain):
    """Equal names exactly for equal sequences, however chains are cut."""
    rng = random.Random(chain)
    seqs = {s: [rng.choice("ab") for _ in range(rng.randrange(1, 12))] for s in range(60)}
    seqs[100], seqs[101] = ["a"] * 70, ["a"] * 69 + ["b"]
    rows = [(s, i, bytearray(hashlib.sha256(h.encode()).digest())) for s, hs in seqs.items() for i, h in enumerate(hs)]
    names, parents = {}, {}
    for r in trie.prefix_names(spark.createDataFrame(rows, "seq bigint, place bigint, hash binary"), chain).collect():
        path = tuple(seqs[r.seq][: r.place + 1])
        assert names.setdefault(path, bytes(r.node)) == bytes(r.node)
        parents[path] = bytes(r.parent)
    assert len(set(names.values())) == len(names)
    assert all(parents[p] == (names[p[:-1]] if len(p) > 1 else b"") for p in parents)


@pytest.mark.parametrize("seed", range(2))
def test_subtree_sums(spark, seed):
    rng = random.Random(seed)
    parent = {0: None, 1000: None}
    for i in range(1, 90):
        parent[i] = i - 1 if seed == 0 and i < 60 else rng.randrange(max(0, i - 3), i)
    for i in range(1001, 1100):
        parent[i] = 1000  # a star
    weight = {i: rng.randrange(10) for i in parent}
    depth = {}
    for i in sorted(parent):
        depth[i] = 0 if parent[i] is None else depth[parent[i]] + 1
    total = dict(weight)
    for i in sorted(parent, key=lambda i: -depth[i]):
        if parent[i] is not None:
            total[parent[i]] += total[i]
    df = spark.createDataFrame([(i, p, depth[i], weight[i] or None) for i, p in parent.items()], "node bigint, parent bigint, depth int, w int")
    assert {r.node: r.w for r in trie.subtree_sums(df, ["w"]).collect()} == total
    assert trie.subtree_sums(df.limit(0), ["w"]).collect() == []


# ---- toxicity


def distance(word, term, stem):
    """Edits between the word and the term, for a stem the fewest over all beginnings of the word."""
    row = list(range(len(term) + 1))
    best = row[-1]
    for c in word:
        new = [row[0] + 1]
        for j, d in enumerate(term):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = new
        best = min(best, row[-1])
    return best if stem else row[-1]


def test_automaton_is_the_edit_distance():
    rng = random.Random(2)
    terms = [("moron", False), ("oron", False), ("disgusting", False), ("lowei", True), ("abcabc", True), ("worthless", False), ("é日本語x", False), ("abc", True)]
    automaton = toxicity.Automaton.build(terms)
    pool = [t for t, _ in terms]
    tried = list(pool) + ["", "a", "zzzzzz", "disgustin", "isgustng", "xabcabc"]
    for _ in range(3000):
        w = list(rng.choice(pool))
        for _ in range(rng.randrange(4)):
            i, kind = rng.randrange(len(w) + 1), rng.randrange(3)
            w[i : i + (kind != 0)] = [rng.choice("abcnortéz日")] if kind != 1 else []
        tried.append("".join(w) + rng.choice(["", "", "sch", "ä"]))
    points = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in tried]
    end = np.cumsum([len(p) for p in points])
    term, edits = automaton.match(np.concatenate(points), end - [len(p) for p in points], end)
    for w, t, e in zip(tried, term.tolist(), edits.tolist()):
        fits = [(distance(w, x, s), i) for i, (x, s) in enumerate(terms) if distance(w, x, s) <= toxicity.allowed_edits(len(x), s)]
        assert (e if t >= 0 else None) == (min(fits)[0] if fits else None) and (t < 0 or (e, t) in fits), w


def test_words_and_quotation():
    made = toxicity.Words(["You id*ot!! (M0RON) 12 $$ a.b", "", "ÄÖ\U0001f600"])
    assert [made.word(i) for i in range(len(made.start))] == ["you", "id*ot", "m0ron", "12", "a", "b", "äö\U0001f600"]
    assert made.doc.tolist() == [0, 0, 0, 0, 0, 0, 2]
    text = 'he said "you fool" and «fool» left; fool'
    places = [i for i in range(len(text)) if text.startswith("fool", i)]
    assert [toxicity._quoted(text, i, i + 4) for i in places] == [True, True, False]


def toxic_corpus(seed):
    """Clean texts, abuse with two words and a family of words, misspelt abuse, and texts that only quote."""
    rng, rows, labels = random.Random(seed), [], []
    for i in range(1200):
        ws = words(rng.randrange(20, 60), seed * 10_000 + i)
        kind = rng.choice(["clean"] * 6 + ["abuse"] * 3 + ["family", "family", "quote"])
        for _ in range(3):
            at = rng.randrange(len(ws))
            if kind == "abuse":
                ws[at] = rng.choice(["Blockhead", "numbskull!", "blockhaed", "nvmbskull"])
            if kind == "family":
                ws[at] = "grobian" + rng.choice(["s", "isch", "erei", "en", "chen", "tum"])
            if kind == "quote":
                ws[at] = 'the slur "' + rng.choice(["blockhead", "numbskull"]) + '" was reported'
        rows.append((i, " ".join(ws)))
        labels.append((i, int(kind in ("abuse", "family"))))
    return rows, labels


def test_toxicity_on_held_out_texts(spark):
    rows, labels = toxic_corpus(1)
    kind = dict(labels)
    df = spark.createDataFrame([(i, t, "s", 1, "h") for i, t in rows], "doc_id bigint, text string, source string, toxic int, hits string")
    marks = spark.createDataFrame([(i, t, 5) for i, t in labels] + [(3, None, 1), (None, 1, 1)], "doc_id bigint, toxic int, text int")
    model = toxicity.fit(toxicity.labelled(df.where("doc_id % 4 <> 2"), marks))
    terms = dict(model.automaton.terms)
    assert {"blockhead", "numbskull"} <= set(terms) and any(stem and t.startswith("grob") for t, stem in terms.items())
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    held = [i for i, _ in rows if i % 4 == 2]
    right = sum((got[i].score >= 0.3) == bool(kind[i]) for i in held)
    assert right >= 0.97 * len(held)
    new = [(1, "you blokchead"), (2, "a blockheads here"), (3, 'the slur "blockhead" was reported'), (4, None), (5, ""), (5, "..."), (None, "blockhead"), (6, "w1 " * 50_000 + "numbskull")]
    out = {(r.doc_id, r.score): r for r in toxicity.score(spark.createDataFrame(new, "doc_id bigint, text string"), model).collect()}
    by_id: dict = {}
    for (i, s), r in out.items():
        by_id.setdefault(i, []).append(r)
    assert by_id[2][0].hits[0].edits == 1 and by_id[2][0].score >= 0.3 and by_id[None][0].score >= 0.3 and by_id[6][0].score >= 0.3
    assert by_id[3][0].hits[0].quoted and by_id[3][0].score < 0.3
    assert all(r.score < 0.3 and r.hits == [] for i in (4, 5) for r in by_id[i])
    hit = by_id[6][0].hits[0]
    assert new[-1][1][hit.start : hit.end] == "numbskull"


def test_copies_teach_once(spark):
    """A toxic text copied a thousand times, exactly or nearly, makes no term of its ordinary words."""
    rows, labels = toxic_corpus(2)
    base = words(60, 99, 10**6) + ["blockhead"]
    for k in range(400):
        rows.append((5000 + k, " ".join(base) if k % 2 else near(base, 2, k)))
        labels.append((5000 + k, 1))
    df, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.fit(toxicity.labelled(df, marks))
    assert not {t for t, _ in model.automaton.terms} & {w.lower() for w in base[:-1]}


def test_toxicity_without_anything_to_learn(spark):
    df = spark.createDataFrame([(1, "some text"), (2, None), (None, "x")], "doc_id bigint, text string")
    for labels in ([], [(1, 0)], [(1, 1)], [(9, 1)]):
        model = toxicity.fit(toxicity.labelled(df, spark.createDataFrame(labels, "doc_id bigint, toxic int")))
        got = toxicity.score(df, model).collect()
        assert len(got) == 3 and len({r.score for r in got}) == 1 and 0 <= got[0].score <= 1 and model.automaton.terms == ()
        assert toxicity.score(df.limit(0), model).count() == 0
