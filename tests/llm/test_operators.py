"""Operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables,
extra columns; results against plain Python."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusveil.llm import bpe, chat, fingerprints, jaccard, langid, lines, packing, pii, queries, topk, warc
from corpusveil.llm.frames import components
from corpusveil.llm.text_hash import BLOCK, span_hashes

DOCS = "doc_id bigint, text string, lang string, label bigint, sequence_id string, slice int"


def docs(spark, rows):
    """Documents with extra columns whose names clash with those the operators make."""
    return spark.createDataFrame([(i, t, "en", 1, "x", 7) for i, t in rows], DOCS)


def words(n, seed, pool=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def near(base, edits, seed):
    rng, out = random.Random(seed), list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"n{rng.randrange(10**6)}"
    return " ".join(out)


# ---- Jaccard join


def brute_components(rows, size, percent):
    sets = []
    for _, text in rows:
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)} if len(ws) >= size else {tuple(ws)} if ws else set())
    at = list(range(len(rows)))

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) > 0:
                at[max(root(i), root(j))] = min(root(i), root(j))
    comp = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            comp[root(i)] = min(comp.get(root(i), d), d)
    return sorted(((d, len(sets[i]), None if d is None else comp[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_jaccard_components(spark, size, percent):
    base, rng = words(150, 1), random.Random(5)
    rows = [(i, near(base, rng.randrange(8), i)) for i in range(60)]  # a chain-like group of near copies
    rows += [(100 + i, " ".join(words(rng.randrange(1, 60), 1000 + i))) for i in range(40)]
    rows += [(200 + i, near(words(40, 77, 10**6), i % 2, i)) for i in range(8)]
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "One"), (304, "oNE\tTWO"), (305, "one  two"), (306, "one"), (306, "one")]
    rows += [(400, " ".join(words(5000, 9))), (401, " ".join(words(5000, 9)) + " end"), (None, "one two"), (None, None)]
    got = jaccard.jaccard_components(docs(spark, rows), size=size, percent=percent).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(rows, size, percent)


def test_jaccard_of_an_empty_table(spark):
    assert jaccard.jaccard_components(docs(spark, [])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (200, 100), (7, 7), (100, 101)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 200: 100}


def test_long_words_are_hashed_whole():
    data = np.frombuffer(b"a" * (2 * BLOCK) + b" " + b"a" * (2 * BLOCK - 1) + b"b" + b" xy xy", np.uint8)
    n = 2 * BLOCK
    h = span_hashes(data, np.array([0, n + 1, 2 * n + 2, 2 * n + 5]), np.array([n, 2 * n + 1, 2 * n + 4, 2 * n + 7]))
    assert h[0] != h[1] and h[2] == h[3]


def thue_morse(first, second, bits):
    return "".join((first, second)[i.bit_count() % 2] for i in range(1 << bits))


def test_words_of_equal_sums_do_not_collide():
    """Words that agree under every polynomial modulo 2**64, and permutations of one word's bytes."""
    made = [thue_morse(a, b, bits) for a, b in ("ab", "ba") for bits in (10, 11, 12)] + ["ab" * 100, "ba" * 100, "a" * 64 + "b" * 64, "b" * 64 + "a" * 64, "a" * 128]
    data = " ".join(made).encode()
    ends = np.cumsum([len(w) + 1 for w in made]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    assert len(set(span_hashes(np.frombuffer(data, np.uint8), starts, ends).tolist())) == len(made)


def test_jaccard_of_words_that_only_share_a_polynomial(spark):
    rows = [(1, thue_morse("a", "b", 11)), (2, thue_morse("b", "a", 11))]
    assert sorted(tuple(r) for r in jaccard.jaccard_components(docs(spark, rows), size=3, percent=90).collect()) == [(1, 1, 1), (2, 1, 2)]


# ---- packing


def brute_bins(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = min((b for b in range(len(bins)) if bins[b] >= n), key=lambda b: bins[b], default=None)
        if fit is None:
            bins.append(capacity)
            fit = len(bins) - 1
        bins[fit] -= n
    return sorted(bins)


@pytest.mark.parametrize("seed", range(4))
def test_pack_is_best_fit_decreasing(spark, seed):
    rng, capacity = random.Random(seed), 50
    lengths = [rng.choice([1, 3, 17, 25, 26, 50, rng.randrange(1, 51)]) for _ in range(300)]
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(lengths)] + [(None, None, "x"), (5, 0, "x")], "doc_id bigint, n bigint, offset2 string")
    rows = packing.pack(df, "n", capacity, ["doc_id"]).collect()
    assert sum(r.sequence_id is None and r.offset is None for r in rows) == 2 and len(rows) == 302
    held = {}
    for r in rows:
        if r.sequence_id is not None:
            held.setdefault(r.sequence_id, []).append((r.offset, r.n))
    for parts in held.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in p) for p in held.values()) == brute_bins(lengths, capacity)


def test_pack_edges(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, n bigint"), "n", 9, ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([(1, 10)], "doc_id bigint, n bigint"), "n", 9, ["doc_id"])


TEXTS = ["", None, "Hello WORLD's it's 'tis ''s don't!'s 123 x²½ a_b", "Ünïcödé ſ ŉ İstanbul ΣΑΣ ＡＢ", "a" * 3000, "été œuvre ﬁ ́é 日本語 x y\x85z",
         "<|startoftext|> <|endoftext|></w> ` ~  ", "ÀÉ×÷ß ªº µ ¿qué? «non»", "the " * 5000]


def test_token_pieces(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    assert tk.encode("a <|endoftext|> b", add_special_tokens=False).ids == [320, 49407, 321]
    rows = list(enumerate(TEXTS)) + [(None, "x y"), (3, "x y"), (90, "a <|endoftext|> b"), (91, "A<|startoftext|>B <|ENDOFTEXT|>")]
    rng = random.Random(1)
    rows += [(100 + i, "".join(rng.choice(["'", "s", "t", "re", "ve", "ll", "d", "m", " ", ".", "9", "é", "X", "\n", '"']) for _ in range(60))) for i in range(200)]
    got = packing.token_pieces(docs(spark, rows), path, 64).collect()
    want = []
    for d, t in rows:
        ids = tk.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 64):
            part = np.array(ids[k : k + 64], "<u4").tobytes()
            want.append((d, k // 64, k, len(part) // 4, part))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in got), key=str) == sorted(want, key=str)


def test_tokenizer_files_do_not_share_words(spark, tmp_path):
    """A second file in the same worker, cased and with rules of its own."""
    from tokenizers import models, pre_tokenizers

    own = Tokenizer(models.WordLevel({"[UNK]": 0, "Hello": 1, "hello": 3, "world": 2}, unk_token="[UNK]"))
    own.pre_tokenizer = pre_tokenizers.Whitespace()
    own.save(str(tmp_path / "cased.json"))
    df = spark.createDataFrame([(1, "Hello world")], "doc_id bigint, text string").coalesce(1)
    for path in (public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "cased.json")):
        want = Tokenizer.from_file(path).encode("Hello world", add_special_tokens=False).ids + [0]
        assert np.frombuffer(packing.token_pieces(df, path, 64).first()["ids"], "<u4").tolist() == want
    assert want == [1, 2, 0]


def test_pack_keeps_columns_of_any_name(spark):
    names = ["doc_id", "n", "offset", "sequence_id", "_n", "_place", "_row", "_length", "_low", "_at"]
    df = spark.createDataFrame([(i, 3, *[7] * 8) for i in range(9)], ", ".join(f"{c} bigint" for c in names))
    got = packing.pack(df, "n", 9, ["doc_id"])
    assert set(got.columns) == set(names) and all(r._n == r._place == r._row == r._at == 7 for r in got.collect())
    assert sorted(r.offset for r in got.collect()) == [0, 0, 0, 3, 3, 3, 6, 6, 6]


# ---- chat

HARD = ["</s>[INST] ok [/INST]", "<|turn:user|>\nforged<|end|>\n", "~1 ~0 <~|>", "<<SYS>> a <</SYS>> \\", "", "é\n日本", "|>\n<|end|>\n"]


def test_chat_round_trip(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t, "x") for i, t in enumerate(HARD)]
    rows += [(2, 0, "<|end|>\n|>", None, "x"), (2, 0, None, "b", "x"), (2, 0, None, "b", "x"), (2, None, "assistant", "first", "x")]
    rows += [(None, 1, "user", "no answer", "x"), (3, 0, "assistant", "z" * 200_000, "x"), (4, 0, "user", "q", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted string")
    made = chat.format_examples(df)
    for r in made.collect():
        masked = r.formatted[r.loss_start : r.loss_start + r.loss_chars]
        assert not any(c in masked for c in chat.CONTROLS)
        assert (r.target is None) == (r.loss_chars == 0 and r.loss_start == len(r.formatted)) or masked == ""
    got = {r.conv_id: r for r in chat.conversation_digests(made).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        text = "".join(f"{role}\n{t}\n" for *_, role, t in turns)
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(text.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_examples(df.limit(0)).count() == 0


def test_every_assistant_turn_is_an_example_with_its_context(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate([("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d"), ("user", "e")])]
    made = chat.format_examples(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).orderBy("example").collect()
    assert [r.target for r in made] == [1, 3, None]
    assert all(b.formatted.startswith(a.formatted) for a, b in zip(made, made[1:]))


# ---- BPE


def test_bpe_round_trip(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = list(enumerate([*TEXTS, "  \n \t\n x  y\n\n", "<|endoftext|>", "\U0001f600 🏳️‍🌈", "''s 's'S ..'re"])) + [(None, "null id"), (2, "again"), (2, "again")]
    docs(spark, rows).write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    for chunk in (50, 10**6):
        ids = bpe.encode(stored, path, public_tokenizers.PATTERN, chunk_chars=chunk, buckets=7)
        got = sorted(((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in bpe.decode(ids, path).collect()), key=str)
        want = []
        for d, t in rows:
            own = enc.encode_ordinary(t or "")
            want.append((d, len(own), np.array(own, "<u4").tobytes(), (t or "").encode()))
        assert got == sorted(want, key=str)
    assert bpe.encode(stored.limit(0), path, public_tokenizers.PATTERN).count() == 0
    assert regex.findall(public_tokenizers.PATTERN, "a b") == ["a", " b"]


# ---- WARC


@pytest.mark.parametrize("version", [1, 2])
def test_arc_headers_and_lengths(version):
    http = b"HTTP/1.0 200 OK\r\nContent-Length: 9\r\nX-Record-Key: 12\r\n\r\n"
    content = warc.arc_version_block(version, "a.arc", "19970101")
    content += warc.arc_record(version, "http://a/b c", "1.2.3.4", "19970203040506", "text/html", http + b"a\nhttp://")
    content += warc.arc_record(version, "dns:a", "1.2.3.4", "1997", "text/dns", b"")
    (info, _), (page, body), (dns, none) = warc.parse_arc(content)
    assert info["URL"] == "filedesc://a.arc" and page["URL"] == "http://a/b c" and body == http + b"a\nhttp://" and none == b""
    assert warc.warc_date(page["Archive-date"]) == "1997-02-03T04:05:06Z" and warc.warc_date("1997") == "1997-01-01T00:00:00Z"
    assert dns["Content-type"] == "text/dns"
    with pytest.raises(ValueError):
        list(warc.parse_arc(content[:-3]))


def test_pages_through_archives(spark):
    html = ["same", "same", "", None, "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n", "x" * 300_000, "é日", "same", "", "last\r\n\r\n"]
    rows = [(i, None if i == 3 else f"http://h/{i} ü", h, "x") for i, h in enumerate(html)] + [(None, "http://n", "same", "x"), (None, None, "only", "x"), (7, "u", "same", "x")]
    read, path = warc.archive_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string, payload string"))
    top = {}
    for k, _, h, _ in rows:
        if k is not None:
            top[h or ""] = max(top.get(h or "", k), k)
    want = []
    for k, _, h, _ in rows:
        data = (h or "").encode()
        first = top.get(h or "")
        other = first is not None and first != k
        want.append((k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if other else "response", first if other else None))
    got = [tuple(r) for r in warc.page_types(read).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.archive_pages(spark.createDataFrame([], "page_id bigint, url string, html string"))[0].count() == 0


def test_convert_keeps_what_the_archive_says(spark):
    content = warc.arc_version_block(2, "b.arc", "19990101") + warc.arc_record(2, "http://a/", "1.1.1.1", "19990101000001", "text/html", b"HTTP/1.0 200 OK\r\n\r\nhi")
    made = warc.convert_arc(spark.createDataFrame([("b.arc", bytearray(content)), ("e", None)], "archive string, content binary")).collect()
    assert [(r.record_type, r.uri) for r in made] == [("warcinfo", "filedesc://b.arc"), ("response", "http://a/")]
    assert bytes(made[1].payload) == b"hi" and made[1].payload_digest == warc.digest(b"hi")


# ---- lines


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return a == b
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def brute_lines(rows, least):
    seen, first = [], {}
    for d, t in sorted({(d, t) for d, t in rows if t is not None}, key=lambda r: (r[0] is not None, r[0] or 0)):
        for k, line in enumerate(t.split("\n")):
            if line.strip(" \t\r\f\v") and line not in first:
                first[line] = (d, t, k)
                seen.append(line)
    gone = {b for i, b in enumerate(seen) if len(b) >= least for a in seen[:i] if len(a) >= least and one_edit(a, b)}
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, None, 0, 0))
            continue
        parts = t.split("\n")
        full = [x for x in parts if x.strip(" \t\r\f\v")]
        keep = [(x, bool(x.strip(" \t\r\f\v"))) for k, x in enumerate(parts) if not x.strip(" \t\r\f\v") or (first[x] == (d, t, k) and x not in gone)]
        n = sum(f for _, f in keep)
        out.append((d, "\n".join(x for x, _ in keep) if n else "", len(full), n))
    return sorted(out, key=str)


def test_line_dedup(spark):
    rng = random.Random(3)
    bases = ["".join(rng.choice("abcdé ") for _ in range(n)).strip() + "." for n in (20, 31, 32, 33, 40, 63, 64, 65, 66, 127, 128, 129, 130, 300)]
    rows, edited = [], []
    for base in bases:
        for _ in range(14):
            i, kind = rng.randrange(len(base) + 1), rng.randrange(3)
            edited.append(base[:i] + (rng.choice("xyé") if kind else "") + base[i + (kind != 1) :])
    pool = bases + edited
    for d in range(60):
        rows.append((d, "\n".join(rng.choice([*pool, "", "  \t", "short", "shart"]) for _ in range(rng.randrange(1, 9)))))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "Z" * 30_000), (104, "Z" * 29_999 + "Y"), (105, "unique line of this one document only"), (None, "of no id\nshort"), (105, "unique line of this one document only")]
    got = lines.dedup_lines(docs(spark, rows).withColumn("n_lines", F.lit("old")))
    assert got.columns == ["doc_id", "text", "lang", "label", "sequence_id", "slice", "n_lines", "n_kept"]
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_kept) for r in got.collect()), key=str) == brute_lines(rows, lines.NEAR_CHARS)
    assert lines.dedup_lines(docs(spark, [])).count() == 0


# ---- top k


def test_top_k(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(-60, 60)) for _ in range(40)]) for i in range(230)]
    rows += [(300 + i, list(rows[7][1])) for i in range(9)]  # ties
    rows += [(50, None), (None, rows[0][1]), (401, [1.0, None]), (402, [float("nan")]), (403, [float("inf")] * 40), (404, [5.0]), (405, []), (406, [2.0**40] * 40)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id bigint, vector array<double>, score string")
    got = sorted(tuple(r) for r in topk.top_k(df, "vec_id", "vector", lambda i: i % 50 == 0, 5).collect())
    good = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and abs(x) < float("inf") for x in v)]
    want = []
    for q, u in good:
        if q % 50 == 0:
            scored = sorted((-sum(int(a) * int(b) for a, b in zip(u, v)), i) for i, v in good if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert got == sorted(want)
    assert topk.top_k(df.limit(0), "vec_id", "vector", lambda i: i % 50 == 0, 5).count() == 0


# ---- language ID


def test_language_spans(spark):
    train = [(1, "the cat and the dog were here with this thing", "en"), (2, "die Katze und der Hund waren nicht hier auf dem Dach", "de"), (3, "это был большой дом и мы там жили", "ru"), (4, None, "en"), (5, "x", None)]
    model = langid.fit(spark.createDataFrame(train * 5, "doc_id bigint, text string, lang string"))
    assert model.languages == ("de", "en", "ru")
    mixed = "the dog and the cat were here with this. это большой дом там"
    rows = [(1, mixed), (2, None), (3, ""), (4, "123 !!"), (5, "der Hund und die Katze auf dem Dach"), (None, "дом"), (5, "𠀀" * 3), (6, "the cat and the dog " * 9000)]
    got = {(r.doc_id, (r.n or 0)): r for r in langid.label(docs(spark, rows), model).withColumn("n", F.lit(0)).collect() if r.doc_id != 5}
    first = got[(1, 0)]
    assert first.lang_pred == "en" and 0.5 < first.score < 1 and [s.lang for s in first.spans] == ["en", "ru"]
    assert mixed[first.spans[1].start : first.spans[1].end] == "это большой дом там"
    assert all((got[(k, 0)].lang_pred, got[(k, 0)].score) == ("und", 0.0) and not got[(k, 0)].spans for k in (2, 3, 4))
    assert got[(None, 0)].lang_pred == "ru" and got[(6, 0)].lang_pred == "en"
    none = langid.fit(docs(spark, []))
    assert [r.lang_pred for r in langid.label(docs(spark, [(1, "abc")]), none).collect()] == ["und"]
    kept = langid.accepted(docs(spark, rows), model, 0.5)
    assert kept.columns == docs(spark, []).columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 5, 5, 6]


def test_best_path_is_the_best(spark):
    rng = np.random.default_rng(1)
    doc = np.repeat([0, 1, 2], [6, 1, 4])
    scores = rng.normal(size=(11, 3)).astype(np.float32) * 4
    path = langid.best_paths(scores, doc, 3.0)

    def value(d, p):
        return sum(scores[w][x] for w, x in zip(np.flatnonzero(doc == d), p)) - 3.0 * sum(a != b for a, b in zip(p, p[1:]))

    import itertools

    for d in range(3):
        own = path[doc == d].tolist()
        assert value(d, own) == pytest.approx(max(value(d, p) for p in itertools.product(range(3), repeat=len(own))), abs=1e-3)


def test_held_out_accuracy(spark, sf_dir):
    truth = queries.table(spark, sf_dir, "documents").select("doc_id", "lang")
    made = queries.op8_language_id(spark, sf_dir).join(truth, "doc_id").where("held_out and lang is not null")
    assert made.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


# ---- fingerprints


def test_fingerprints_with_next(spark):
    rng = random.Random(2)
    rows = [(i * 3, "\n".join(" ".join(words(rng.randrange(30), i * 10 + k, 10**5)) for k in range(rng.randrange(1, 7)))) for i in range(40)]
    rows += [(1000, None), (1001, ""), (1002, "é日本" * 5000), (1003, rows[3][1]), (None, "null id")]
    got = {r.doc_id: r for r in fingerprints.compare_with_next(docs(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    assert len(got) == len(rows)
    for k, (d, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        (s0, s1, s2), lanes = fingerprints.fingerprints([t, edited, after])
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprints.to_text(s0, lanes[0]), fingerprints.to_text(s1, lanes[1]))
        assert r.near_next == pytest.approx(fingerprints.likeness(lanes[:1], lanes[2:])[0]) and 0 <= r.near_edited <= 1
    assert got[1003].fingerprint == got[9].fingerprint
    assert fingerprints.compare_with_next(docs(spark, [])).count() == 0
    one = fingerprints.compare_with_next(docs(spark, [(5, "abcd")])).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abca").hexdigest()
    assert fingerprints.compare_with_next(docs(spark, [(5, "a"), (5, "a"), (5, "b"), (None, None)])).count() == 4


def test_fingerprints_are_homomorphic():
    paragraphs = ["one two three four", "five", "", "six seven eight"]

    def of(ps):
        s, n = fingerprints.fingerprints(["\n".join(ps)])
        return fingerprints.to_text(s[0], n[0])

    assert of(paragraphs) == of(paragraphs[::-1]) != of(paragraphs[:3])
    assert fingerprints.insert(of(paragraphs[:3]), paragraphs[3]) == of(paragraphs) and fingerprints.delete(of(paragraphs), "five") == of(["one two three four", "", "six seven eight"])


# ---- PII

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(8)
    for _ in range(4000):
        text = "".join(rng.choice(["a", "@", ".", "-", "1", "25", "300", " ", "+", "(", "%", "x.y", "4111111111111111", "é", "a@b.c", "0"]) for _ in range(rng.randrange(25)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 150_000, "1." * 150_000, "+1" * 150_000, "1 " * 150_000, " " * 300_000, "one " * 75_000, "( " * 150_000):
        pii.all_spans(text)


def test_long_spelled_runs_are_linear():
    for text in ("one dot " * 40_000, "1 dot " * 50_000, "x at one dot com " * 20_000, "eight dot eight dot eight dot eight, " * 8_000, "plus " * 60_000, "one" + " " * 300_000):
        pii.all_spans(text)


@pytest.mark.parametrize("text,kind,found", [
    ("mail jane.doe (at) example (dot) com now", "email", "jane.doe (at) example (dot) com"),
    ("write jane at example dot co dot uk please", "email", "jane at example dot co dot uk"),
    ("at ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ !", "email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("see jаne@exаmple.com", "email", "jаne@exаmple.com"),
    ("see ja​ne@exam­ple.com.", "email", "ja​ne@exam­ple.com"),
    ("call plus four nine one two three four five six seven ok", "phone", "plus four nine one two three four five six seven"),
    ("ip one nine two dot one six eight dot zero dot one !", "ip", "one nine two dot one six eight dot zero dot one"),
    ("meet at noon, one two three, a dot on the map", None, None),
])
def test_disguises(text, kind, found):
    base, added = pii.all_spans(text)
    if kind is None:
        assert not base and not added
        return
    assert base == plain_spans(text)
    assert (kind, found) in [(pii.KINDS[k], text[a:b]) for k, a, b in added]


@pytest.mark.parametrize("text,kind,found,rest", [
    ("to jаne@example.com now", "email", "jаne@example.com", "to <EMAIL> now"),
    ("to ja\u200bne@example.com now", "email", "ja\u200bne@example.com", "to <EMAIL> now"),
    ("to ja\u00adne@example.com now", "email", "ja\u00adne@example.com", "to <EMAIL> now"),
    ("to jane (dot) doe@example.com now", "email", "jane (dot) doe@example.com", "to <EMAIL> now"),
    ("to jane@example.cоm now", "email", "jane@example.cоm", "to <EMAIL> now"),
    ("to jane@example.co (dot) uk now", "email", "jane@example.co (dot) uk", "to <EMAIL> now"),
    ("to +49 170 12345６７ now", "phone", "+49 170 12345６７", "to <PHONE> now"),
    ("to 10.0.0.1２ now", "ip", "10.0.0.1２", "to <IP> now"),
])
def test_disguises_beside_a_base_span(text, kind, found, rest):
    base, added = pii.all_spans(text)
    assert base == plain_spans(text) and len(base) == 1
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in added] == [(kind, found)]
    assert pii.masked(text, base + added) == rest


@pytest.mark.parametrize("text,kind,found", [
    ("dns eight dot eight dot eight dot eight ok", "ip", "eight dot eight dot eight dot eight"),
    ("host at eight dot eight dot eight dot eight, ok", "ip", "eight dot eight dot eight dot eight"),
    ("dns acht punkt acht punkt acht punkt acht ok", "ip", "acht punkt acht punkt acht punkt acht"),
    ("ip one two seven dot zero dot zero dot one ok", "ip", "one two seven dot zero dot zero dot one"),
    ("ip 192 dot 168 dot zero dot 1 ok", "ip", "192 dot 168 dot zero dot 1"),
    ("card 4111 1111 1111 one one one one ok", "card", "4111 1111 1111 one one one one"),
    ("call +49 170 five five five one two ok", "phone", "+49 170 five five five one two"),
    ("call +49 one 7012345 ok", "phone", "+49 one 7012345"),
    ("mail jane at one dot com ok", "email", "jane at one dot com"),
    ("mail jane (at) one (dot) com ok", "email", "jane (at) one (dot) com"),
])
def test_short_spelled_chains(text, kind, found):
    base, added = pii.all_spans(text)
    assert base == plain_spans(text)
    assert [(pii.KINDS[k], text[a:b]) for k, a, b in added] == [(kind, found)]


@pytest.mark.parametrize("text", [
    "three dot five, nine hundred dot one dot two", "eight dot eight dot eight dot eight eight eight", "one two three four five six seven",
    "4111 1111 1111 one one one two", "ask one two@example.com", "version 3 dot 5 point one",
])
def test_chains_that_form_nothing(text):
    assert pii.all_spans(text) == (plain_spans(text), [])


def test_base_spans_are_not_added_again():
    text = "jane@example.com, +49 170 1234567 and ｘ one (dot) two. " * 2
    assert len(pii.base_spans(text)) == 4 and pii.all_spans(text)[1] == []


def test_pii_table(spark):
    rows = [(1, "a@b.co +49 123 456 789, 4111 1111 1111 1111, 10.0.0.1"), (2, None), (3, ""), (None, "x@y.zz"), (1, "dup"), (4, "w " * 100_000 + "jane (at) x (dot) com")]
    got = sorted(((r.doc_id, r.spans) for r in pii.find(docs(spark, rows)).collect()), key=str)
    want = sorted(((d, pii.render([s for part in pii.all_spans(t or "") for s in part])) for d, t in rows), key=str)
    assert got == want and dict(got)[4] == "email:200000:200021"
    masked = pii.mask(docs(spark, rows))
    assert masked.columns == docs(spark, []).columns
    texts = [r.text for r in masked.collect()]
    assert Counter(t is None for t in texts)[True] == 1 and "<EMAIL> <PHONE>" in next(t for t in texts if t and "<EMAIL> <PHONE>" in t)
    assert pii.find(docs(spark, [])).count() == 0 and zlib.crc32(b"") == 0
