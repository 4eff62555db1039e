"""Best-fit decreasing packing of token sequences of any number.

Lengths are at most the capacity, so a histogram by length holds all that best-fit
decreasing needs to know. The plan is made for runs of equal lengths on it; a segment tree
over remaining capacities finds the tightest open bins in logarithmic time. Rows then
find their place by their position in the order by length, so no task sees all of them.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusveil.llm.bpe import gather
from corpusveil.llm.text_hash import parts
from corpusveil.session import materialize, number_rows

#: Distinct words whose ids a worker remembers; beyond it starts anew.
REMEMBER = 200_000


class OpenBins:
    """Open bins by remaining capacity: runs of bin numbers, and a segment tree of their counts."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def add(self, left: int, first: int, count: int) -> None:
        if left and count:
            self.runs[left].append((first, count))
            self._change(left, count)

    def take(self, left: int, count: int) -> tuple[int, int]:
        """Up to `count` bins with this remaining capacity: first bin and how many."""
        first, there = self.runs[left].pop()
        used = min(count, there)
        if used < there:
            self.runs[left].append((first + used, there - used))
        self._change(left, -used)
        return first, used

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of an open bin that holds `length`."""
        i = self.leaves + length
        if self.tree[i]:
            return length
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None

    def _change(self, left: int, by: int) -> None:
        i = self.leaves + left
        while i:
            self.tree[i] += by
            i >>= 1


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, low, high, first, each, offset): of the rows of this length, those with places
    low to high - 1 go to bins from `first` on, `each` in a row to one bin, from `offset` on."""
    bins, made, plan = OpenBins(capacity), 0, []
    for length in sorted(histogram, reverse=True):
        low, end = 0, histogram[length]
        while low < end:
            left = bins.tightest(length)
            room = capacity if left is None else left
            each = room // length
            whole, rest = divmod(end - low, each)
            if left is None:
                first, used = made, whole or 1
                made += used
            else:
                first, used = bins.take(left, whole or 1)
            high = min(end, low + used * each)
            plan.append((length, low, high, first, each, capacity - room))
            filled = high - low if whole == 0 else each
            bins.add(room - filled * length, first, used)
            low = high
    return plan


def pack(df: DataFrame, length_col: str, capacity: int, order: list[str]) -> DataFrame:
    """df with sequence_id and offset (in place of columns so named): best-fit decreasing into
    sequences of `capacity`.

    Rows of equal length are told apart by `order`; full ties get any of their places. A null
    length or one under 1 takes no place (nulls); one over the capacity is an error. Every
    sequence is gapless from 0. An empty table stays empty.
    """
    spark, made = df.sparkSession, ("sequence_id", "offset")
    kept = [c for c in df.columns if c not in made]
    # the caller's columns travel as one, so that none clashes with those made here
    items = materialize(df.select(F.struct(*kept).alias("_row"), F.col(length_col).cast("bigint").alias("_length")), "pieces")
    fits = items.where(F.col("_length") >= 1)
    if not items.where(F.col("_length") > capacity).isEmpty():
        raise ValueError(f"a length is over the capacity of {capacity}")
    # at most `capacity` rows
    counts = {r["n"]: r["c"] for r in fits.groupBy(F.col("_length").alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()}
    base, start = {}, 0
    for length in sorted(counts):
        base[length] = start
        start += counts[length]
    rows = [(n, base[n] + low, base[n] + high, first, each, offset) for n, low, high, first, each, offset in plan_bins(counts, capacity)]
    # at most a few rows for each length and capacity, however many rows there are
    plan = spark.createDataFrame(rows, "_n bigint, _low bigint, _high bigint, _first bigint, _each bigint, _at bigint")
    placed = number_rows(fits, ["_length", *[F.col("_row")[c] for c in order]], "_place")
    step = F.col("_place") - F.col("_low")
    found = placed.join(
        F.broadcast(plan), (F.col("_length") == F.col("_n")) & (F.col("_place") >= F.col("_low")) & (F.col("_place") < F.col("_high"))
    ).select(
        "_row.*",
        (F.col("_first") + F.floor(step / F.col("_each"))).cast("bigint").alias("sequence_id"),
        (F.col("_at") + (step % F.col("_each")) * F.col("_n")).cast("bigint").alias("offset"),
    )
    rest = items.where(F.coalesce(F.col("_length") < 1, F.lit(True))).select("_row.*")
    return found.unionByName(rest.withColumn("sequence_id", F.lit(None).cast("bigint")).withColumn("offset", F.lit(None).cast("bigint")))


#: How a tokenizer file must normalise and split for its words to be cut here.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Code points whose normal form is their lower case and whose kind is plain; letters among them.
PLAIN = ((0x09, 0x0A), (0x0D, 0x0D), (0x20, 0x7E), (0xA1, 0xA9), (0xAB, 0xB1), (0xB4, 0xB4), (0xB6, 0xB8), (0xBB, 0xBB), (0xBF, 0x12F), (0x131, 0x148), (0x14A, 0x17F))
LETTERS = ((0x61, 0x7A), (0xDF, 0xF6), (0xF8, 0x17F))
_SPACE, _LETTER, _DIGIT, _OTHER, _FAR = range(5)
_TOP = 0x180


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Kind of each code point below _TOP by its lower case, _FAR for others; and the lower case."""
    kind, lower = np.full(_TOP + 1, _FAR, np.uint8), np.arange(_TOP + 1, dtype=np.uint32)
    for first, last in PLAIN:
        for cp in range(first, last + 1):
            lower[cp] = small = ord(chr(cp).lower())
            letter = any(a <= small <= b for a, b in LETTERS)
            kind[cp] = _LETTER if letter else _DIGIT if 0x30 <= cp <= 0x39 else _SPACE if cp <= 0x20 else _OTHER
    return kind, lower


def cut_words(texts: list[str]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Which texts are plain; their words as the pattern SPLIT takes them, in order; and how many words each text has."""
    kinds, lower = _tables()
    points = np.frombuffer(("\n".join(texts) + "\n\n\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    near = np.minimum(points, _TOP)
    kind, low = kinds[near], lower[near]
    origin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    far = np.searchsorted(np.flatnonzero(kind == _FAR), origin)
    plain = far[1:] == far[:-1]
    for i in np.flatnonzero(~plain).tolist():
        kind[origin[i] : origin[i + 1]] = _SPACE
    begins = (kind != _SPACE) & ((kind == _DIGIT) | (kind != np.concatenate([[_SPACE], kind[:-1]])))
    # an apostrophe that stands alone takes the letters of a contraction from the word behind it
    alone = np.flatnonzero(begins[:-3] & (low[:-3] == 0x27) & (kind[1:-2] == _LETTER))
    one, two = low[alone + 1], low[alone + 2]
    size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
    for a, b in ("re", "ve", "ll"):
        size[(one == ord(a)) & (two == ord(b))] = 2
    alone, size = alone[size > 0], size[size > 0]
    begins[alone + 1] = False
    begins[alone + 1 + size] |= kind[alone + 1 + size] == _LETTER
    edges = np.flatnonzero(begins | (kind == _SPACE))
    first = begins[edges]
    start = edges[first]
    length = np.append(edges[1:], len(kind))[first] - start
    kept = low[kind != _SPACE]
    ends = np.concatenate([[0], np.cumsum(length)])
    places = np.concatenate([[0], np.cumsum(1 + (kept > 0x7F), dtype=np.int64)])[ends].astype(np.int32)
    letters = kept.tobytes().decode("utf-32-le").encode()
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(places), pa.py_buffer(letters))
    return plain, words, np.diff(np.searchsorted(start, origin))


class _Tokenizer:
    """A tokenizer file as a worker holds it. Its words are cut here, and their ids remembered, only
    if the file splits texts by rules that are known to cut_words; else it reads whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        with open(path) as file:
            text = file.read()
        form = json.loads(text)
        split, model = form.get("pre_tokenizer") or {}, form.get("model") or {}
        first, *rest = split.get("pretokenizers") or [{}]
        self.by_word = (
            form.get("normalizer") == NORMALIZER and first.get("type") == "Split" and first.get("pattern") == {"Regex": SPLIT}
            and first.get("behavior") == "Removed" and first.get("invert") is True
            and all(r.get("type") == "ByteLevel" and not r.get("add_prefix_space") and not r.get("use_regex") for r in rest)
            and model.get("type") == "BPE" and not model.get("dropout") and model.get("end_of_word_suffix") == "</w>"
        )
        self.added = [t["content"] for t in form.get("added_tokens") or []]
        self.own = Tokenizer.from_str(text)
        vocabulary = self.own.get_vocab()
        self.word_end = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.word_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        fresh = [w for w in words if w not in self.known]
        if len(self.known) + len(fresh) > REMEMBER:
            self.known.clear()
            fresh = words
        groups = [fresh[k : k + 256] for k in range(0, len(fresh), 256)]
        for group, ids in zip(groups, self.direct([" ".join(g) for g in groups])):
            stops = np.flatnonzero(self.word_end[np.frombuffer(ids, "<u4")]) + 1
            if len(stops) != len(group):
                self.known.update(zip(group, self.direct(group)))
                continue
            at = 0
            for word, stop in zip(group, (4 * stops).tolist()):
                self.known[word] = ids[at:stop]
                at = stop

    def encoded(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self.direct(texts)
        # a text with the string of an added token is read whole
        whole = [any(t in text for t in self.added) for text in texts]
        plain, words, counts = cut_words(["" if w else t for w, t in zip(whole, texts)])
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self.learn(distinct)
        ids = [self.known[w] for w in distinct]
        begin = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int64)
        flat, sizes = gather(np.frombuffer(b"".join(ids), "<u4"), begin, coded.indices.to_numpy().astype(np.int64))
        stops = 4 * np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        raw = flat.tobytes()
        out = [raw[a:b] for a, b in zip(stops.tolist(), stops[1:].tolist())]
        rest = [i for i, (w, p) in enumerate(zip(whole, plain.tolist())) if w or not p]
        for i, x in zip(rest, self.direct([texts[i] for i in rest])):
            out[i] = x
        return out


#: A worker's tokenizers by file.
_tokenizers: dict[str, _Tokenizer] = {}


def token_ids(path: str, closing: int):
    """Batches of (doc_id, text) -> (doc_id, ids): little-endian 32-bit ids of the tokenizer
    file, without special tokens around the text, and the closing id. Added tokens' strings in a
    text are read as the file's tokenizer reads them. A worker remembers the ids of words."""

    def run(batches):
        if path not in _tokenizers:
            _tokenizers[path] = _Tokenizer(path)
        last = np.array([closing], "<u4").tobytes()
        for batch in batches:
            low = 0
            for part in parts(batch.column(1)):
                ids = [x + last for x in _tokenizers[path].encoded([t or "" for t in part.to_pylist()])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(part)), pa.array(ids, pa.binary())], ["doc_id", "ids"])
                low += len(part)

    return run


def token_pieces(df: DataFrame, path: str, capacity: int, closing: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids): the token ids of every row and the closing id, cut
    into pieces of `capacity` only where longer. ids are little-endian 32-bit numbers. A
    null or empty text is the closing id alone; null and repeated ids stay as they are."""
    texts = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ids = texts.mapInArrow(token_ids(path, closing), "doc_id bigint, ids binary")
    total = F.floor(F.octet_length("ids") / 4)
    cut = ids.withColumn("piece", F.explode(F.sequence(F.lit(0), (F.ceil(total / capacity) - 1).cast("int"))))
    part = F.substring("ids", F.col("piece") * (4 * capacity) + 1, F.lit(4 * capacity))
    return cut.select(
        "doc_id", "piece", (F.col("piece").cast("bigint") * capacity).alias("start"),
        F.floor(F.octet_length(part) / 4).cast("bigint").alias("length"), part.alias("ids"),
    )
