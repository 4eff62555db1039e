"""Toxicity of texts: a learnt lexicon, matched with misspellings, weighed by context.

The lexicon is a trie of words, and of stems whose words are toxic as a family. The Levenshtein
automata of all its terms are intersected with the trie into one deterministic automaton,
which runs over all words of a batch abreast. A word that reaches a term is a hit; words around
it and quotation marks then tell quotation from abuse, with weights learnt from the hits.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusveil.llm.frames import only_keys
from corpusveil.llm.text_hash import mix, shingle_sets
from corpusveil.session import materialize

#: Size of the model: terms, known words near a term, slots of context words.
TERMS, NEAR_WORDS, SLOTS = 1024, 1 << 16, 1 << 14
#: A term's toxic share; for a stem, and how many different words it must have, and its shortest length.
WORD_SHARE, STEM_SHARE, STEM_WORDS, STEM_CHARS = 0.5, 0.8, 4, 3
#: Words on each side that count as context, the weight of what is known before any is seen, and the most context can say (nats).
WINDOW, PRIOR, MOST = 5, 20.0, 4.0
#: What quotation says before any is seen: so many quoted hits, this share of them toxic.
QUOTED_SEEN, QUOTED_TOXIC = 2.0, 0.5
#: Least hashes that tell copies among the training texts.
COPY_SEEDS = tuple(range(0x1F83D9AB, 0x1F83D9AB + 8))
#: Distinct words that a task counts before it passes them on; characters matched at once.
FLUSH, PART = 200_000, 1 << 18
#: Signs that stand for letters inside a word, and quotation marks.
SIGNS, OPENING, CLOSING, STRAIGHT = "*@$!+#", "«„“‹‘", "»”“›’", '"'


def allowed_edits(chars: int, stem: bool) -> int:
    """Edits within which a word still is the term."""
    return 0 if chars < 5 + stem else 1 if chars < 8 else 2


# ---- words


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point of the basic plane: 2 for letters and digits, 1 for signs; its lower case."""
    kind, lower = np.zeros(1 << 16, np.uint8), np.arange(1 << 16, dtype=np.uint32)
    for cp in range(1 << 16):
        c = chr(cp)
        if c.isalnum():
            kind[cp] = 2
            small = c.lower()
            lower[cp] = ord(small) if len(small) == 1 else cp
    kind[[ord(c) for c in SIGNS]] = 1
    return kind, lower


class Words:
    """Words of some texts: letters and digits, with signs between them. Lower case, one code point for one."""

    def __init__(self, texts: list[str]):
        kinds, lower = _tables()
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        near = np.minimum(points, 0xFFFF)
        self.points = np.where(points < 0x10000, lower[near], points).astype(np.uint32)
        kind = np.where(points < 0x10000, kinds[near], 2)  # beyond the basic plane all counts as letters
        inside = kind > 0
        edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # signs at the edges are no part of a word
        full = np.flatnonzero(kind == 2)
        first, last = np.searchsorted(full, start), np.searchsorted(full, end) - 1
        some = first <= last
        self.start, self.end = full[first[some]] if len(full) else start[:0], full[last[some]] + 1 if len(full) else end[:0]
        origin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        self.origin, self.doc = origin, np.searchsorted(origin, self.start, "right") - 1
        self._text = None

    @property
    def text(self) -> str:
        if self._text is None:
            self._text = self.points.tobytes().decode("utf-32-le", "surrogatepass")
        return self._text

    def word(self, i: int) -> str:
        return self.text[self.start[i] : self.end[i]]


def _parts(texts: list[str]):
    low, chars = 0, 0
    for i, text in enumerate(texts):
        if i > low and chars + len(text) > PART:
            yield low, i
            low, chars = i, 0
        chars += len(text)
    if low < len(texts):
        yield low, len(texts)


# ---- the automaton


@dataclass(frozen=True)
class Automaton:
    """The terms' Levenshtein automata, intersected with their trie. State 0 is dead, 1 the start."""

    terms: tuple[tuple[str, bool], ...]  # term, whether it is a stem
    classes: np.ndarray  # class of every code point of the basic plane; 0: in no term
    steps: np.ndarray  # states x classes
    term: np.ndarray  # the term that a word ending here is, or -1
    edits: np.ndarray
    final: np.ndarray  # states that no further letter changes

    @staticmethod
    def build(terms: list[tuple[str, bool]]) -> Automaton:
        children: list[dict[str, int]] = [{}]
        ends: list[list[int]] = [[]]
        most = [0]
        for t, (word, stem) in enumerate(terms):
            at, k = 0, allowed_edits(len(word), stem)
            most[0] = max(most[0], k)
            for c in word:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    ends.append([])
                    most.append(0)
                at = children[at][c]
                most[at] = max(most[at], k)
            ends[at].append(t)
        limit = [allowed_edits(len(w), s) for w, s in terms]
        letters = sorted({c for w, _ in terms for c in w if ord(c) < 1 << 16})
        number = {c: i + 1 for i, c in enumerate(letters)}

        def closed(reached: dict[int, int], done):
            """Also the nodes reached by leaving out letters; then the best stem already met."""
            stack = list(reached.items())
            while stack:
                node, e = stack.pop()
                if reached.get(node, 99) < e:
                    continue
                for child in children[node].values():
                    if e + 1 <= most[child] and e + 1 < reached.get(child, 99):
                        reached[child] = e + 1
                        stack.append((child, e + 1))
            for node, e in reached.items():
                for t in ends[node]:
                    if terms[t][1] and e <= limit[t]:
                        done = min(done, (e, t)) if done else (e, t)
            if done:  # only what could still be better than the stem is of interest
                reached = {n: e for n, e in reached.items() if e < done[0]}
            return frozenset(reached.items()), done

        def after(state, c):
            nodes, done = state
            reached: dict[int, int] = {}
            for node, e in nodes:
                if e + 1 <= most[node]:
                    reached[node] = min(reached.get(node, 99), e + 1)
                for letter, child in children[node].items():
                    cost = e + (letter != c)
                    if cost <= most[child]:
                        reached[child] = min(reached.get(child, 99), cost)
            return closed(reached, done)

        dead, start = (frozenset(), None), closed({0: 0}, None)
        known, queue, rows = {dead: 0, start: 1}, [start], {0: np.zeros(len(letters) + 1, np.int32)}
        while queue:
            state = queue.pop()

            def place(s):
                if s not in known:
                    known[s] = len(known)
                    queue.append(s)
                return known[s]

            row = np.full(len(letters) + 1, place(after(state, None)), np.int32)
            for c in {c for node, _ in state[0] for c in children[node]}:
                if c in number:
                    row[number[c]] = place(after(state, c))
            rows[known[state]] = row
        term, edits, final = np.full(len(known), -1, np.int32), np.zeros(len(known), np.int8), np.zeros(len(known), bool)
        for (nodes, done), s in known.items():
            best = min([(e, t) for node, e in nodes for t in ends[node] if e <= limit[t]] + ([done] if done else []), default=None)
            final[s] = not nodes
            if best:
                edits[s], term[s] = best
        classes = np.zeros(1 << 16, np.int32)
        for c, i in number.items():
            classes[ord(c)] = i
        return Automaton(tuple(terms), classes, np.stack([rows[s] for s in range(len(known))]), term, edits, final)

    def match(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(term or -1, edits) of every word points[start:end]; all words advance together."""
        state = np.ones(len(start), np.int32)
        live, step = np.arange(len(start)), 0
        at, length = start.astype(np.int64), (end - start)
        while len(live):
            live = live[length[live] > step]
            p = points[at[live] + step]
            state[live] = now = self.steps[state[live], np.where(p < 0x10000, self.classes[np.minimum(p, 0xFFFF)], 0)]
            live = live[~self.final[now]]
            step += 1
        return self.term[state], self.edits[state]


# ---- the model


@dataclass(frozen=True)
class Model:
    """The automaton, the share of toxic texts among a term's, that of words near a term (known
    ones, others by edits), the context's weights in nats, and the score without a hit."""

    automaton: Automaton
    term: np.ndarray
    near: dict[str, float]
    others: np.ndarray
    context: np.ndarray  # the last entry is for quotation
    floor: float


def _quoted(text: str, start: int, end: int) -> bool:
    """The place lies between quotation marks of its line (200 characters each way are looked at)."""
    before = text[max(0, start - 200) : start].rpartition("\n")[2]
    behind = text[end : end + 200].partition("\n")[0]
    if before.count(STRAIGHT) % 2 and STRAIGHT in behind:
        return True
    marks = re.findall(f"[{OPENING}{CLOSING}]", before)
    following = re.search(f"[{OPENING}{CLOSING}]", behind)
    return bool(marks) and marks[-1] in OPENING and following is not None and following[0] in CLOSING


def hits(words: Words, automaton: Automaton):
    """For each hit: word, term, edits, slots of the words around it, whether it is quoted."""
    term, edits = automaton.match(words.points, words.start, words.end)
    for i in np.flatnonzero(term >= 0).tolist():
        doc = words.doc[i]
        around = [j for j in range(max(0, i - WINDOW), min(len(words.doc), i + WINDOW + 1)) if words.doc[j] == doc and term[j] < 0]
        slots = sorted({zlib.crc32(words.word(j).encode("utf-8", "surrogatepass")) % SLOTS for j in around})
        low, high = words.origin[doc], words.origin[doc + 1] - 1
        text = words.text[low:high]
        yield i, int(term[i]), int(edits[i]), slots, _quoted(text, words.start[i] - low, words.end[i] - low)


def _word_counts(batches):
    """Batches of (text, toxic) -> the task's (word, n1, n0): toxic and other texts that have it."""
    counts = (Counter(), Counter())

    def flushed():
        every = list(counts[0].keys() | counts[1].keys())
        made = pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *(pa.array([counts[k][w] for w in every], pa.int64()) for k in (1, 0))], ["word", "n1", "n0"])
        counts[0].clear()
        counts[1].clear()
        return made

    for batch in batches:
        texts, toxic = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for low, high in _parts(texts):
            words = Words([t.encode("utf-8", "replace").decode() for t in texts[low:high]])
            whole, bounds = words.text, np.searchsorted(words.doc, np.arange(high - low + 1))
            start, end = words.start.tolist(), words.end.tolist()
            for k in range(high - low):
                counts[toxic[low + k]].update({whole[start[i] : end[i]] for i in range(bounds[k], bounds[k + 1])})
            if len(counts[0]) + len(counts[1]) > FLUSH:
                yield flushed()
    yield flushed()


def _sure(n1, n0, base: float):
    """How sure it is that more of the texts are toxic than of all (nats, Chernoff's bound)."""
    n = n1 + n0
    p = n1 / n
    part = lambda x, q: F.when(x > 0, x * F.log(x / q)).otherwise(F.lit(0.0))
    return F.when(p > base, n * (part(p, F.lit(base)) + part(1 - p, F.lit(1 - base)))).otherwise(F.lit(0.0))


def _surely(n1: int, n0: int, base: float) -> float:
    """As _sure, of two numbers."""
    p = n1 / (n1 + n0)
    rest = (1 - p) * np.log((1 - p) / (1 - base)) if n0 else 0.0
    return (n1 + n0) * (p * np.log(p / base) + rest) if p > base else 0.0


def _lexicon(counts: DataFrame, base: float) -> tuple[list[tuple[str, bool]], dict[tuple[str, bool], tuple[int, int]]]:
    """Terms of which it is sure, at the number of words looked at, that they are toxic. At most TERMS words and
    TERMS stems (with 4 lengths each) reach the driver, the surest ones."""
    n1, n0 = F.col("n1"), F.col("n0")
    need = float(np.log(100.0 * max(1, counts.count())))
    words = counts.where((n1 >= WORD_SHARE * (n1 + n0)) & (n1 >= 3) & (F.char_length("word") >= 3)).withColumn("sure", _sure(n1, n0, base)).where(F.col("sure") > need)
    chars = F.char_length("word")
    starts = counts.where(chars >= STEM_CHARS).select(F.explode(F.transform(F.sequence(F.lit(STEM_CHARS), F.least(chars, F.lit(12))), lambda n: F.substring("word", F.lit(1), n))).alias("word"), "n1", "n0")
    stems = (
        starts.groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.count_if(n1 > 0).alias("kinds"))
        .where((n1 >= STEM_SHARE * (n1 + n0)) & (F.col("kinds") >= STEM_WORDS)).withColumn("sure", _sure(n1, n0, base)).where(F.col("sure") > need)
    )
    found = [
        (-r["sure"], -len(r["word"]), not stem, r["word"], (r["n1"], r["n0"]))
        for df, stem, most in ((stems, True, 4 * TERMS), (words, False, TERMS))
        for r in df.orderBy(F.desc("sure"), F.desc(chars), "word").limit(most).select("word", "n1", "n0", "sure").collect()
    ]
    # the surest first, of equally sure ones the longest; a stem must say something beyond the terms it holds
    terms: dict[tuple[str, bool], tuple[int, int]] = {}
    taken: dict[str, list[int]] = {}
    for _, _, whole, word, (n1, n0) in sorted(found):
        heads = [word[:k] for k in range(1, len(word) + 1)]
        if len(terms) == TERMS or any((h, True) in terms for h in heads):
            continue
        t1, t0 = taken.get(word, (0, 0))
        if not whole and t1 + t0:
            n1, n0 = n1 - t1, n0 - t0
            if n1 < STEM_WORDS or n1 < STEM_SHARE * (n1 + n0) or _surely(n1, n0, base) <= need:
                continue
        terms[word, not whole] = (n1, n0)
        for h in heads:
            t = taken.setdefault(h, [0, 0])
            t[0], t[1] = t[0] + n1, t[1] + n0
    order = sorted(terms)
    return order, {t: terms[t] for t in order}


def _near(shared):
    """Batches of (word, n1, n0) -> those within a term's edits, with term and edits."""

    def run(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            points = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
            size = np.array([len(p) for p in points], np.int64)
            end = np.cumsum(size)
            term, edits = shared.value.match(np.concatenate(points) if points else np.zeros(0, np.uint32), end - size, end)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(term), pa.array(edits.astype(np.int32))], ["word", "n1", "n0", "term", "edits"]).filter(pa.array(term >= 0))

    return run


def _context_counts(shared):
    """Batches of (text, toxic) -> the task's hits by (slot, toxic): context words, quotation (SLOTS), all
    hits (SLOTS + 1), texts (SLOTS + 2), texts without a hit (SLOTS + 3)."""

    def run(batches):
        counts = np.zeros((SLOTS + 4, 2), np.int64)
        for batch in batches:
            texts, toxic = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for low, high in _parts(texts):
                words = Words(texts[low:high])
                seen = set()
                for i, _, _, slots, quoted in hits(words, shared.value):
                    k = toxic[low + words.doc[i]]
                    seen.add(words.doc[i])
                    counts[slots, k] += 1
                    counts[SLOTS, k] += quoted
                    counts[SLOTS + 1, k] += 1
                for d in range(high - low):
                    counts[SLOTS + 2, toxic[low + d]] += 1
                    counts[SLOTS + 3, toxic[low + d]] += d not in seen
        slot, k = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(counts[slot, k])], ["slot", "toxic", "n"])

    return run


def _marked(batches):
    """Batches of (id, key, text) -> (id, key, marks): the least of the text's shingle hashes under each of COPY_SEEDS."""
    for batch in batches:
        marks = []
        for tokens in shingle_sets(batch.column(2), 3):
            marks.append([int(mix(tokens ^ np.uint64(seed)).min().view(np.int64)) for seed in COPY_SEEDS] if len(tokens) else [])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(marks, pa.list_(pa.int64()))], ["id", "key", "marks"])


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(text, toxic) of the texts with a label, one of each group of copies and near copies, as words
    of a text that was copied a thousand times say no more than those of one.

    A text stays if it has the smallest id of those with its least shingle hash, under more than half of
    COPY_SEEDS: near copies seldom do, texts that only share a passage nearly always. Only texts that may have a label move. Rows without id or label, and
    texts without a word, take no part; of several labels of an id the highest holds.
    """
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("toxic"))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("key"), F.col(text_col).cast("string").alias("text"))
    # texts are hashed where they stand; only those that stay move
    marked = only_keys(rows, "id", marks).mapInArrow(_marked, "id bigint, key bigint, marks array<bigint>").where(F.size("marks") > 0)
    known = materialize(marked.join(marks, "id"), "labelled")
    first = known.select(F.struct("id", "key", "toxic").alias("of"), F.posexplode("marks").alias("band", "mark")).groupBy("band", "mark").agg(F.min("of").alias("of"))
    stay = materialize(first.groupBy("of").agg(F.count(F.lit(1)).alias("n")).where(2 * F.col("n") > len(COPY_SEEDS)).select("of.*"), "stay")
    found = only_keys(rows, "id", stay).join(stay, ["id", "key"])
    return materialize(found.groupBy("id", "key").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic"), "training")


def fit(train: DataFrame) -> Model:
    """A model of (text, toxic 0/1) rows, all of which are counted. No rows, or none of one kind, give
    a model without terms, which scores every text alike. What reaches the driver is bounded by
    TERMS, NEAR_WORDS and SLOTS."""
    spark = train.sparkSession
    total = train.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    base = (total["t"] + 0.5) / (total["n"] + 1)
    counts = materialize(train.mapInArrow(_word_counts, "word string, n1 bigint, n0 bigint").groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")), "words")
    order, seen = _lexicon(counts, base) if 0 < total["t"] < total["n"] else ([], {})
    automaton = Automaton.build(order)
    shared = spark.sparkContext.broadcast(automaton)
    near = counts.mapInArrow(_near(shared), "word string, n1 bigint, n0 bigint, term int, edits int").where("edits > 0")
    near = materialize(near, "near")
    known = near.orderBy(F.desc(F.col("n1") + F.col("n0")), "word").limit(NEAR_WORDS).collect()
    kinds = {r["edits"]: (r["t"], r["n"]) for r in near.groupBy("edits").agg(F.count_if(F.col("n1") > F.col("n0")).alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    # words near a term that the training texts do not have: by how many such words are toxic; one of two before any is seen
    others = np.array([0.0] + [(kinds.get(e, (0, 0))[0] + 2.0) / (kinds.get(e, (0, 0))[1] + 4.0) for e in (1, 2)])
    sums = np.zeros((SLOTS + 4, 2))
    for r in train.mapInArrow(_context_counts(shared), "slot int, toxic int, n bigint").groupBy("slot", "toxic").agg(F.sum("n").alias("n")).collect():  # at most 2 x slots
        sums[r["slot"], r["toxic"]] = r["n"]
    share = (sums[SLOTS + 1, 1] + 1) / (sums[SLOTS + 1].sum() + 2)
    seen0, seen1 = sums[:SLOTS, 0], sums[:SLOTS, 1]
    context = np.log((seen1 + PRIOR * share) / (seen0 + PRIOR * (1 - share))) - np.log(share / (1 - share))
    quoted1, quoted0 = sums[SLOTS, 1] + QUOTED_SEEN * QUOTED_TOXIC, sums[SLOTS, 0] + QUOTED_SEEN * (1 - QUOTED_TOXIC)
    quotation = np.log(quoted1 / quoted0) - np.log(share / (1 - share))
    return Model(
        automaton, np.array([(seen[t][0] + 1) / (sum(seen[t]) + 1.5) for t in order]),
        {r["word"]: (r["n1"] + 0.5 * others[r["edits"]]) / (r["n1"] + r["n0"] + 0.5) for r in known},
        others, np.append(context, min(quotation, 0.0)), float((sums[SLOTS + 3, 1] + 0.5 * base) / (sums[SLOTS + 3].sum() + 0.5)),
    )


def score_texts(texts: list[str], model: Model):
    """For each text its score and hits (start, end, term, edits, quoted, likelihood)."""
    scores, found = [], [[] for _ in texts]
    for low, high in _parts(texts):
        words = Words(texts[low:high])
        best: list[dict[int, float]] = [{} for _ in range(low, high)]
        for i, term, edits, slots, quoted in hits(words, model.automaton):
            word = words.word(i)
            p = model.term[term] if edits == 0 else model.near.get(word, model.others[edits])
            p = min(max(p, 1e-4), 1 - 1e-4)
            told = float(np.clip(model.context[slots].sum() + quoted * model.context[SLOTS], -MOST, MOST if edits == 0 else 0.0))
            p = 1 / (1 + np.exp(-(np.log(p / (1 - p)) + told)))
            d = words.doc[i]
            best[d][term] = max(best[d].get(term, 0.0), p)
            at = words.start[i] - words.origin[d]
            found[low + d].append({"start": int(at), "end": int(at + words.end[i] - words.start[i]), "term": model.automaton.terms[term][0], "edits": edits, "quoted": quoted, "likelihood": float(p)})
        scores += [1 - (1 - model.floor) * float(np.prod([1 - p for p in b.values()])) for b in best]
    return scores, found


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, hits) for every row: the likelihood that the text is toxic, 0 to 1, and
    array<struct<start, end, term, edits, quoted, likelihood>> in code points.

    A null text is read as empty; a text without a hit has the share of toxic texts among such.
    Repeated hits of a term count once, with the likeliest. Ids may be null or repeated, other
    columns are never read, an empty table gives no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hit = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_()), ("likelihood", pa.float64())])

    def run(batches):
        for batch in batches:
            scores, found = score_texts([t or "" for t in batch.column(1).to_pylist()], shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(found, pa.list_(hit))], ["doc_id", "score", "hits"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, score double, hits array<struct<start:bigint,end:bigint,term:string,edits:int,quoted:boolean,likelihood:double>>")
