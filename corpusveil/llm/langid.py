"""Language spans of mixed texts: script ranges, word scores, and Viterbi with a switching cost.

A word is a run of letters. Its script narrows the languages to those that use the script;
hashed letter trigrams score it under each of them. Over a text's words the best path of
languages is sought, where every change of language costs SWITCH.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Trigram slots of a language's model: with the number of languages the size of all that is gathered.
SLOTS = 1 << 16
#: Cost of a change of language in nats; share of a language's letters that makes a script its own.
SWITCH, OWN_SCRIPT, SMOOTHING = 8.0, 0.01, 0.5
#: Characters scored at once.
PART = 1 << 18
UNKNOWN = "und"
#: First code point of letter ranges and their script.
SCRIPTS = (
    (0x0041, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "other"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"),
    (0x13A0, "other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "other"), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"),
    (0x1CC0, "other"), (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"), (0x2C60, "Latin"), (0x2C80, "other"), (0x2DE0, "Cyrillic"),
    (0x2E00, "other"), (0x3040, "Kana"), (0x3100, "other"), (0x3130, "Hangul"), (0x3190, "other"), (0x31F0, "Kana"), (0x3400, "Han"),
    (0xA000, "other"), (0xA640, "Cyrillic"), (0xA6A0, "other"), (0xA720, "Latin"), (0xA800, "other"), (0xAC00, "Hangul"), (0xD7FC, "other"),
    (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "other"), (0xFF21, "Latin"),
    (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFDD, "other"), (0x20000, "Han"), (0x40000, "other"),
)
NAMES = tuple(dict.fromkeys(name for _, name in SCRIPTS))


@dataclass(frozen=True)
class Model:
    """Languages in order, log likelihood of every trigram slot, and which scripts each language uses."""

    languages: tuple[str, ...]
    scores: np.ndarray  # slots x languages
    scripts: np.ndarray  # scripts x languages, True where the language uses the script


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Script number (0: no letter) and lower case of every code point of the basic plane."""
    starts = [s for s, _ in SCRIPTS]
    script, lower = np.zeros(1 << 16, np.uint8), np.arange(1 << 16, dtype=np.uint32)
    for cp in range(1 << 16):
        c = chr(cp)
        if c.isalpha():
            script[cp] = 1 + NAMES.index(SCRIPTS[max(0, bisect_right(starts, cp) - 1)][1])
            small = c.lower()
            lower[cp] = ord(small) if len(small) == 1 else cp
    return script, lower


def _scripts(points: np.ndarray) -> np.ndarray:
    table, _ = _tables()
    out = table[np.minimum(points, 0xFFFF)]
    far = np.flatnonzero(points > 0xFFFF)
    if len(far):
        kinds, which = np.unique(points[far], return_inverse=True)
        han, other = 1 + NAMES.index("Han"), 1 + NAMES.index("other")
        kind = [0 if not unicodedata.category(chr(p)).startswith("L") else han if 0x20000 <= p < 0x40000 else other for p in kinds.tolist()]
        out[far] = np.array(kind, np.uint8)[which]
    return out


class Words:
    """The words of some texts: where they start and end, their text, script and letters' trigram slots."""

    def __init__(self, texts: list[str]):
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        script = _scripts(points)
        _, lower = _tables()
        letter = script > 0
        low = np.where(letter, np.where(points < 0x10000, lower[np.minimum(points, 0xFFFF)], points), 0).astype(np.uint32)
        at = np.flatnonzero(letter)
        before = np.where(at > 0, low[at - 1], 0).astype(np.uint32)
        mixed = (before * np.uint32(0x85EBCA6B)) ^ (low[at] * np.uint32(0xC2B2AE35)) ^ (low[at + 1] * np.uint32(0x27D4EB2F))
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        self.slots = ((mixed ^ (mixed >> np.uint32(13))) & np.uint32(SLOTS - 1)).astype(np.int32)
        self.letter_script = script[at]
        #: the letter (of all letters) at which each word begins
        self.begin = np.flatnonzero(~letter[at - 1] | (at == 0)) if len(at) else at
        self.letters = np.diff(np.append(self.begin, len(at)))
        self.script = self.letter_script[self.begin]
        origin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        self.doc = np.searchsorted(origin, at[self.begin], "right") - 1 if len(at) else at
        self.start = at[self.begin] - origin[self.doc] if len(at) else at
        self.letter_doc = np.repeat(self.doc, self.letters)

    def scores(self, model: Model) -> np.ndarray:
        """words x languages: log likelihoods; languages that do not use a word's script are out, if any other does."""
        if not len(self.begin):
            return np.zeros((0, len(model.languages)), np.float32)
        made = np.add.reduceat(model.scores[self.slots], self.begin, axis=0)
        allowed = model.scripts[self.script]
        narrowed = np.where(allowed | ~allowed.any(axis=1, keepdims=True), made, np.float32(-1e6))
        return narrowed.astype(np.float32)


def _parts(texts: list[str]):
    """Slices of the texts with some PART characters each."""
    low, chars = 0, 0
    for i, text in enumerate(texts):
        if i > low and chars + len(text) > PART:
            yield low, i
            low, chars = i, 0
        chars += len(text)
    if low < len(texts):
        yield low, len(texts)


def _counted(batches):
    """Batches of (text, lang) -> the task's letter counts (lang, slot, letters); scripts stand after the slots."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        texts, langs = [t or "" for t in batch.column(0).to_pylist()], batch.column(1).to_pylist()
        for low, high in _parts(texts):
            words = Words(texts[low:high])
            own = np.array(langs[low:high], object)
            for lang in set(langs[low:high]):
                of_lang = (own == lang)[words.letter_doc] if len(words.letter_doc) else np.zeros(0, bool)
                sums = counts.setdefault(lang, np.zeros(SLOTS + len(NAMES) + 1, np.int64))
                sums[:SLOTS] += np.bincount(words.slots[of_lang], minlength=SLOTS)
                sums[SLOTS:] += np.bincount(words.letter_script[of_lang], minlength=len(NAMES) + 1)
    for lang, sums in counts.items():
        slot = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(slot), pa.string()), pa.array(slot.astype(np.int32)), pa.array(sums[slot])], ["lang", "slot", "n"])


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts over all given rows with a language. What reaches the driver is one number for each
    language and slot, whatever the rows. Null texts count as empty; no rows give no languages."""
    rows = df.where(F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sums = rows.mapInArrow(_counted, "lang string, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    named = np.array(sums["lang"].to_pylist(), object)
    languages = tuple(sorted(set(named.tolist())))
    counts = np.zeros((SLOTS + len(NAMES) + 1, len(languages)))
    place = {lang: i for i, lang in enumerate(languages)}
    counts[sums["slot"].to_numpy(), [place[x] for x in named]] = sums["n"].to_numpy()
    grams, scripts = counts[:SLOTS] + SMOOTHING, counts[SLOTS:]
    shares = scripts / np.maximum(1, scripts.sum(axis=0))
    return Model(languages, np.log(grams / grams.sum(axis=0)).astype(np.float32), shares >= OWN_SCRIPT)


def best_paths(scores: np.ndarray, doc: np.ndarray, switch: float) -> np.ndarray:
    """The language of every word: the best path through each document's words, all documents abreast."""
    n, languages = scores.shape
    if not n or languages < 2:
        return np.zeros(n, np.int16)
    first = np.flatnonzero(np.diff(doc, prepend=doc[0] - 1))
    lengths = np.diff(np.append(first, n))
    order = np.argsort(-lengths, kind="stable")
    first, lengths = first[order], lengths[order]
    came = np.zeros((n, languages), np.int16)
    state = scores[first].astype(np.float64)
    active = len(first)
    for step in range(1, int(lengths[0])):
        while lengths[active - 1] <= step:
            active -= 1
        now = state[:active]
        top = now.argmax(axis=1)
        moved = now.max(axis=1, keepdims=True) - switch
        stay = now >= moved
        words = first[:active] + step
        came[words] = np.where(stay, np.arange(languages), top[:, None])
        state[:active] = scores[words] + np.where(stay, now, moved)
    out = np.zeros(n, np.int16)
    label = state.argmax(axis=1)
    active = 0
    for step in range(int(lengths[0]) - 1, -1, -1):
        while active < len(first) and lengths[active] > step:
            active += 1
        words = first[:active] + step
        out[words] = label[:active]
        label[:active] = came[words, label[:active]] if step else label[:active]
    return out


def _predict(texts: list[str], model: Model):
    """For each text its language and score; for each word its text, letters, start and path."""
    parts, scores = [], []
    for low, high in _parts(texts):
        words = Words(texts[low:high])
        scores.append(words.scores(model))
        parts.append((words.doc + low, words.letters, words.start))
    doc, letters, start = (np.concatenate(x).astype(np.int64) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
    path = best_paths(np.concatenate(scores) if scores else np.zeros((0, len(model.languages)), np.float32), doc, SWITCH)
    k = max(1, len(model.languages))
    by_lang = np.bincount(doc * k + path, letters, len(texts) * k).reshape(-1, k)
    total, best = by_lang.sum(axis=1), by_lang.argmax(axis=1)
    known = (total > 0) & bool(model.languages)
    pred = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, known)]
    score = np.where(known, by_lang.max(axis=1) / np.maximum(1, total), 0.0)
    return pred, score, (doc, letters, start, path)


def _labelled(shared, want_spans: bool):
    def run(batches):
        model: Model = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            pred, score, (doc, letters, start, path) = _predict(texts, model)
            columns, names = [batch.column(0), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
            if want_spans:
                spans: list[list[tuple]] = [[] for _ in texts]
                if model.languages and len(doc):
                    cut = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(path, prepend=-1) != 0))
                    last = np.append(cut[1:], len(doc)) - 1
                    for a, b in zip(cut, last):
                        spans[doc[a]].append({"start": int(start[a]), "end": int(start[b] + letters[b]), "lang": model.languages[path[a]]})
                columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def label(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """(doc_id, lang_pred, score, spans) for every row: the language with most letters, its share of
    all letters, and array<struct<start, end, lang>> in code points, from a span's first to its
    last letter.

    A text that is null or has no letter, and any text under a model without languages, is
    `und` with score 0 and no spans. Ties go to the language first in order. Ids may be null
    or repeated; an empty table gives no rows; other columns are never read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # SLOTS x languages numbers
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    form = f"doc_id {kind}, lang_pred string, score double" + ", spans array<struct<start:bigint,end:bigint,lang:string>>" * spans
    return rows.mapInArrow(_labelled(shared, spans), form)


def accepted(df: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns as they are, whose text has a language with a share of at least
    `least` of its letters; `und` texts go."""
    shared, place = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            pred, score, _ = _predict([t or "" for t in batch.column(place).to_pylist()], shared.value)
            yield batch.filter(pa.array([p != UNKNOWN and s >= least for p, s in zip(pred, score)], pa.bool_()))

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields))
