"""Personal data behind disguises, with spans in the source text.

Base patterns find plain addresses and numbers. A transducer then rewrites disguises
(look-alike letters, invisible characters, spelled digits, "at" and "dot") and remembers where
each rewritten piece came from; the same patterns run over the result, and what they find
is mapped back to the source's code points.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Look-alikes of Latin letters. Full-width forms and other digits follow from Unicode.
LOOKALIKES = dict(zip(
    "авсԁеһіјӏмопрԛѕтухѵԝАВСЕНІЈКМОРЅТХУ" + "αεικνορτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "abcdehijlmonpqstyxvwABCEHIJKMOPSTXY" + "aeiknoptuxABEZHIKMNOPTYX",
    strict=True,
))
INVISIBLE = "­​‌‍‎‏⁠﻿"
#: Spelled digits of the corpus' languages.
DIGITS = {
    w: str(i)
    for words in (
        "zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for i, w in enumerate(words.split())
} | {"oh": "0"}
DOTS = ("dot", "point", "punkt", "punto")

_number = "(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + ")"
_dot = "(?:" + "|".join(DOTS) + ")"
_CHAIN = re.compile(rf"\b(?:plus[ \t]+)?(?:{_number}|[0-9]{{1,3}}(?=[ \t]+{_dot}\b))(?:[ \t-]+(?:{_number}|{_dot}|[0-9]+)\b)+(?!@)", re.I)
_CHAIN_WORD = re.compile(r"[^\W_]+")
_BRACKET = re.compile(rf"[ \t]*[(\[{{<][ \t]*(?:(at|ät|arroba)|{_dot})[ \t]*[)\]}}>][ \t]*", re.I)
_name = r"[^\W_](?:[\w-]*[^\W_])?"
_SPACED = re.compile(rf"(?<=[\w])[ \t]+at[ \t]+{_name}(?:[ \t]+dot[ \t]+{_name})+(?!\w)", re.I)
_SPACED_WORD = re.compile(r"[ \t]+(?:(at)|dot)[ \t]+", re.I)
_HINT = re.compile(rf"[(\[{{<][ \t]*(?:at|ät|arroba|{_dot})[ \t]*[)\]}}>]|[ \t]dot[ \t]|[0-9][ \t]+{_dot}\b|\b{_number}[ \t-]+(?:{_number}\b|{_dot}\b|[0-9])", re.I)
_foreign = "".join(LOOKALIKES) + INVISIBLE + "！-～"
_FOREIGN = re.compile(f"[{_foreign}]")
_OTHER_DIGIT = re.compile(r"(?![0-9])\d")

_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of plain identifiers, by kind and start."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((0, start, found.end()))
            done = found.end()
        else:
            done = at + 1
        at = text.find("@", done)
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((3, *m.span()))
    return out


def _spelled(chain: str) -> str:
    words = _CHAIN_WORD.findall(chain.lower())
    return "".join("+" if w == "plus" else "." if w in DOTS else DIGITS.get(w, w) for w in words)


def _apart(spans: list[tuple], others: list[tuple]) -> list[tuple]:
    """Those of spans (start, end, ...) that meet none of others; both in order and without overlap."""
    ends = [b for _, b, *_ in others]
    out = []
    for s in spans:
        i = bisect_right(ends, s[0])
        if i == len(ends) or others[i][0] >= s[1]:
            out.append(s)
    return out


def rewrites(text: str) -> list[tuple[int, int, str]]:
    """(start, end, what it stands for) of every disguise, in order and without overlap."""
    found: list[tuple[int, int, str]] = []
    if _HINT.search(text):
        found += [(*m.span(), "@" if m[1] else ".") for m in _BRACKET.finditer(text)]
        chains = [(*m.span(), _spelled(m[0])) for m in _CHAIN.finditer(text)]
        # "at eight dot eight dot eight dot eight" is a number, "at one dot com" an address
        spaced = _apart([m.span() for m in _SPACED.finditer(text)], [c for c in chains if base_spans(c[2])])
        for start, end in spaced:
            found += [(*w.span(), "@" if w[1] else ".") for w in _SPACED_WORD.finditer(text, start, end)]
        found += _apart(chains, spaced)
    if not text.isascii():
        for m in _FOREIGN.finditer(text):
            c = m[0]
            found.append((*m.span(), "" if c in INVISIBLE else LOOKALIKES.get(c) or chr(ord(c) - 0xFEE0)))
        found += [(*m.span(), str(unicodedata.digit(m[0]))) for m in _OTHER_DIGIT.finditer(text)]
    kept, end = [], 0
    for r in sorted(found, key=lambda r: (r[0], -r[1])):
        if r[0] >= end:
            kept.append(r)
            end = r[1]
    return kept


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and those the rewritten text adds: none that a base span of its kind holds whole.
    A base span may be a fragment of an added one."""
    base = base_spans(text)
    changes = rewrites(text)
    if not changes:
        return base, []
    pieces, places, at, size = [], [0], 0, 0  # places: start in the rewritten text of piece i
    source = [(0, False)]  # start in the source, and whether the piece is a rewritten one
    for start, end, made in changes:
        pieces += [text[at:start], made]
        size += start - at
        places.append(size)
        source.append((start, True))
        size += len(made)
        places.append(size)
        source.append((end, False))
        at = end
    pieces.append(text[at:])
    plain = "".join(pieces)

    def origin(place: int, closing: bool) -> int:
        """Where a span's start or end (exclusive) stands in the source."""
        i = bisect_right(places, place - closing) - 1
        start, made = source[i]
        if made:
            return source[i + 1][0] if closing else start
        return start + place - places[i]

    # base spans of a kind do not overlap
    own = [[s[1:] for s in base if s[0] == kind] for kind in range(len(KINDS))]
    added = []
    for kind, start, end in base_spans(plain):
        a, b = origin(start, False), origin(end, True)
        i = bisect_right(own[kind], a, key=lambda s: s[0]) - 1
        if i < 0 or own[kind][i][1] < b:
            added.append((kind, a, b))
    return base, added


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind; spans that overlap are one of the first's kind."""
    out, at, merged = [], 0, []
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([k, a, b])
    for k, a, b in merged:
        out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = b
    return "".join([*out, text[at:]])


FORM = "doc_id bigint, base array<struct<kind:string,start:bigint,end:bigint>>, added array<struct<kind:string,start:bigint,end:bigint>>, base_text string, spans string"


def _found(batches):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    rows = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]
    for batch in batches:
        both = [all_spans(t or "") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([rows(b) for b, _ in both], kind), pa.array([rows(a) for _, a in both], kind),
             pa.array([render(b) for b, _ in both], pa.string()), pa.array([render(b + a) for b, a in both], pa.string())],
            ["doc_id", "base", "added", "base_text", "spans"],
        )


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """FORM for every row: spans of the base patterns and the added ones, in code points, end
    exclusive; base_text and spans list them as kind:start:end, by kind and start.

    A null or empty text has none. Ids may be null or repeated; an empty table gives no rows;
    other columns are ignored. Every pattern runs over the whole text in linear time.
    """
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_found, FORM)


def mask(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with <KIND> in place of each span of text_col; nulls stay null, other columns as they are."""
    place = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = []
            for t in batch.column(place).to_pylist():
                base, added = all_spans(t) if t else ([], [])
                texts.append(masked(t, base + added) if base or added else t)
            columns = [pa.array(texts, pa.string()) if i == place else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, fields)
