"""Document fingerprints: homomorphic multiset hashes of paragraphs.

Every paragraph has a wide vector: SUMS numbers modulo 2**32 that hash the whole paragraph,
and LANES numbers modulo 2**16, in which each of its segments (runs of words cut by content)
counts 1 or -1. A fingerprint is the sum over the paragraphs. So it does not depend on their
order, a paragraph is inserted or deleted by adding or subtracting its vector, and the
length of two fingerprints' difference in the LANES tells how much text they do not share.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusveil.llm.text_hash import mix, words

SUMS, LANES = 16, 256
#: A segment ends at one word in so many, chosen by the word.
SEGMENT = 8
#: Characters taken at once.
PART = 1_500_000


def _sums(paragraphs: list[str], first: np.ndarray) -> np.ndarray:
    digests = b"".join(hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=4 * SUMS).digest() for p in paragraphs)
    table = np.frombuffer(digests, "<u4").reshape(-1, SUMS)
    return np.add.reduceat(table, first, axis=0, dtype=np.uint32)


def _lanes(paragraphs: list[str], first: np.ndarray) -> np.ndarray:
    hashes, begin = words(pa.array(paragraphs, pa.string()))
    out = np.zeros((len(first), LANES), np.int32)
    if not len(hashes):
        return out.astype(np.int16)
    fresh = np.zeros(len(hashes), bool)
    fresh[begin[:-1][begin[:-1] < len(hashes)]] = True
    fresh[1:] |= hashes[:-1] % np.uint64(SEGMENT) == 0
    starts = np.flatnonzero(fresh)
    place = np.arange(len(hashes)) - starts[np.cumsum(fresh) - 1]
    segments = mix(np.add.reduceat(mix(hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), starts))
    seeds = np.arange(1, LANES // 64 + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    bits = np.unpackbits(mix(segments[:, None] ^ seeds).view(np.uint8), axis=1)
    doc = np.searchsorted(first, np.searchsorted(begin, starts, "right") - 1, "right") - 1
    held, at = np.unique(doc, return_index=True)
    ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
    out[held] = 2 * ones - np.diff(np.append(at, len(doc)))[:, None]
    return out.astype(np.int16)


def fingerprints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(sums, lanes) of every text. Paragraphs end at line feeds; an empty text is one empty paragraph."""
    sums, lanes, low, chars = [np.zeros((0, SUMS), np.uint32)], [np.zeros((0, LANES), np.int16)], 0, 0
    for i in range(len(texts) + 1):
        if i > low and (i == len(texts) or chars + len(texts[i]) > PART):
            split = [t.split("\n") for t in texts[low:i]]
            first = np.cumsum([0, *map(len, split)])[:-1]
            flat = [p for s in split for p in s]
            sums.append(_sums(flat, first))
            lanes.append(_lanes(flat, first))
            low, chars = i, 0
        if i < len(texts):
            chars += len(texts[i])
    return np.concatenate(sums), np.concatenate(lanes)


def to_text(sums: np.ndarray, lanes: np.ndarray) -> str:
    return base64.b64encode(sums.astype("<u4").tobytes() + lanes.astype("<i2").tobytes()).decode()


def from_text(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw[: 4 * SUMS], "<u4"), np.frombuffer(raw[4 * SUMS :], "<i2")


def _changed(fingerprint: str, paragraph: str, sign: int) -> str:
    sums, lanes = from_text(fingerprint)
    own, signs = fingerprints([paragraph])
    return to_text(sums + own[0] * np.uint32(sign & 0xFFFFFFFF), lanes + signs[0] * np.int16(sign))


def insert(fingerprint: str, paragraph: str) -> str:
    """The fingerprint after one paragraph (without line feeds) came in, wherever."""
    return _changed(fingerprint, paragraph, 1)


def delete(fingerprint: str, paragraph: str) -> str:
    """The fingerprint after one of its paragraphs went."""
    return _changed(fingerprint, paragraph, -1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 less the share of segments that rows of lanes a and b do not share; 1 for two without segments."""
    norm = lambda x: (x.astype(np.float64) ** 2).sum(axis=1)
    apart, whole = norm(a - b), norm(a) + norm(b)  # int16 differences wrap as the sums do
    return np.where(whole > 0, np.clip(1 - apart / np.maximum(whole, 1), 0, 1), 1.0)


FORM = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def _compared(batches):
    """Rows (range, extra, doc_id, text), a range's rows in order and its follower last -> FORM."""
    held = None  # the row that waits for its follower: range, doc_id, text

    def results(rows: list[tuple[int | None, str, str]]):
        own, following = [t for _, t, _ in rows], [f for *_, f in rows]
        cuts = [len(t) // 4 for t in own]
        edited = [t[: len(t) - q] + f[:q] for t, f, q in zip(own, following, cuts)]
        # a follower is mostly the next row's own text
        chained = [k + 1 < len(rows) and following[k] is own[k + 1] for k in range(len(rows))]
        sums, lanes = fingerprints(own + edited + [f for f, c in zip(following, chained) if not c])
        n = len(rows)
        rest = iter(range(2 * n, len(lanes)))
        after = lanes[[k + 1 if c else next(rest) for k, c in enumerate(chained)]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([d for d, *_ in rows], pa.int64()), pa.array([len(t) for t in own], pa.int64()),
                pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]),
                pa.array([to_text(sums[k], lanes[k]) for k in range(n)]), pa.array([to_text(sums[n + k], lanes[n + k]) for k in range(n)]),
                pa.array(likeness(lanes[:n], lanes[n : 2 * n])), pa.array(likeness(lanes[:n], after)),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    for batch in batches:
        out, chars = [], 0
        for where, extra, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
            text = text or ""
            if held and held[0] == where:
                out.append((held[1], held[2], text))
                chars += len(held[2])
            held = None if extra else (where, doc, text)
            if chars > 2 * PART:
                yield results(out)
                out, chars = [], 0
        if out:
            yield results(out)


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """FORM for every row: its fingerprint, that of its edited text (the last quarter of its code
    points replaced by as many, or all, of the next text's first), and both likenesses.

    Next is by ascending id, null ids last, equal ids by a hash of the text, fully equal rows in
    any order; after the last row comes the first. A single row follows itself. A null text is
    empty; an empty text has likeness 1 to an empty one, 0 to any with words. An empty table
    gives no rows. Ids are dealt into ranges, and each range gets the row that follows it.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges)))
    where = F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(F.size(F.filter(F.lit(cuts).cast("array<double>"), lambda c: c <= F.col("doc_id")))) if cuts else F.lit(0)
    dealt = rows.withColumn("where", where.cast("int"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie")
    heads = dealt.groupBy("where").agg(F.min(order).alias("first")).orderBy("where").collect()  # one row a range
    if not heads:
        return spark.createDataFrame([], FORM)
    follow = [(h["first"]["doc_id"], h["first"]["tie"], heads[k - 1]["where"]) for k, h in enumerate(heads)]
    followers = spark.createDataFrame(follow, "_doc bigint, _tie bigint, _to int")
    extra = dealt.join(F.broadcast(followers), F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("tie").eqNullSafe(F.col("_tie"))).select(
        F.col("_to").alias("where"), F.lit(True).alias("extra"), "doc_id", "tie", "text"
    )
    stream = dealt.select("where", F.lit(False).alias("extra"), "doc_id", "tie", "text").unionByName(extra)
    placed = stream.repartition("where").sortWithinPartitions("where", "extra", F.col("doc_id").asc_nulls_last(), "tie")
    return placed.select("where", "extra", "doc_id", "text").mapInArrow(_compared, FORM)
