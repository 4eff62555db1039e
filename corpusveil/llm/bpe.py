"""Byte-level BPE over a global shuffle of distinct words.

Texts are taken in chunks of bounded size. A chunk's pre-tokens become positions (numbers of
its distinct words, in text order) and its distinct words, dealt by hash. Words meet by
hash, each distinct one is encoded once, and the ids go back to the chunks that asked for
them, where the positions put them in order. A word travels once per chunk and not once
per occurrence: a row per occurrence would be some twenty times the corpus.

Decoding joins ids with the token-byte table, whose size is the vocabulary's.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk at most; a longer text is a chunk of its own.
CHUNK = 8_000_000
#: Parts into which words are dealt; a part's distinct words are held by one task at a time.
BUCKETS = 512


@lru_cache(2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


@lru_cache(2)
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


@lru_cache(2)
def token_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes by id, one after the other, and where each begins."""
    ranks = read_ranks(path)
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum([0, *map(len, tokens)])


def gather(flat: np.ndarray, begin: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[begin[i]:begin[i + 1]] for each i of index, joined, and the lengths."""
    sizes = begin[index + 1] - begin[index]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(begin[index] - (ends - sizes), sizes)], sizes


def _packed(*arrays: np.ndarray) -> bytes:
    sizes = np.array([len(arrays), *(a.nbytes for a in arrays)], "<i8")
    return zstandard.compress(sizes.tobytes() + b"".join(a.tobytes() for a in arrays), 3)


def _unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    sizes = np.frombuffer(raw, "<i8", len(kinds), 8)
    ends = np.cumsum(sizes) + 8 * (len(kinds) + 1)
    return [np.frombuffer(raw[e - s : e], kind) for e, s, kind in zip(ends, sizes, kinds)]


def _chunked(pattern: str, want_words: bool, chunk_chars: int, buckets: int):
    """Batches of (doc_id, text) -> (chunk, bucket, data): a chunk's words of one bucket, or its
    positions. A chunk's name is a digest of its rows, so both calls name it alike."""
    split = regex.compile(pattern)

    def rows_of(docs: list[tuple[int | None, str]]):
        name, number, places, sizes = hashlib.blake2b(digest_size=8), {}, [], []
        for doc, text in docs:
            name.update(f"{doc}:{len(text)}:".encode() + text.encode("utf-8", "surrogatepass"))
            found = [number.setdefault(w, len(number)) for w in split.findall(text)]
            places.append(np.array(found, "<u4"))
            sizes.append(len(found))
        chunk = int.from_bytes(name.digest(), "little", signed=True)
        encoded = [w.encode() for w in number]
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in encoded), np.uint16, len(encoded))
        if not want_words:
            ids = np.array([0 if d is None else d for d, _ in docs], "<i8")
            known = np.array([d is not None for d, _ in docs], "<u1")
            yield chunk, -1, _packed(ids, known, np.array(sizes, "<i8"), np.concatenate(places) if places else np.zeros(0, "<u4"), bucket)
            return
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        for part in np.split(order, cuts) if len(order) else []:
            mine = [encoded[i] for i in part]
            yield chunk, int(bucket[part[0]]), _packed(np.array([len(w) for w in mine], "<u4"), np.frombuffer(b"".join(mine), np.uint8))

    def run(batches):
        docs, chars = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                if docs and chars + len(text) > chunk_chars:
                    yield _batch(rows_of(docs))
                    docs, chars = [], 0
                docs.append((doc, text))
                chars += len(text)
        if docs:
            yield _batch(rows_of(docs))

    return run


def _batch(rows) -> pa.RecordBatch:
    chunk, bucket, data = zip(*rows) if (rows := list(rows)) else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(bucket, pa.int32()), pa.array(data, pa.binary())], ["chunk", "bucket", "data"])


def _encoded(path: str, pattern: str):
    """Rows (chunk, bucket, words), a bucket's rows in a row -> (chunk, bucket, ids of its words in order)."""

    def run(batches):
        encode, known, at = _encoding(path, pattern).encode_ordinary, {}, None
        for batch in batches:
            out = []
            for chunk, bucket, data in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != at:
                    known, at = {}, bucket
                sizes, raw = _unpacked(data, "<u4", "u1")
                text, ends = raw.tobytes(), np.cumsum(sizes).tolist()
                ids = []
                for start, end in zip([0, *ends], ends):
                    word = text[start:end]
                    found = known.get(word)
                    if found is None:
                        found = known[word] = np.array(encode(word.decode()), "<u4")
                    ids.append(found)
                out.append((chunk, bucket, _packed(np.array([len(x) for x in ids], "<u4"), np.concatenate(ids) if ids else np.zeros(0, "<u4"))))
            yield _batch(out)

    return run


def _reassembled(batches):
    """Rows of a chunk in a row, its buckets before its positions -> (doc_id, n_tokens, ids)."""
    at, parts = None, {}
    for batch in batches:
        for chunk, bucket, data in zip(*(c.to_pylist() for c in batch.columns)):
            if chunk != at:
                at, parts = chunk, {}
            if bucket >= 0:
                parts[bucket] = _unpacked(data, "<u4", "<u4")
                continue
            docs, known, sizes, places, of = _unpacked(data, "<i8", "u1", "<i8", "<u4", "<u2")
            wanted, words = np.unique(of, return_counts=True)
            if any(b not in parts or len(parts[b][0]) != n for b, n in zip(wanted.tolist(), words.tolist())):
                raise ValueError("the texts changed between two reads of the table: pass a stored table")
            counts = np.concatenate([parts[b][0] for b in wanted.tolist()]) if len(wanted) else np.zeros(0, "<u4")
            flat = np.concatenate([parts[b][1] for b in wanted.tolist()]) if len(wanted) else np.zeros(0, "<u4")
            # words came back by bucket; `begin` is by the chunk's own numbers
            order = np.argsort(of, kind="stable")
            by_bucket = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            flat, own = gather(flat, by_bucket, np.argsort(order, kind="stable"))
            begin = np.concatenate([[0], np.cumsum(own, dtype=np.int64)])
            edges = np.concatenate([[0], np.cumsum(sizes)])
            for low in range(0, len(docs), 1000):
                high = min(len(docs), low + 1000)
                ids, lengths = gather(flat, begin, places[edges[low] : edges[high]].astype(np.int64))
                sums = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
                stops = sums[edges[low : high + 1] - edges[low]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs[low:high], pa.int64(), mask=known[low:high] == 0),
                        pa.array(np.diff(stops), pa.int64()),
                        pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(stops, stops[1:])], pa.binary()),
                    ],
                    ["doc_id", "n_tokens", "ids"],
                )


def encode(
    df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK, buckets: int = BUCKETS
) -> DataFrame:
    """(doc_id, n_tokens, ids) for every row: BPE ids of the whole text by the rank file, each match
    of the pattern by itself, no special tokens; ids are little-endian 32-bit numbers.

    df is read twice, so it must be a stored table. A null or empty text has no ids; null and
    repeated ids stay; an empty table gives no rows; other columns are ignored.
    """
    ship_rows = "chunk bigint, bucket int, data binary"
    texts = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    words = texts.mapInArrow(_chunked(pattern, True, chunk_chars, buckets), ship_rows)
    ids = words.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_encoded(path, pattern), ship_rows)
    positions = texts.mapInArrow(_chunked(pattern, False, chunk_chars, buckets), ship_rows)
    met = ids.unionByName(positions).repartition("chunk").sortWithinPartitions("chunk", F.desc("bucket"))
    return met.mapInArrow(_reassembled, "doc_id bigint, n_tokens bigint, ids binary")


def decode(df: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes of its ids: each id joined with its row of the token-byte table. Null
    ids give null; an id beyond the table is an error."""

    def run(batches):
        flat, begin = token_table(path)
        for batch in batches:
            place = batch.schema.get_field_index(ids_col)
            texts = [None if x is None else gather(flat, begin, np.frombuffer(x, "<u4").astype(np.int64))[0].tobytes() for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], [*batch.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{out}` binary")
