"""Encoding of a corpus with a public tokenizer, reusing chunks that documents share.

Texts are cut into chunks where a rolling hash of the last bytes says so, at the white space between words; equal passages
of different documents, such as revisions of a page, give equal chunks. Each distinct chunk is encoded once. The documents' lists
of chunk ids are then joined. A cut between a printable ASCII character and white space is a boundary of the tokenizer's own
words, so the join is exact as it stands. Where a text offers no such place, it is cut by the hash anywhere, and the join is repaired: the ids around it are
decoded up to the nearest sure boundary on either side and encoded again, over as many chunks as it takes.

Chunking and encoding run as Arrow batches over whole partitions; deduplication, joins and the concatenation of lists stay in the JVM.

Defined cases: null and empty texts give an empty list. Special tokens in a text are ordinary text. Texts of any length are encoded whole. Repeated texts share all
their chunks. Rows with the same id, or none, stay separate rows. Bytes that are no UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.session import ship, written

#: Where the public vocabularies lie; and the one used.
FOLDER, NAME = os.environ.get("LOOMGRID_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of byte_bpe_50k.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Chunks: bytes hashed, one cut in so many words, least and most bytes.
WINDOW, EVERY, LEAST, MOST = 16, 64, 96, 8192


@lru_cache(maxsize=2)
def encoding(folder: str = FOLDER, name: str = NAME):
    import tiktoken

    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)


def _hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The polynomial hash of the WINDOW bytes before each of some places (of fewer at the start)."""
    h = np.zeros(len(at), np.uint32)
    for k in range(WINDOW):
        place = at - 1 - k
        h += np.where(place >= 0, _GEAR[data[np.maximum(place, 0)]], np.uint32(0)) << np.uint32(k)
    return h >> np.uint32(8)


def cuts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[list[int]], list[list[bool]]]:
    """For each text (bytes starts to ends of data), the ends of its chunks and whether each is a sure boundary of words."""
    white = (data == 32) | (data == 10)
    printable = (data > 32) & (data < 127)
    sure = np.flatnonzero(printable[:-1] & white[1:]) + 1
    chosen = sure[_hashes(data, sure) % np.uint32(EVERY) == 0]
    lows, highs = np.searchsorted(chosen, starts).tolist(), np.searchsorted(chosen, ends).tolist()
    picked = chosen.tolist()
    all_cuts, all_sure = [], []
    for s, e, lo, hi in zip(starts.tolist(), ends.tolist(), lows, highs):
        at, ok, last = [], [], s
        for c in [*picked[lo:hi], e]:
            if c < e and (c - last < LEAST or e - c < LEAST):
                continue
            while c - last > MOST:
                a, z = np.searchsorted(sure, (last + LEAST, last + MOST))
                good = bool(z > a)
                places = sure[a:z] if good else last + LEAST + np.flatnonzero((data[last + LEAST : last + MOST] & 0xC0) != 0x80)
                last = int(places[np.argmin(_hashes(data, places))])
                at.append(last)
                ok.append(good)
            if c > last:
                at.append(c)
                ok.append(True)
                last = c
        all_cuts.append(at)
        all_sure.append(ok)
    return all_cuts, all_sure


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, row) to (doc_id, row, seq, h1, h2, sure, chunk): chunk is null where the task has given it before."""
    import xxhash

    digest, seen = xxhash.xxh3_128_intdigest, set()
    for b in batches:
        texts = b.column(1).cast(pa.large_binary())
        docs, numbers = b.column(0).to_pylist(), b.column(2).to_pylist()
        raw = texts.buffers()
        offsets = np.frombuffer(raw[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts) or offsets[-1] == offsets[0]:
            continue
        data = np.frombuffer(raw[2], np.uint8)[: offsets[-1]]
        ends, sure = cuts(data, offsets[:-1], offsets[1:])
        view = memoryview(raw[2])
        ids, rows, seqs, ones, twos, flags, chunks = [], [], [], [], [], [], []
        for doc, row, start, at, good in zip(docs, numbers, offsets.tolist(), ends, sure):
            k = 0
            for end, ok in zip(at, good):
                piece = bytes(view[start:end])
                x = digest(piece)
                ids.append(doc)
                rows.append(row)
                seqs.append(k)
                ones.append((x >> 64) - (1 << 63))
                twos.append((x & (1 << 64) - 1) - (1 << 63))
                flags.append(ok)
                if x in seen:
                    chunks.append(None)
                else:
                    seen.add(x)
                    chunks.append(piece)
                k += 1
                start = end
        if len(seen) > 2_000_000:
            seen.clear()
        arrays = [pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(seqs, pa.int32()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), pa.array(flags, pa.bool_()), pa.array(chunks, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "row", "seq", "h1", "h2", "sure", "chunk"])


def _width(e) -> np.dtype:
    return np.dtype("<u2") if e.n_vocab < 0xFFFF else np.dtype("<u4")


def _encoder(folder: str, name: str):
    """A column function: the ids of chunks, packed."""
    @F.pandas_udf("binary")
    def encode(chunks: pd.Series) -> pd.Series:
        e = encoding(folder, name)
        kind, ordinary = _width(e), e._core_bpe.encode_ordinary
        return pd.Series([np.array(ordinary(x.decode(errors="replace")), kind).tobytes() for x in chunks])

    return encode


def _unpacker(folder: str, name: str):
    """(doc_id, packed) to (doc_id, ids). The largest number marks an unsure cut."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(folder, name)
        kind = _width(e)
        mark = np.iinfo(kind).max
        for b in batches:
            lists = []
            for x in b.column(1):
                ids = np.frombuffer(x.as_buffer(), kind)
                marks = np.flatnonzero(ids == mark)
                if len(marks):
                    parts = [p[p != mark].tolist() for p in np.split(ids, marks)]
                    ids = np.array(repaired(parts, [False] * len(marks) + [True], e), kind)
                lists.append(ids)
            lengths = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.concatenate(lists).astype(np.int32) if lists else np.zeros(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])

    return unpack


#: A letter or digit before anything printable of another kind, or anything printable before white space: words of the pattern end here.
_SURE = re.compile(r"[A-Za-z](?=[^\w'\s]|\s)|[0-9](?=[^\w\s]|\s)|[!-~](?=\s)")


def repaired(parts: list[list[int]], sure: list[bool], e) -> list[int]:
    """The ids of a text from those of its chunks; sure[i]: whether the end of chunk i is a boundary of words."""
    out: list[int] = []
    pending: list[list[int]] = []
    for ids, ok in zip(parts, sure):
        pending.append(ids)
        if ok:
            if len(pending) == 1:
                out += ids
            else:
                out += _joined(pending, e)
            pending = []
    return out + (_joined(pending, e) if pending else [])


def _joined(parts: list[list[int]], e) -> list[int]:
    """Joins chunks at unsure cuts: left ids up to the last sure boundary stay, the rest is encoded again with the next chunk up to its first one."""
    done: list[int] = []
    open_ids = parts[0]
    for nxt in parts[1:]:
        left, right = e.decode_bytes(open_ids).decode(), e.decode_bytes(nxt).decode()
        ends = [m.end() for m in _SURE.finditer(left)]
        start = _SURE.search(right)
        a, z = (ends[-1] if ends else 0), (start.end() if start else len(right))
        kept = len(open_ids) - len(e.encode_ordinary(left[a:]))
        tail = len(e.encode_ordinary(right[:z]))
        done += open_ids[:kept]
        open_ids = e.encode_ordinary(left[a:] + right[:z]) + list(nxt[tail:])
    return done + list(open_ids)


def encode_corpus(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """(doc_id, ids) of every document."""
    ship(documents.sparkSession)
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    chunks = written(rows.filter("text is not null and text <> ''").withColumn("row", F.monotonically_increasing_id()).mapInArrow(_chunks, "doc_id long, row long, seq int, h1 long, h2 long, sure boolean, chunk binary"))
    distinct = chunks.groupBy("h1", "h2").agg(F.first("chunk", ignorenulls=True).alias("chunk"), F.count(F.lit(1)).alias("uses"))
    # a chunk that makes up more than a thousandth of all is joined by broadcast: there are less than a thousand of them, of MOST bytes at most
    often = max(1000, chunks.count() // 1000)
    encode = _encoder(folder, name)
    parts = lambda which: distinct.filter(which).select("h1", "h2", encode("chunk").alias("part"))
    used = chunks.select("doc_id", "row", "seq", "h1", "h2", "sure")
    frequent = F.broadcast(parts(F.col("uses") > often))
    rare = used.join(frequent.select("h1", "h2"), ["h1", "h2"], "left_anti").join(parts(F.col("uses") <= often), ["h1", "h2"])
    joined = used.join(frequent, ["h1", "h2"]).unionByName(rare)
    mark = F.unhex(F.lit("FF" * _width(encoding(folder, name)).itemsize))
    packed = joined.select("doc_id", "row", "seq", F.when(F.col("sure"), F.col("part")).otherwise(F.concat("part", mark)).alias("part"))
    encoded = packed.groupBy("doc_id", "row").agg(F.expr("listagg(part) within group (order by seq)").alias("packed")).select("doc_id", "packed").mapInArrow(_unpacker(folder, name), "doc_id long, ids array<int>")
    empty = rows.filter("text is null or text = ''").select("doc_id", F.expr("cast(array() as array<int>)").alias("ids"))
    return encoded.unionByName(empty)


def count_tokens(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """(doc_id, keep..., tokens): sizes of texts in tokens, in one pass without any shuffle."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(folder, name)
        for b in batches:
            n = [len(e._core_bpe.encode_ordinary(t.decode(errors="replace"))) if t else 0 for t in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*b.schema.names[:-1], "tokens"])

    ship(documents.sparkSession)
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), *keep, F.col(text).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(sizes, schema + ", tokens long")
