"""Counts of word n-grams over all notes, asked for by parts of the notes and answered in the same order.

Notes are dealt to parts by hash. A part sends each of its distinct n-grams once, as a
hash with its own counts, to the bucket that the hash's leading bits name; the bucket adds
up and answers each part in the order of its question, so an answer is counts alone. An
n-gram that a third of all notes hold is one entry per part, wherever it stands. A message
of few entries costs what a row of a shuffle would, so packing never loses.

A hash has 15 bits more than it takes to number all n-grams of the input: a count is too
large with a chance of one in thirty thousand, at every size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from motionframe.llm.words import hash_words

PART_BYTES = 4 << 20            # notes of one part; the number of parts follows the input
BYTES_PER_WORD = 6              # for sizing only
ENTRIES_PER_BUCKET = 2_000_000  # n-grams that one task merges
SPARE_BITS = 15
WORD_BITS = 8                   # that the hash of a word has besides, where words are told apart exactly

_CODEC = pa.Codec("zstd", 1)
_ASKED = "bucket long, part int, width int, size int, hashes binary, counts binary"
_ANSWERED = "part int, width int, bucket long, size int, counts array<binary>, kinds long, mass long"

# width of an n-gram -> (the part's distinct hashes in order, their counts)
Grams = Mapping[int, tuple[np.ndarray, np.ndarray]]


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers by byte place, compressed: places that are zero throughout cost nothing."""
    values = np.ascontiguousarray(values, np.uint64)
    places = (int(values.max(initial=0)).bit_length() + 7) // 8
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :places].T)
    return bytes([places]) + (_CODEC.compress(raw.tobytes(), asbytes=True) if places else b"")


def unpack(blob: bytes, size: int) -> np.ndarray:
    out = np.zeros((size, 8), np.uint8)
    places = blob[0]
    if places:
        raw = _CODEC.decompress(blob[1:], places * size, asbytes=True)
        out[:, :places] = np.frombuffer(raw, np.uint8).reshape(places, size).T
    return out.view(np.uint64).ravel()


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, how often each stands, and the index of every element's value."""
    by = np.argsort(hashes)
    ordered = hashes[by]
    new = np.ones(len(by), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    at = np.flatnonzero(new)
    index = np.empty(len(by), np.int64)
    index[by] = np.cumsum(new) - 1
    return ordered[at], np.diff(np.append(at, len(by))), index


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int = 1 << 20) -> np.ndarray:
    """`hash_words`, about `size` bytes at a time: its tables are eight times as large as the text."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + size, "right")))
        out[at:to] = hash_words(raw[low:int(ends[to - 1])], starts[at:to] - low, ends[at:to] - low)
        at = to
    return out


class Sizes:
    """Parts, buckets and hash widths for an input of so many bytes."""

    def __init__(self, n_bytes: int, widths: int, least_parts: int, exact: Sequence[int] = (), part_bytes: int = PART_BYTES):
        self.exact = exact
        words = max(1, n_bytes // BYTES_PER_WORD)
        self.parts = max(least_parts, -(-n_bytes // part_bytes))
        self.bucket_bits = max(0, (words * widths // ENTRIES_PER_BUCKET).bit_length())
        self.hash_bits = min(64, max(self.bucket_bits, (words * widths).bit_length()) + SPARE_BITS)

    def bits(self, width: int) -> int:
        return min(64, self.hash_bits + WORD_BITS) if width in self.exact else self.hash_bits

    def shorten(self, hashes: np.ndarray, width: int) -> np.ndarray:
        return hashes >> np.uint64(64 - self.bits(width))


def sizes_of(notes: DataFrame, column: str, widths: int, exact: Sequence[int] = (), part_bytes: int = PART_BYTES) -> Sizes:
    """Sizes for a column of notes with so many widths of n-grams; those of `exact` are told apart all."""
    n_bytes = notes.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return Sizes(n_bytes, widths, int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions")), exact, part_bytes)


def _ask(part: int, grams: Grams, sizes: Sizes) -> pa.Table:
    out = {"bucket": [], "part": [], "width": [], "size": [], "hashes": [], "counts": []}
    for width, (hashes, counts) in grams.items():
        bucket = (hashes >> np.uint64(sizes.bits(width) - sizes.bucket_bits)).astype(np.int64) if sizes.bucket_bits else (
            np.zeros(len(hashes), np.int64))
        names, at = np.unique(bucket, return_index=True)
        for name, start, stop in zip(names.tolist(), at.tolist(), [*at[1:].tolist(), len(hashes)]):
            own = hashes[start:stop]
            out["bucket"].append(name)
            out["part"].append(part)
            out["width"].append(width)
            out["size"].append(len(own))
            out["hashes"].append(pack(np.diff(own, prepend=np.uint64(name) << np.uint64(sizes.bits(width) - sizes.bucket_bits)
                                               if sizes.bucket_bits else np.uint64(0))))
            out["counts"].append(pack(counts[start:stop]))
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), types)})


def _merge(bucket: int, table: pa.Table, sizes: Sizes, ceiling: int | None, apart: int) -> pa.Table:
    out = {"part": [], "width": [], "bucket": [], "size": [], "counts": [], "kinds": [], "mass": []}
    rows = table.to_pylist()
    for width in sorted({r["width"] for r in rows}):
        own = [r for r in rows if r["width"] == width]
        base = np.uint64(bucket) << np.uint64(sizes.bits(width) - sizes.bucket_bits) if sizes.bucket_bits else np.uint64(0)
        hashes = np.concatenate([np.cumsum(unpack(r["hashes"], r["size"]), dtype=np.uint64) + base for r in own])
        ends = np.cumsum([r["size"] for r in own])
        found, _, index = distinct(hashes)
        sent = np.concatenate([unpack(r["counts"], r["size"]) for r in own]).astype(np.int64)
        total, others = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
        np.add.at(total, index, sent)
        if apart:
            away = np.repeat([r["part"] >= apart for r in own], [r["size"] for r in own])
            np.add.at(others, index[away], sent[away])
        for i, (r, start, stop) in enumerate(zip(own, [0, *ends[:-1].tolist()], ends.tolist())):
            told = [t[index[start:stop]] for t in ((total, others) if r["part"] < apart else (total,))]
            out["part"].append(r["part"])
            out["width"].append(width)
            out["bucket"].append(bucket)
            out["size"].append(r["size"])
            out["counts"].append([pack(t if ceiling is None else np.minimum(t, ceiling)) for t in told])
            out["kinds"].append(0 if i else int((total > 0).sum()))  # told to one part only
            out["mass"].append(0 if i else int(total.sum()))
    types = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.int64(), pa.int64())
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), types)})


class Answers:
    """What a part is told: counts per width in the order of its hashes.

    `kinds` and `mass` are, over all parts, the words that are counted at all and their
    counts added up.
    """

    def __init__(self, table: pa.Table):
        rows = sorted(table.to_pylist(), key=lambda r: (r["width"], r["bucket"]))
        self.rows = {w: [r for r in rows if r["width"] == w] for w in {r["width"] for r in rows}}
        self.kinds = sum(r["kinds"] for r in self.rows.get(1, ()))
        self.mass = sum(r["mass"] for r in self.rows.get(1, ()))

    def counts(self, width: int, others: bool = False) -> np.ndarray:
        found = [unpack(r["counts"][others], r["size"]) for r in self.rows.get(width, ())]
        return np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)


def _pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a batch by part, each part's as one compressed table."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
    for batch in batches:
        part = batch.column(batch.num_columns - 1).to_numpy()
        by = np.argsort(part, kind="stable")
        names, at = np.unique(part[by], return_index=True)
        packed = []
        for rows in np.split(by, at[1:]):
            own = pa.table(batch).select(range(batch.num_columns - 1)).take(pa.array(rows))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema, options=options) as out:
                out.write_table(own)
            packed.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(packed, pa.binary())], ["part", "rows"])


def _unpack_rows(table: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(blob).read_all() for blob in table["rows"].to_pylist()])


def count_and_tell(rows: DataFrame, grams: Callable[[pa.Table], Grams], use: Callable[[int, pa.Table, Answers], pa.Table],
                   schema, sizes: Sizes, ceiling: int | None = None, apart: int = 0) -> DataFrame:
    """Counts the n-grams of all parts and hands every part its rows with the counts of its own n-grams.

    `rows` has `part`, from 0 to `sizes.parts`, as its last column and is moved once,
    compressed: both passes read the same exchange. Counts above `ceiling` are told as the
    ceiling. Parts below `apart` are also told the counts over all parts from there on.
    """
    rows = rows.mapInArrow(_pack_rows, "part int, rows binary").repartition(sizes.parts, "part")
    asked = rows.groupBy("part").applyInArrow(lambda key, t: _ask(key[0].as_py(), grams(_unpack_rows(t)), sizes), _ASKED)
    answered = asked.groupBy("bucket").applyInArrow(
        lambda key, t: _merge(key[0].as_py(), t, sizes, ceiling, apart), _ANSWERED)
    return rows.groupBy("part").cogroup(answered.groupBy("part")).applyInArrow(
        lambda key, t, a: use(key[0].as_py(), _unpack_rows(t), Answers(a)), schema)
