"""Token ids of notes as Parquet list columns."""

from __future__ import annotations

import string
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from motionframe.llm.words import is_space, slices, text_bytes
from motionframe.session import scratch_dir, ship_package

END_ID = 0
PART_BYTES = 12 << 20           # notes per file; the number of files follows the input
ROW_GROUP_BYTES = 16 << 20      # several row groups per large file, each with its own dictionary
PAGE_BYTES = 256 << 10          # small pages: the page index lets a reader take few of them
PAGE_ROWS = 2_000
SLICE_BYTES = 6 << 20           # notes whose pieces are made distinct together
KNOWN_PIECES = 300_000          # pieces whose ids a Python worker keeps

_BLANKS = b" \t\n\r\x0b\f"
_LONG = 200  # bytes
_IS_MARK, _IS_ALNUM = (np.array([chr(b) in signs for b in range(256)]) for signs in
                       (string.punctuation, string.ascii_letters + string.digits))

# Fixed: how the files are written. Ids use 16-bit dictionary codes and keys delta
# codes (format 2 pages); pages carry column and offset indexes.
PARQUET_OPTIONS = {
    "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(1 << 20),
    "parquet.writer.version": "v2", "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES), "parquet.page.row.count.limit": str(PAGE_ROWS),
    "parquet.page.write-checksum.enabled": "true", "compression": "zstd"}

# Fixed: UTF-8 of the white space beyond ASCII, and the control characters that some count as space.
_WIDE_SPACES = [c.encode() for c in
                "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                "\u2028\u2029\u202f\u205f\u3000"]


def _odd_rows(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows that must not be cut at their spaces: spaces in a row, at the start, or of another kind."""
    space, single = is_space(raw), raw == 0x20
    bad = np.zeros(len(raw), bool)
    bad[1:] = single[1:] & space[:-1] | space[1:] & single[:-1]
    starts = bounds[:-1][bounds[:-1] < bounds[1:]]
    bad[starts] = single[starts]  # what stands in the row before does not matter
    for code in _WIDE_SPACES:
        at = np.flatnonzero(raw[:len(raw) - len(code) + 1] == code[0])
        for i, byte in enumerate(code[1:], 1):
            at = at[raw[at + i] == byte]
        bad[at] = True
    rows = np.searchsorted(bounds, np.flatnonzero(bad), "right") - 1
    odd = np.zeros(len(bounds) - 1, bool)
    odd[rows] = True
    return odd


def _rows_with(raw: np.ndarray, bounds: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Rows that hold one of the texts; a text over a boundary counts for the row it begins in."""
    found = np.zeros(len(bounds) - 1, bool)
    data = raw.tobytes() if texts else b""
    for text in texts:
        at = data.find(text)
        while at >= 0:
            row = np.searchsorted(bounds, at, "right") - 1
            found[row] = True
            at = data.find(text, bounds[row + 1])
    return found


def _split_marks(raw: np.ndarray, starts: np.ndarray, odd: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Cuts off up to four marks that close a piece behind a letter or digit: a token run of their own."""
    ends = np.append(starts[1:], len(raw))[:len(starts)]
    todo = np.flatnonzero(~odd[np.searchsorted(bounds, starts, "right") - 1])
    more = []
    for n in range(1, 5):
        at = ends[todo] - n
        todo, at = todo[at > starts[todo]], at[at > starts[todo]]
        todo, at = todo[_IS_MARK[raw[at]]], at[_IS_MARK[raw[at]]]
        more.append(at[_IS_ALNUM[raw[at - 1]]])
    return np.sort(np.concatenate([starts, *more]))


class PieceEncoder:
    """Ids of whole texts from a tokenizers file, each distinct piece encoded once.

    Byte-level splitting never joins what stands before a space with what stands after
    it. So a text is cut before single spaces between visible characters, before the marks
    that close a word and before the white space at its end, the library encodes each distinct piece, and the ids are put
    together. A text with any other spaces is one piece, and so is one that holds an added
    token of the file: the library looks for those before it splits.
    """

    def __init__(self, path: str, most: int = KNOWN_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.known = most, {}
        # byte-level vocabulary writes one character per byte
        self.widths = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.widths[i] = len(token)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        # pieces put side by side could make up an added token with a space
        self.joins = not any(b" " in t for t in self.added)

    def whole(self, text: bytes) -> bytes:
        ids = self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids
        return np.array(ids, "<u4").tobytes()

    def _encode_new(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, side by side, and their number for each.

        Pieces that begin with their only space are encoded many at a time, as one text
        that the next piece's space cuts; the others by themselves.
        """
        n = len(pieces)
        at = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset:pieces.offset + n + 1]
        data = np.frombuffer(pieces.buffers()[2], np.uint8)
        spaces = np.concatenate([[0], np.cumsum(data == 0x20)])
        second = data[np.minimum(at[:-1] + 1, at[1:] - 1)]
        plain = (data[at[:-1]] == 0x20) & (np.diff(spaces[at]) == 1) & ~is_space(data[at[1:] - 1]) & ~is_space(second)
        plain &= self.joins & ~_rows_with(data[at[0]:at[-1]], at - at[0], self.added)
        sizes = np.zeros(n, np.int64)
        rows, parts = np.flatnonzero(plain), []
        own = pieces.filter(pa.array(plain))
        ends = np.frombuffer(own.buffers()[1], np.int32)[own.offset:own.offset + len(own) + 1]
        text = np.frombuffer(own.buffers()[2], np.uint8)
        for a in range(0, len(rows), 2_000):
            part = ends[a:a + 2_001]
            ids = np.frombuffer(self.whole(text[part[0]:part[-1]].tobytes()), "<u4")
            stops = np.searchsorted(np.cumsum(self.widths[ids]), part[1:] - part[0]) + 1
            sizes[rows[a:a + 2_000]] = np.diff(stops, prepend=0)
            parts.append(ids)
        rest = np.flatnonzero(~plain)
        for row in rest.tolist():
            ids = np.frombuffer(self.whole(pieces[row].as_py()), "<u4")
            sizes[row] = len(ids)
            parts.append(ids)
        # back from plain ones first to the order of the pieces
        order = np.concatenate([rows, rest])
        begin = np.zeros(n, np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        return _gather(np.concatenate(parts) if parts else np.zeros(0, np.uint32), begin, sizes), sizes

    def encode(self, raw: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """List offsets and ids of the rows in `raw`, each closed by `end_id`."""
        rows = len(bounds) - 1
        if len(self.known) > self.most:
            self.known.clear()
        cut = raw == 0x20
        odd = _odd_rows(raw, bounds) | _rows_with(raw, bounds, self.added)
        for row in np.flatnonzero(odd):
            cut[bounds[row]:bounds[row + 1]] = False
        # the white space at a row's end is cut off as one piece
        filled = np.flatnonzero(bounds[:-1] < bounds[1:])
        blank = is_space(raw)
        for row in filled[blank[bounds[filled + 1] - 1] & ~odd[filled]]:
            body = len(raw[bounds[row]:bounds[row + 1]].tobytes().rstrip(_BLANKS))
            cut[bounds[row] + body:bounds[row + 1]] = False
            cut[bounds[row] + min(body, bounds[row + 1] - bounds[row] - 1)] |= body > 0
        cut[bounds[filled]] = True
        starts = _split_marks(raw, np.flatnonzero(cut), odd, bounds)
        # pieces stand side by side, so the bytes are their column as they are
        ends = np.append(starts, len(raw)).astype(np.int32)
        column = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).dictionary_encode()
        which, distinct = column.indices.to_numpy(), column.dictionary
        found = list(map(self.known.get, distinct.to_pylist()))
        new = np.flatnonzero(np.array([f is None for f in found], bool))
        flat, sizes = np.zeros(0, np.uint32), np.zeros(len(found), np.int64)
        if len(found):
            fresh = distinct.take(pa.array(new))
            flat, own = self._encode_new(fresh)
            self._keep(fresh, flat, own, np.bincount(which, minlength=len(found))[new])
            sizes[:] = [0 if f is None else len(f) >> 2 for f in found]
            sizes[new] = own
        # ids of known pieces, then of new ones, then the end of a row: one more piece behind its last
        kept = np.frombuffer(b"".join([f for f in found if f is not None]), "<u4")
        flat = np.concatenate([kept, flat, [np.uint32(end_id)]]).astype(np.uint32, copy=False)
        known = np.ones(len(found), bool)
        known[new] = False
        begin = np.zeros(len(found) + 1, np.int64)
        begin[:-1][known] = np.cumsum(sizes[known]) - sizes[known]
        begin[:-1][new] = len(kept) + np.cumsum(sizes[new]) - sizes[new]
        begin[-1] = len(flat) - 1
        sizes = np.append(sizes, 1)
        firsts = np.searchsorted(starts, bounds)
        order = np.insert(which, firsts[1:], len(found))
        upto = np.cumsum(sizes[order])
        offsets = np.concatenate([[0], upto[firsts[1:] + np.arange(rows)]]) if rows else np.zeros(1, np.int64)
        return offsets, _gather(flat, begin[order], sizes[order])

    def _keep(self, pieces: pa.Array, ids: np.ndarray, sizes: np.ndarray, times: np.ndarray) -> None:
        """Remembers the pieces that a batch has more than once."""
        raw, ends = ids.tobytes(), np.cumsum(sizes) * 4
        often = np.flatnonzero(times > 1)
        for piece, a, b in zip(pieces.take(pa.array(often)).to_pylist(), (ends - sizes * 4)[often].tolist(), ends[often].tolist()):
            if len(piece) <= _LONG:
                self.known[piece] = raw[a:b]


def _gather(flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs flat[begin:begin + size], one behind the other."""
    upto = np.cumsum(sizes)
    total = int(upto[-1]) if len(upto) else 0
    return flat[np.repeat(begin - (upto - sizes), sizes) + np.arange(total)]


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder per Python worker: what it has learnt serves its later tasks too."""
    return PieceEncoder(path)


def write_token_ids(runs: DataFrame, path: str, tokenizer: str, *, key: str = "run_id", notes: str = "notes",
                    end_id: int = END_ID) -> None:
    """Writes (key, ids, part, pos) in ascending key order as Parquet list columns.

    Every note (NULL: empty) is encoded whole, without special tokens, and ends with
    `end_id`. A range exchange on the key gives one file per range; files are sorted
    and `part` and `pos` state their global order, NULL keys first. Keys that repeat are
    kept, longer notes later. Reading only keys or lengths leaves the id pages untouched,
    and the page index finds the pages of a key range.
    """
    spark = runs.sparkSession
    ship_package(spark)
    rows = runs.select(F.col(key).alias(key), F.coalesce(F.col(notes), F.lit("")).alias("notes"))
    size = rows.agg(F.sum(F.octet_length("notes"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    order = [F.asc_nulls_first(key), F.octet_length("notes")]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, F.xxhash64("notes"))
    schema = rows.select(key, F.lit(None).cast("array<int>").alias("ids"), F.lit(0).cast("long").alias("n_tokens"),
                         F.lit(0).alias("pos")).schema

    def tasks(batches):
        encoder, pos = piece_encoder(tokenizer), 0
        for batch in batches:
            for notes, keys in slices(batch.column(1), batch.column(0), SLICE_BYTES):
                ends, ids = encoder.encode(*text_bytes(notes), end_id)
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [keys, column, pa.array(np.diff(ends)), pa.array(np.arange(pos, pos + len(keys), dtype=np.int32))],
                    [key, "ids", "n_tokens", "pos"])
                pos += len(keys)

    out = rows.mapInArrow(tasks, schema).withColumn("part", F.spark_partition_id())
    out.write.mode("overwrite").options(**PARQUET_OPTIONS).parquet(path)


def _file_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, ahead): ids in all files before each, from the small column of lengths."""
    files = spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    ahead = F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    return files.select("part", F.coalesce(ahead, F.lit(0)).alias("ahead"))


def _with_start(rows: DataFrame, files: DataFrame, key: str, more: list[str]) -> DataFrame:
    local = F.sum("n_tokens").over(W.partitionBy("part").orderBy("pos").rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("local", F.coalesce(local, F.lit(0))).join(files, "part")
    return rows.select(key, (F.col("ahead") + F.col("local")).cast("long").alias("start"), "n_tokens", *more)


def read_token_index(spark: SparkSession, path: str, *, key: str = "run_id") -> DataFrame:
    """One row (key, start, n_tokens) per written note; the ids themselves are not read.

    `start` is the number of ids before the note in the global order. One row per file
    is summed up in order; within a file, positions order the rows.
    """
    rows = spark.read.parquet(path).select(key, "part", "pos", "n_tokens")
    return _with_start(rows, _file_starts(spark, path), key, [])


def read_token_digests(spark: SparkSession, path: str, *, key: str = "run_id") -> DataFrame:
    """As `read_token_index`, with `ids_crc32` over the ids as little-endian unsigned 32-bit integers.

    Here n_tokens is counted from the ids.
    """
    ship_package(spark)
    table = spark.read.parquet(path).select(key, "part", "pos", "ids")
    schema = table.select(key, "part", "pos", F.lit(0).cast("long").alias("n_tokens"),
                          F.lit(0).cast("long").alias("ids_crc32")).schema

    def tasks(batches):
        for batch in batches:
            ids = batch.column(3)
            ends = ids.offsets.to_numpy()
            values = ids.values.to_numpy().astype("<i4", copy=False)
            crc = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())],
                [key, "part", "pos", "n_tokens", "ids_crc32"])

    return _with_start(table.mapInArrow(tasks, schema), _file_starts(spark, path), key, ["ids_crc32"])


def token_ids(runs: DataFrame, tokenizer: str, path: str | None = None, *, key: str = "run_id",
              notes: str = "notes", end_id: int = END_ID) -> DataFrame:
    """Writes the notes' token ids and reads them back: (key, start, n_tokens, ids_crc32) per input row.

    Without a path the files go to a fresh folder below the session's shared one. NULL
    notes hold the end id alone. An empty table gives no rows. Other columns are ignored.
    """
    spark = runs.sparkSession
    path = path or scratch_dir(spark, "token-ids")
    write_token_ids(runs, path, tokenizer, key=key, notes=notes, end_id=end_id)
    return read_token_digests(spark, path, key=key)
