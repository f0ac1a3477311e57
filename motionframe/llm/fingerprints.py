"""Near-duplicate notes: SimHash fingerprints linked by meet-in-the-middle ball hashing."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from motionframe.llm.words import free_name, row_id, text_bytes
from motionframe.session import materialize, ship_package

RADIUS = 3                     # differing bits of a link
SHINGLE = 3                    # words
SEED = 42                      # of XXH64
LEAST_BITS = 7                 # 128 buckets at least: what is sent grows in proportion up to there
VARIANTS_PER_TASK = 3_000_000  # variants that one bucket makes; the number of buckets follows the input

_BITS = 64


def fingerprint(text: bytes) -> int:
    """SimHash of one note in UTF-8, as an unsigned integer.

    A-Z are lower-cased, words are separated by ASCII white space, shingles are three
    words joined by spaces (fewer words: all of them; no word: fingerprint 0).
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > SHINGLE:
        starts, ends = starts[:-(SHINGLE - 1)], ends[SHINGLE - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())], "<u8")
    ones = np.zeros(_BITS, np.int64)
    for at in range(0, len(hashes), 50_000):  # counts of a part fit 16 bits
        part = hashes[at:at + 50_000].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    bits = ones * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def note_fingerprints(runs: DataFrame, *, key: str = "run_id", notes: str = "notes", row: str | None = None) -> DataFrame:
    """One row (k, fp) per run, with the column `row` if it is named; `fp` holds the 64 bits as a signed long."""
    ship_package(runs.sparkSession)
    more = [F.col(row).alias("row")] if row else []
    rows = runs.select(F.col(key).alias("k"), *more, F.col(notes).alias("notes"))
    schema = rows.select("k", *more and ["row"], F.lit(0).cast("long").alias("fp")).schema

    def tasks(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for at in range(0, len(table), 1024):
                part = table.slice(at, 1024)
                raw, bounds = text_bytes(part["notes"].combine_chunks())
                raw = raw.tobytes()
                fps = [fingerprint(raw[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*[c.combine_chunks() for c in part.columns[:-1]], pa.array(np.array(fps, np.uint64).view(np.int64))],
                    schema.names)

    return rows.mapInArrow(tasks, schema)


@lru_cache(maxsize=1)
def flips() -> tuple[np.ndarray, np.ndarray]:
    """Patterns within half the radius: up to one flipped bit, and exactly two."""
    one = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(_BITS, dtype=np.uint64)])
    i, j = np.triu_indices(_BITS, 1)
    two = (np.uint64(1) << i.astype(np.uint64)) | (np.uint64(1) << j.astype(np.uint64))
    return one, two


def _slot(x: np.ndarray, bits: int) -> np.ndarray:
    """Bucket of a variant: `bits` parities, linear over XOR, so slot(f ^ m) = slot(f) ^ slot(m)."""
    out = np.zeros(x.shape, np.int64)
    rng = np.random.RandomState(7)
    for b in range(bits):
        mask = np.uint64(rng.randint(0, 2**32)) << np.uint64(32) | np.uint64(rng.randint(0, 2**32))
        out |= (np.bitwise_count(x & mask).astype(np.int64) & 1) << b
    return out


def _reach(bits: int) -> np.ndarray:
    """Slots that the variants of fingerprint 0 reach (those of f: XOR its own slot)."""
    one, two = flips()
    return np.unique(_slot(np.concatenate([one, two]), bits))


def _variants(fps: np.ndarray, bucket: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The variants of the fingerprints that belong to one bucket: value, index of its fingerprint, near flag.

    Even and odd fingerprints differ in an odd number of bits, equal ones in an even
    number. So a distance of 3 has one side of each parity: the even side goes one step,
    the odd side two. A distance of up to 2 is met with one step from both sides.
    """
    one, two = flips()
    odd = np.bitwise_count(fps) % 2 == 1
    slots = _slot(fps, bits)
    value, index, near = [], [], []
    for steps, rows, close in ((one, np.arange(len(fps)), True), (two, np.flatnonzero(odd), False)):
        wanted = _slot(steps, bits)
        by = np.argsort(slots[rows], kind="stable")
        rows = rows[by]
        classes, at = np.unique(slots[rows], return_index=True)
        for c, group in zip(classes.tolist(), np.split(rows, at[1:])):
            pick = steps[wanted == c ^ bucket]
            value.append((fps[group][:, None] ^ pick[None, :]).ravel())
            index.append(np.repeat(group, len(pick)).astype(np.int32))
            near.append(np.full(len(group) * len(pick), close))
    return np.concatenate(value), np.concatenate(index), np.concatenate(near)


def links_in_bucket(fps: np.ndarray, bucket: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join, in one bucket, all fingerprints which share a variant and differ in at most RADIUS bits.

    Around a variant, members one step away are within 2 bits of each other and within 3
    of members two steps away, so a star from the smallest near member joins them without
    listing pairs. Members two steps away from each other meet elsewhere if they link.
    """
    value, index, near = _variants(fps, bucket, bits)
    order = np.argsort(value)
    value = value[order]
    head = np.concatenate([[True], value[1:] != value[:-1]]) if len(value) else np.zeros(0, bool)
    at = np.flatnonzero(head)
    many = np.diff(np.append(at, len(value))) > 1
    if not many.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    group = np.cumsum(head) - 1
    keep = many[group]
    order, group = order[keep], group[keep]
    member, close = fps[index[order]], near[order]
    centre = np.full(len(at), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(centre, group[close], member[close])
    has_near = np.zeros(len(at), bool)
    has_near[group[close]] = True
    a, b = member, centre[group]
    ok = has_near[group] & (a != b)
    a, b = a[ok], b[ok]
    ok = np.bitwise_count(a ^ b) <= RADIUS  # verified, though the star implies it
    pairs = np.unique(np.stack([a[ok], b[ok]], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) among distinct fingerprints `fp`, enough to connect all within RADIUS bits.

    Each fingerprint goes to every bucket that holds one of its variants, once, packed
    with others; the bucket makes the variants again and groups them. This is the
    shuffle on variants with the shared part of their bits sent once. There are as many
    buckets as keep a task at VARIANTS_PER_TASK, and no fingerprint goes to more of them
    than it has variants.
    """
    ship_package(prints.sparkSession)
    n = prints.count()
    per_print = len(flips()[0]) + len(flips()[1]) / 2
    bits = max(LEAST_BITS, int(np.ceil(np.log2(max(1.0, n * per_print / VARIANTS_PER_TASK)))))
    reach = _reach(bits)

    def send(batches):
        for batch in batches:
            f = batch.column("fp").to_numpy().view(np.uint64)
            buckets = (_slot(f, bits)[:, None] ^ reach[None, :]).ravel()
            by = np.argsort(buckets, kind="stable")
            names, at = np.unique(buckets[by], return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(by)), pa.int32()),
                                             pa.array(f[by // len(reach)].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(names), lists], ["bucket", "fps"])

    def meet(key, table):
        fps = np.unique(table["fps"].combine_chunks().flatten().to_numpy()).view(np.uint64)
        a, b = links_in_bucket(fps, key[0].as_py(), bits)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    sent = prints.mapInArrow(send, "bucket long, fps array<long>")
    return sent.groupBy("bucket").applyInArrow(meet, "a long, b long").distinct()


def smallest_reachable(nodes: DataFrame, links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Adds to each node (node, own) the smallest `own` among all nodes that it reaches.

    Alternating large and small stars shorten every component to a star in a number of
    rounds that grows with the logarithm of its width. Each round is written to the
    shared folder, so a lost executor costs one round.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .where("u <> v").distinct())
    before = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours move to the smallest one
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: smaller neighbours and the node itself move to the smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if before == state:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    root = F.coalesce("v", "node")
    rooted = nodes.join(edges, F.col("node") == F.col("u"), "left").select("node", "own", root.alias("root"))
    best = rooted.groupBy("root").agg(F.min("own").alias("best"))
    return rooted.join(best, "root").select("node", "own", "best", "root")


def _classes(prints: DataFrame) -> DataFrame:
    """(node, own, best, root) per distinct fingerprint of (k, fp): its smallest key and its component's."""
    nodes = materialize(prints.groupBy(F.col("fp").alias("node")).agg(F.min("k").alias("own")))
    links = fingerprint_links(nodes.select(F.col("node").alias("fp")))
    return smallest_reachable(nodes, links)


def near_duplicate_notes(runs: DataFrame, *, key: str = "run_id", notes: str = "notes") -> DataFrame:
    """Fingerprint and component of the notes of every run.

    Returns (key, fingerprint, component_id) per input row: the SimHash over 3-word
    shingles as 16 lower-case hex digits, and the smallest key reachable over links of
    at most 3 differing bits, itself included. NULL and wordless notes have fingerprint
    zero and link like any other. Equal fingerprints are one node, so copies never make
    pairs. NULL keys get a row; they are a component's id only where it has no other
    key. Repeated rows are kept, other columns ignored, an empty table gives no rows.
    """
    prints = materialize(note_fingerprints(runs, key=key, notes=notes))
    classes = _classes(prints)
    return prints.join(classes, F.col("fp") == F.col("node")).select(
        F.col("k").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("best").alias("component_id"))


def one_note_of_each_group(runs: DataFrame, *, key: str = "run_id", notes: str = "notes") -> DataFrame:
    """Runs with one kept of each near-duplicate component: the smallest key, NULL last, then the smallest row hash.

    All columns stay. Which row stays is decided on narrow rows; the notes move once, to
    meet the kept rows. Rows that are equal in all columns are one.
    """
    own = free_name(runs.columns, "_row")
    rows = runs.withColumn(own, row_id(runs.columns))
    prints = materialize(note_fingerprints(rows, key=key, notes=notes, row=own))
    classes = _classes(prints)
    turn = F.struct(F.col("k").isNull().alias("last"), "k", "row")
    kept = prints.join(classes, F.col("fp") == F.col("node")).groupBy("root").agg(F.min(turn).alias("t"))
    kept = kept.select(F.col("t.row").alias(own))
    return rows.join(kept, own, "left_semi").dropDuplicates([own]).select(*runs.columns)
