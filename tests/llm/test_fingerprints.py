"""Fingerprints and components against all pairs on a small table."""

import re

import numpy as np
import pytest
import xxhash

from motionframe.llm import fingerprints as fp


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes.maketrans(
        b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints, keys):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    best = {}
    for i, k in enumerate(keys):
        best.setdefault(find(i), []).append(k)
    return [min((k for k in best[find(i)] if k is not None), default=None) for i in range(len(prints))]


def test_awkward_notes(spark, awkward):
    rows = awkward.select("run_id", "notes").collect()
    prints = [brute_print(r.notes) for r in rows]
    comps = brute_components(prints, [r.run_id for r in rows])
    got = fp.near_duplicate_notes(awkward).collect()
    want = [(r.run_id, f"{p:016x}", c) for r, p, c in zip(rows, prints, comps)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_native_hash_agrees(spark):
    assert spark.sql("SELECT xxhash64('a b c')").first()[0] == np.uint64(xxhash.xxh64_intdigest(b"a b c", 42)).astype(np.int64)


@pytest.mark.parametrize("bits", [1, 3, 6])
def test_links_connect_all_within_the_radius(bits):
    rng = np.random.RandomState(1)
    base = rng.randint(0, 2**63, 40).astype(np.uint64)
    prints = [base]
    for _ in range(4):  # chains and balls around the bases
        flip = np.zeros(len(base), np.uint64)
        for _ in range(rng.randint(1, 5)):
            flip ^= np.uint64(1) << rng.randint(0, 64, len(base)).astype(np.uint64)
        prints.append(prints[-1] ^ flip)
    prints = np.unique(np.concatenate(prints))
    edges = [fp.links_in_bucket(prints, b, bits) for b in range(1 << bits)]
    a, b = np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])
    assert (np.bitwise_count(a ^ b) <= 3).all()
    keys = {int(p): i for i, p in enumerate(prints)}
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for x, y in zip(a.tolist(), b.tolist()):
        parent[max(find(keys[x]), find(keys[y]))] = min(find(keys[x]), find(keys[y]))
    want = brute_components([int(p) for p in prints], list(range(len(prints))))
    assert [find(i) for i in range(len(prints))] == want


def test_components_of_a_long_chain(spark):
    nodes = spark.range(200).selectExpr("id AS node", "id + 5 AS own")
    links = spark.range(149).selectExpr("(id * 37) % 150 AS a", "((id + 1) * 37) % 150 AS b")
    got = {r.node: r.best for r in fp.smallest_reachable(nodes, links).collect()}
    assert all(got[i] == 5 for i in range(150)) and all(got[i] == i + 5 for i in range(150, 200))


def test_one_of_each_group_keeps_all_columns(spark, awkward):
    kept = fp.one_note_of_each_group(awkward)
    assert kept.columns == awkward.columns
    comps = {c for c in (r.component_id for r in fp.near_duplicate_notes(awkward).collect())}
    assert sorted(r.run_id for r in kept.collect()) == sorted(comps)


def test_empty_table(spark, make):
    assert fp.near_duplicate_notes(make([])).count() == 0
    assert fp.one_note_of_each_group(make([])).count() == 0
