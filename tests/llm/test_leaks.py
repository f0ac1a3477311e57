"""Benchmark passages: Myers' distance and the whole search against dynamic programming."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from motionframe.llm import leaks


def brute(pattern, text):
    """Smallest distance of the pattern to any substring, by the plain recurrence."""
    last = list(range(len(pattern) + 1))
    best = last[-1]
    for c in text:
        row = [0]
        for i, p in enumerate(pattern):
            row.append(min(last[i] + (p != c), last[i + 1] + 1, row[i] + 1))
        last = row
        best = min(best, last[-1])
    return best


@given(st.text("abc ", min_size=1, max_size=90), st.text("abc ", max_size=120))
@settings(max_examples=200, deadline=None)
def test_myers_equals_recurrence(pattern, text):
    assert leaks.myers(leaks._masks(pattern), len(pattern), text)[0] == brute(pattern, text)


@pytest.fixture(scope="module")
def items():
    rng = np.random.RandomState(5)
    words = ["of", "the", "then", "red", "ing", "tion", "hand", "ablen", "ouse"]
    return [(i, " ".join("".join(rng.choice(words, rng.randint(1, 4))) for _ in range(rng.randint(6, 20)))) for i in range(25)]


def spoiled(text, edits, rng):
    t = list(text)
    for _ in range(edits):
        at = rng.randint(0, len(t))
        t[at:at + rng.randint(0, 2)] = [] if rng.randint(2) else [rng.choice(list("xyz"))]
    return "".join(t)


def test_search_equals_brute_force(spark, items):
    rng = np.random.RandomState(6)
    notes = []
    for i in range(80):
        own = " ".join(rng.choice(["of", "then", "house", "redtion", "quick", "lamp"], rng.randint(0, 40)))
        item = items[rng.randint(len(items))][1]
        budget = int(len(leaks.plain(item)) * leaks.ERROR_SHARE)
        notes.append(f"{own} {spoiled(item.upper() if i % 2 else item.replace(' ', ', '), rng.randint(0, budget + 3), rng)} {own}")
    df = spark.createDataFrame([(i, t, None, "d") for i, t in enumerate(notes)], "run_id long, notes string, leaks string, found string")
    got = leaks.mark_leaks(df.repartition(4), spark.createDataFrame(items, "item_id long, text string"), block_bytes=1500)
    assert got.columns == ["run_id", "notes", "found", "leaks"]
    found = {(r.run_id, x.item_id): x for r in got.collect() for x in r.leaks}
    want = {}
    for k, t in enumerate(notes):
        for i, item in items:
            d = brute(leaks.plain(item), leaks.plain(t))
            if d <= int(len(leaks.plain(item)) * leaks.ERROR_SHARE):
                want[k, i] = d
    assert {k: x.distance for k, x in found.items()} == want and len(want) > 40
    for (k, i), x in found.items():  # the stated place is one with that distance
        place = leaks.plain(notes[k])[x.start:x.stop]
        item = leaks.plain(dict(items)[i])
        assert brute(item, place) == x.distance and abs(len(place) - len(item)) <= x.distance


def test_awkward_sides(spark, awkward, items):
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "too short item"), (None, items[0][1]), (4, "a b c d e f"), (4, "a b c d e f")],
                                "item_id long, text string")
    got = leaks.mark_leaks(awkward, odd)
    assert got.count() == awkward.count()
    for r in got.select("notes", "leaks").collect():
        assert [x.item_id for x in r.leaks] == ([4] if leaks.plain(r.notes) == "a b c d e f" else [])
    none = leaks.mark_leaks(awkward, odd.limit(0))
    assert none.where("size(leaks) > 0").count() == 0 and none.count() == awkward.count()
    assert leaks.mark_leaks(awkward.limit(0), odd).count() == 0


def test_short_items_and_scripts_without_spaces(spark):
    han = "在标准大气压下水的沸点是多少摄氏度，如果气压降低到一半，沸点会升高还是降低，请说明理由？"
    items = [(1, "What is 17 * 24?"), (2, "Who wrote Hamlet?"), (3, "art"), (4, "首都是哪"), (5, han), (6, "?!"), (7, "x y z"),
             (8, "ประเทศไทย"), (9, "42"), (10, "photosynthesis"), (11, "GPT")]
    notes = {"q: what is 17*24 ?": [1], "Ask: who  WROTE hamlet": [2], "who wrote hamlets": [2], "party start": [], "The art.": [3], "Art": [3],
             "请问法国的首都是哪里": [4], "甲" + han.replace("大", "小") + "乙": [5], "什么是GPT呢": [11], "GPTs": [],
             "ax y z x y zb": [], "ax y z, x y z!": [7], "อยู่ประเทศไทยนี้": [8], "142 42": [9], "142": [], "of photosyntheses": [10], "": [], "?!": []}
    got = leaks.mark_leaks(spark.createDataFrame([(t,) for t in notes], "notes string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.notes: [x.item_id for x in r.leaks] for r in got.collect()} == notes
    plains = {i: leaks.plain(t) for i, t in items}
    for r in got.collect():
        for x in r.leaks:
            place = leaks.plain(r.notes)[x.start:x.stop]
            assert brute(plains[x.item_id], place) == x.distance and (x.distance or place == plains[x.item_id])
