"""Benchmark passages in notes: pigeonhole pieces, then Myers' bit-parallel edit distance."""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from motionframe.session import ship_package

ERROR_SHARE = 0.08          # edits per character of an item that still count as a leak
MIN_WORDS = 5               # items of fewer words that may not be edited stand between word borders
GRAM = 4                    # characters of the counting filter before verification
BLOCK_BYTES = 4 << 20       # item text that one pass looks for; more items make more passes

_OTHER = re.compile(r"[\W_]+")

# Fixed: scripts written without spaces (Thai, Lao, Tibetan, Myanmar, Khmer, kana, Han), where any place is a word border.
_NO_SPACES = re.compile("[\u0e00-\u109f\u1780-\u17ff\u19e0-\u19ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf"
                        "\u4e00-\u9fff\ua9e0-\ua9ff\uaa60-\uaa7f\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff]")

LEAK = "array<struct<item_id:long,distance:int,start:int,stop:int>>"


def plain(text: str | None) -> str:
    """Lower case, every run of other signs than letters and digits one space."""
    return _OTHER.sub(" ", (text or "").lower()).strip()


def _between_borders(text: str, a: int, b: int) -> bool:
    """Whether no word of a plain text runs over either end of text[a:b]."""
    return not any(0 < at < len(text) and " " not in (pair := text[at - 1:at + 1]) and not _NO_SPACES.search(pair) for at in (a, b))


def myers(masks: dict[str, int], size: int, text: str) -> tuple[int, int]:
    """Smallest edit distance of a pattern to any substring of a text, and where that first ends.

    Bit i of the vectors holds the difference of two neighbouring cells of a column, so
    one column costs a few operations on integers of `size` bits.
    """
    full, high = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    best, end = size, 0
    for at, sign in enumerate(text, 1):
        same = masks.get(sign, 0)
        vertical = same | minus
        horizontal = (((same & plus) + plus) ^ plus) | same
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
            if score < best:
                best, end = score, at
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
    return best, end


def _masks(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, sign in enumerate(text):
        out[sign] = out.get(sign, 0) | 1 << i
    return out


class ItemFinder:
    """Finds the items of one block in a text.

    An item with a budget of k edits is split into k + 1 pieces; k edits leave at least
    one of them whole. Its exact hits propose places, an exact count of shared character
    n-grams drops most chance hits, and Myers' distance decides. Nothing within the
    budget is lost. An item too short for an edit is one piece, and its hits are the
    places; with fewer than MIN_WORDS words it must not begin or end inside a word.
    """

    def __init__(self, items: list[tuple[int, str]], share: float = ERROR_SHARE):
        self.source = (items, share)
        self.items = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = plain(text)
            if not text:
                continue
            budget, number = int(len(text) * share), len(self.items)
            grams: dict[str, int] = {}
            for i in range(len(text) - GRAM + 1):
                grams[text[i:i + GRAM]] = grams.get(text[i:i + GRAM], 0) + 1
            self.items.append((item_id, text, budget, _masks(text), _masks(text[::-1]), grams))
            for j in range(budget + 1):
                a, b = j * len(text) // (budget + 1), (j + 1) * len(text) // (budget + 1)
                pieces.setdefault(text[a:b], []).append((number, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()

    def __reduce__(self):
        return ItemFinder, self.source

    def find(self, text: str | None) -> list[dict]:
        """One entry per item within its budget: the nearest place, in characters of the plain text."""
        if not self.items or not text:
            return []
        text = plain(text)
        shifts: dict[int, set[int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for number, at in places:
                shifts.setdefault(number, set()).add(end + 1 - size - at)
        out = []
        for number in sorted(shifts):
            item_id, item, budget, masks, reverse, grams = self.items[number]
            if not budget:
                short = item.count(" ") + 1 < MIN_WORDS
                place = min((a for a in shifts[number] if not short or _between_borders(text, a, a + len(item))), default=None)
                if place is not None:
                    out.append({"item_id": item_id, "distance": 0, "start": place, "stop": place + len(item)})
                continue
            best = (budget + 1, 0, 0)
            # places whose regions overlap are looked at together
            first = last = None
            regions = []
            for shift in sorted(shifts[number]):
                if last is not None and shift - last <= 2 * budget:
                    last = shift
                    continue
                if last is not None:
                    regions.append((first, last))
                first = last = shift
            regions.append((first, last))
            for a, b in regions:
                a, b = max(0, a - budget), min(len(text), b + len(item) + budget)
                region = text[a:b]
                if not self._shares(region, grams, len(item), budget):
                    continue
                distance, end = myers(masks, len(item), region)
                if distance < best[0]:
                    # the place begins where the reversed item ends, read backwards from the end
                    _, back = myers(reverse, len(item), region[:end][::-1][:len(item) + distance])
                    best = (distance, a + end - back, a + end)
            if best[0] <= budget:
                out.append({"item_id": item_id, "distance": best[0], "start": best[1], "stop": best[2]})
        return out

    @staticmethod
    def _shares(region: str, grams: dict[str, int], size: int, budget: int) -> bool:
        """One edit touches at most GRAM n-grams, so a match keeps all but GRAM per edit."""
        need = size - GRAM + 1 - GRAM * budget
        if need <= 0:
            return True
        seen: dict[str, int] = {}
        for i in range(len(region) - GRAM + 1):
            g = region[i:i + GRAM]
            if g in grams:
                seen[g] = seen.get(g, 0) + 1
        return sum(min(n, grams[g]) for g, n in seen.items()) >= need


def mark_leaks(runs: DataFrame, items: DataFrame, *, notes: str = "notes", item_id: str = "item_id", text: str = "text",
               share: float = ERROR_SHARE, block_bytes: int = BLOCK_BYTES, out: str = "leaks") -> DataFrame:
    """Adds `leaks`, or the name `out`, to every run: the benchmark items whose text stands in its notes, with a few edits.

    Both sides are compared in plain form (lower case, other signs one space). An item
    leaks where at most `share` edits per character lead to a substring of the notes. If
    that allows no edit, an item of fewer than MIN_WORDS words must also stand between
    word borders; in scripts without spaces these are everywhere. Each entry has item_id,
    distance, and the place in the plain notes. Notes and items that are NULL or empty in
    plain form have no leaks, repeated items are reported once each, items with a NULL id
    are left out. All columns of the runs stay; one named as `out` is replaced. Empty
    tables are fine on either side.

    Notes are read once per block of items and never moved. A block is a share of the
    items by hash, sized by their summed bytes, so what is sent to the tasks is bounded.
    """
    ship_package(runs.sparkSession)
    items = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(
        F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    columns = [c for c in runs.columns if c != out]
    marked = runs.select(*columns, F.array().cast(LEAK).alias(out))
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        marked = _one_block(marked, [tuple(r) for r in part.orderBy("item_id", "text").collect()], notes, share)
    return marked


def _one_block(runs: DataFrame, items: list[tuple[int, str]], notes: str, share: float) -> DataFrame:
    finder = runs.sparkSession.sparkContext.broadcast(ItemFinder(items, share))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]))

    def tasks(batches):
        for batch in batches:
            at = batch.schema.get_field_index(notes)
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                # `leaks` is the last column: what earlier blocks found comes first
                found = [known + finder.value.find(t) for known, t in zip(part.columns[-1].to_pylist(), part.column(at).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found, kind)], part.schema.names)

    return runs.mapInArrow(tasks, runs.schema)
