"""Benchmark decontamination: windows of typed templates, joined by hash, with a check of the slots.

A text's tokens are words and numbers; a number becomes the slot <num>, a unit behind a number <unit>, a capitalised
word inside a sentence <name>, and every other word stays as it is in lower case. Windows of 8 template tokens are
hashed, and so are the windows with names left as words, for texts whose capitals were changed. A document's windows that hit an item's windows form segments along an alignment (document place minus item
place). Segments of one item that follow each other in both, with alignments at most 8 apart, are chained to a run, so
that inserted or missing words (a name of two words, a number spelt out) don't break it. In a run equal slot values of
the item must have equal values in the document, while different ones may meet in one value; such a run is `exact` if
it has one alignment and all values agree, else `changed` (a re-parameterised question). A run counts if its segments
cover at least 60 % of the item's tokens. A change that leaves fewer than 8 tokens on a side hides that side.

The documents are read once. A filter of bounded size (bits of the hashes of the items' words, pairs of words, and
windows; more bits set only let more pass) goes to every task and leaves each document its windows that may be an
item's, none for almost all. These windows meet the benchmark's table of windows in an equi-join on the hash, whatever
the size of either; the rows that meet an item get its text, and runs and slots are checked on both texts. A key of the
row carries the verdict, so that rows that repeat an id are answered each on its own.

Edge cases: null texts are empty and match nothing; items with fewer than 8 tokens are matched as one window of their
length; an item that repeats under several ids is reported under each; empty tables give no match; documents' other
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import materialize, small_side, unused, with_texts
from .words import ALNUM, mix, words

WINDOW, COVER, DRIFT = 8, 0.6, 8
TOKEN = re.compile(r"\d+(?:[.,:]\d+)*|[^\W\d_]+|([.!?\n])")

# Units that may follow a number.
UNITS = frozenset("mm cm m km in ft mi mg g kg lb oz ml l s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents usd eur kmh mph meter meters metre metres mile miles gram grams liter liters litre litres".split())
NUM, UNIT, NAME = "<num>", "<unit>", "<name>"


def canonical(text: str) -> tuple[list[str], list[str]]:
    """The template tokens and, at the same places, what stood there (in lower case)."""
    out, raw, begins, after_number = [], [], True, False
    for m in TOKEN.finditer(text):
        w = m.group()
        if m.group(1):
            begins, after_number = True, False
            continue
        low = w.lower()
        if w[0].isdigit():
            t, number = NUM, True
        elif after_number and low in UNITS:
            t, number = UNIT, False
        elif w[0] != low[0] and not begins and w[1:] == low[1:]:
            t, number = NAME, False
        else:
            t, number = low, False
        out.append(t)
        raw.append(low)
        begins, after_number = False, number
    return out, raw


def _hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of token numbers."""
    if len(ids) < width:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(len(ids) - width + 1, width, np.uint64)
        for k in range(width):
            h = (h ^ ids[k : len(ids) - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def token_hash(t: str) -> int:
    """A 64-bit hash of a token that is the same in every process."""
    return xxhash.xxh64_intdigest(t.encode())


def consistent(pairs: Iterable[tuple[str, str]], known: dict[str, str] | None = None) -> dict[str, str] | None:
    """The document's value of each of the item's slot values, with those known before; None if one has two."""
    there = dict(known or {})
    return there if all(there.setdefault(a, b) == b for a, b in pairs) else None


def _unnamed(toks: list[str], raw: list[str]) -> list[str]:
    return [r if t == NAME else t for t, r in zip(toks, raw, strict=True)]


def forms(text: str, toks: list[str], raw: list[str]) -> list[tuple[list[str], int | None]]:
    """The token sequences whose windows stand for an item, and how many of each one's windows count (all if None)."""
    # Inside another text's sentence the first word is a name.
    inside = [NAME, *toks[1:]] if text.lstrip()[:1].isupper() and toks[0] not in (NUM, NAME) else toks
    return [(toks, None), (_unnamed(toks, raw), None), (inside, 1)]


class Index:
    """The benchmark's windows, sorted by hash, and each item's templates."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items, self.vocabulary = [], {}
        rows = set()
        for item_id, text in items:
            toks, raw = canonical(text or "")
            if not toks:
                continue
            k, w = len(self.items), min(WINDOW, len(toks))
            self.items.append((item_id, toks, raw))
            for form, places in forms(text, toks, raw):
                ids = np.array([self.vocabulary.setdefault(t, token_hash(t)) for t in form], np.uint64)
                rows |= {(int(h), k, p) for p, h in enumerate(_hashes(ids, w)[:places])}
        self.widths = sorted({min(WINDOW, len(t)) for _, t, _ in self.items}, reverse=True)
        ordered = sorted(rows)
        self.hash = np.array([r[0] for r in ordered], np.uint64)
        self.item = np.array([r[1] for r in ordered], np.int64)
        self.place = np.array([r[2] for r in ordered], np.int64)

    def matches(self, text: str) -> list[tuple[int, int, int, float, str]]:
        """(item id, first token, last token, share of the item covered, kind) of every run that counts."""
        toks, raw = canonical(text)
        hits: dict[tuple[int, int], set[int]] = {}
        for form in (toks, _unnamed(toks, raw)):
            self._hit(form, hits)
        by_item: dict[int, list[tuple[int, int, int]]] = {}
        for (item, shift), places in hits.items():
            width = min(WINDOW, len(self.items[item][1]))
            begin = end = None
            for p in sorted(places):
                if begin is None or p > end:
                    if begin is not None:
                        by_item.setdefault(item, []).append((begin + shift, begin, end))
                    begin = p
                end = p + width
            by_item.setdefault(item, []).append((begin + shift, begin, end))
        return sorted(m for item, segments in by_item.items() for m in self._runs(item, segments, toks, raw))

    def _runs(self, item: int, segments: list[tuple[int, int, int]], toks: list[str], raw: list[str]) -> list[tuple[int, int, int, float, str]]:
        """The chains of an item's segments (document place, first item place, item place behind) that count; no segment is in two."""
        item_id, want, values = self.items[item]
        out, left = [], sorted(segments)
        while sum(e - b for _, b, e in left) >= COVER * len(want):
            # Of each segment: tokens covered by the best chain that ends with it, negative number of alignments, chain before, own first place, values so far.
            best: list[tuple[int, int, int, int, dict] | None] = []
            for j, (at, b, e) in enumerate(left):
                shift, top = at - b, None
                pairs = consistent(self._slots(item, b, e, shift, toks, raw))
                if pairs is not None:
                    top = (e - b, -1, -1, b, pairs)
                for i in range(j - 1, -1, -1):
                    at_i, b_i, e_i = left[i]
                    if at_i < at - len(want) - DRIFT:
                        break
                    moved = shift - at_i + b_i
                    first = max(b, e_i, e_i - moved)
                    if best[i] is None or abs(moved) > DRIFT or b_i >= b or first >= e:
                        continue
                    rank = (best[i][0] + e - first, best[i][1] - (moved != 0))
                    if top is None or rank > top[:2]:
                        pairs = consistent(self._slots(item, first, e, shift, toks, raw), best[i][4])
                        if pairs is not None:
                            top = (*rank, i, first, pairs)
                best.append(top)
            used: set[int] = set()
            for j in sorted((j for j, t in enumerate(best) if t and t[0] >= COVER * len(want)), key=lambda j: (-best[j][0], -best[j][1], j)):
                chain, k = [], j
                while k >= 0:
                    chain.append(k)
                    k = best[k][2]
                if used.isdisjoint(chain):
                    used.update(chain)
                    places = [(q, left[k][0] - left[k][1]) for k in reversed(chain) for q in range(best[k][3], left[k][2])]
                    same = best[j][1] == -1 and all(v == raw[q + shift] for q, shift in places for _, v, _ in self._slot(item, q, shift, toks))
                    out.append((item_id, sum(places[0]), sum(places[-1]), best[j][0] / len(want), "exact" if same else "changed"))
            if not used:
                break
            left = [x for j, x in enumerate(left) if j not in used]
        return out

    def _slot(self, item: int, q: int, shift: int, toks: list[str]) -> list[tuple[str, str, int]]:
        """Kind, value and document place if the item's place q is a slot. A word that begins the item's sentence is a name where it stands inside the document's."""
        _, want, values = self.items[item]
        if want[q] in (NUM, UNIT, NAME):
            return [(want[q], values[q], q + shift)]
        return [(NAME, values[q], q + shift)] if toks[q + shift] == NAME else []

    def _slots(self, item: int, begin: int, end: int, shift: int, toks: list[str], raw: list[str]) -> list[tuple[str, str]]:
        return [(t + v, t + raw[at]) for q in range(begin, end) for t, v, at in self._slot(item, q, shift, toks)]

    def _hit(self, form: list[str], hits: dict[tuple[int, int], set[int]]) -> None:
        """Adds the item's places of each window that a form of the text shares, by item and shift."""
        get = self.vocabulary.get
        ids = np.fromiter((get(t, 0) for t in form), np.uint64, len(form))
        known = ids != 0
        for width in self.widths:
            if known.sum() < width:
                continue
            h = _hashes(ids, width)
            at = np.flatnonzero(np.convolve(known, np.ones(width, np.int64), "valid") == width)
            lo, hi = np.searchsorted(self.hash, h[at], "left"), np.searchsorted(self.hash, h[at], "right")
            some = hi > lo
            for p, a, b in zip(at[some].tolist(), lo[some].tolist(), hi[some].tolist(), strict=True):
                for k in range(a, b):
                    item = int(self.item[k])
                    if min(WINDOW, len(self.items[item][1])) == width:
                        hits.setdefault((item, p - int(self.place[k])), set()).add(int(self.place[k]))


#: Bits of each filter: at least 16 for each hash until it has its largest size.
LEAST_BITS, MOST_BITS = 16, 27
WORD, PAIR, WIN = range(3)


def _word_hashes(text: str) -> np.ndarray:
    return words([text.encode()], ALNUM)[3]


@lru_cache(maxsize=1)
def _unit_hashes() -> np.ndarray:
    """The hashes of UNITS; asked for in workers only, as the tables of hashing take 62 MB of the process that makes them."""
    return np.unique(_word_hashes(" ".join(sorted(UNITS))))


def _pair_hashes(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])


def item_rows(items: DataFrame) -> DataFrame:
    """(item, kind, h, width): the hashes of each item's words, pairs of words, and windows (with their width)."""

    def run(batches):
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                toks, raw = canonical(text)
                if not toks:
                    continue
                width, plain = min(WINDOW, len(toks)), _word_hashes(" ".join(raw))
                wins = [_hashes(np.array([token_hash(t) for t in form], np.uint64), width)[:n] for form, n in forms(text, toks, raw)]
                for kind, hs in ((WORD, plain), (PAIR, _pair_hashes(plain)), (WIN, np.concatenate(wins))):
                    out += [(item, kind, h, width) for h in np.unique(hs).view(np.int64).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int32()))], ["item", "kind", "h", "width"])

    return items.select("item", "text").mapInArrow(run, "item long, kind int, h long, width int")


class Bits:
    """A set of hashes by one bit each: no false negatives."""

    def __init__(self, rows: DataFrame, kind: int):
        some = rows.where(F.col("kind") == kind)
        n = some.select("h").distinct().count()
        self.size = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))
        place = F.shiftrightunsigned("h", 64 - self.size)
        got = some.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - self.size}) & 63 as int))")).alias("bits")).toArrow()
        self.bits = np.zeros(1 << (self.size - 6), np.uint64)  # 16 MB at most
        self.bits[got.column("at").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - self.size)
        return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


class Filter:
    """Finds the windows of a text that may be an item's."""

    def __init__(self, rows: DataFrame):
        self.word, self.pair, self.window = (Bits(rows, k) for k in (WORD, PAIR, WIN))
        self.widths = [r["width"] for r in rows.where(F.col("kind") == WIN).select("width").distinct().orderBy("width").collect()]  # 8 at most

    def plausible(self, texts: list[bytes]) -> np.ndarray:
        """Whether each text has so many words in a row that are the benchmark's, and stand in its pairs, as a window needs.

        Words with digits, capitals, or characters beyond lower-case Latin letters are free: they may be slots, or be cut
        into several tokens.
        """
        doc, start, end, h, data = words(texts, ALNUM)
        out = np.zeros(len(texts), bool)
        if not len(h) or not self.widths:
            return out
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        behind = np.append(raw[1:], 32)
        latin = (raw == 0xC3) & (behind >= 0xA0) & (behind != 0xB7)
        wide = (raw >= 0xC0) & ~latin
        digit = (raw >= 48) & (raw < 58)
        count = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
        per = lambda c: c[end] - c[start]
        digits, wides = per(count(digit)), per(count(wide))
        units = _unit_hashes()
        at = np.minimum(np.searchsorted(units, h), len(units) - 1)
        free = (digits > 0) | (wides > 0) | (per(count((raw >= 65) & (raw < 91))) > 0) | (units[at] == h)
        tokens = 1 + wides + np.where(digits > 0, end - start, 0)
        ok = free | self.word.has(h)
        begins = np.ones(len(h), bool)
        begins[1:] = (doc[1:] != doc[:-1]) | ~ok[:-1] | ~(free[1:] | free[:-1] | self.pair.has(_pair_hashes(h)))
        first = np.flatnonzero(begins | ~ok)
        out[doc[first[np.add.reduceat(np.where(ok, tokens, 0), first) >= self.widths[0]]]] = True
        return out

    def windows(self, text: str) -> list[int]:
        toks, raw = canonical(text)
        found: set[int] = set()
        for form in (toks, _unnamed(toks, raw)):
            ids = np.array([token_hash(t) for t in form], np.uint64)
            for width in self.widths:
                h = _hashes(ids, width)
                found.update(h[self.window.has(h)].view(np.int64).tolist())
        return sorted(found)


def probed(df: DataFrame, chosen: Filter, name: str) -> DataFrame:
    """df's columns and the windows of its text that may be an item's (null if none)."""
    found = lambda texts: [chosen.windows(t.decode("utf-8", "replace")) or None if y else None for t, y in zip(texts, chosen.plausible(texts).tolist(), strict=True)]
    return with_texts(df, name, ArrayType(LongType()), found)


def found_items(rows: DataFrame, items: DataFrame, windows: DataFrame) -> DataFrame:
    """rows: row, text, windows. For each row with a run that counts: row, item_ids, n_runs, n_changed, best_share."""
    hits = rows.select("row", F.explode("windows").alias("h")).join(windows, "h").select("row", "item").distinct()
    named = hits.join(items, "item").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("item_id", F.col("text").alias("item_text")))).alias("items"))
    both = rows.select("row", "text").join(named, "row")

    def check(batches):
        for batch in batches:
            out = []
            for row, text, some in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                fs = _index(tuple((x["item_id"], x["item_text"]) for x in some)).matches(text)
                if fs:
                    out.append((row, sorted({f[0] for f in fs}), len(fs), sum(f[4] == "changed" for f in fs), max(f[3] for f in fs)))
            types = (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["row", "item_ids", "n_runs", "n_changed", "best_share"])

    return both.select("row", "text", "items").mapInArrow(check, "row long, item_ids array<long>, n_runs long, n_changed long, best_share double")


@lru_cache(maxsize=1024)
def _index(items: tuple[tuple[int, str], ...]) -> Index:
    return Index(list(items))


def _searched(df: DataFrame, benchmark: DataFrame, keep_text: bool) -> tuple[DataFrame, DataFrame, str]:
    """(df's rows with a row key, written; the finds of those that have any; the key's name)."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    items = materialize(items.withColumn("item", F.xxhash64("item_id", "text")))
    rows = materialize(item_rows(items))
    key = unused(df, "row")
    name = unused(df, "windows")
    seen = probed(df.withColumn(key, F.monotonically_increasing_id()), Filter(rows), name)
    if not keep_text:
        seen = seen.withColumn("text", F.when(F.col(name).isNotNull(), F.col("text")))
    seen = materialize(seen)
    some = seen.where(F.col(name).isNotNull()).select(F.col(key).alias("row"), "text", F.col(name).alias("windows"))
    windows = small_side(materialize(rows.where(F.col("kind") == WIN).select("h", "item").distinct()))
    return seen.drop(name), materialize(found_items(some, items, windows)), key


def decontaminate(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: contaminated, the ids of the items found (sorted, distinct), the runs' number and kinds, and the best share."""
    docs, found, _ = _searched(df.select("doc_id", "text"), benchmark, False)
    out = docs.select("doc_id", "row").join(small_side(found), "row", "left")
    none = F.lit(0).cast("long")
    return out.select("doc_id", F.col("n_runs").isNotNull().alias("contaminated"), F.coalesce(F.array_join("item_ids", ","), F.lit("")).alias("item_ids"), F.coalesce("n_runs", none).alias("n_runs"), F.coalesce("n_changed", none).alias("n_changed"), F.coalesce("best_share", F.lit(0.0)).alias("best_share"))


def without_benchmark(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """df's rows in which no item is found, in df's columns."""
    docs, found, key = _searched(df, benchmark, True)
    gone = small_side(materialize(found.select(F.col("row").alias(key))))
    return docs.join(gone, key, "left_anti").select(*(F.col(f"`{c}`") for c in df.columns))
