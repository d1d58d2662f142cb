"""Phrase collocations: counts of packed id n-grams by range-partitioned radix sorts.

1. Map tasks cut texts of one language into chunks and tokenise them; a chunk is written as its distinct words with
   their counts, and the sequence of its words as numbers of these. Word counts are summed over chunks.
2. The dictionary holds the words that occur often enough to stand in a candidate, with dense numbers. It is joined to
   the chunks' words, so that a chunk's sequence becomes one of dictionary
   numbers; other words, and the ends of pieces, break it.
3. A place gives one key of three fixed-width numbers: its word and the next two, or zeros beyond a break. A pair's
   count is the sum over the keys that begin with it, so that one sort counts both lengths. Chunks sort and run-length
   count their keys, cut them at the range bounds, and send one packed block for each range. Bounds come from the keys
   of a bounded number of chunks; they decide which task counts a key, never a result. A key that fills more than one
   range is dealt over all of these.
4. A range's task merges the blocks by least-significant-digit radix sorts over 16-bit digits and adds up equal keys.
   Its first and last pair, and its first key, may go on in another range: these leave as partial counts, and one small
   aggregation adds them up.
5. Scores, the drop of phrases inside longer ones and the ranks are joins of the counted phrases. Before the languages
   are ranked, each of a number of salted parts keeps its own first rows, so that no task sorts all of a language.

Edge cases: a null text is empty, a null language `und`. Documents that repeat are counted each. Very long texts are a
chunk of their own. An empty table, or one without a phrase often enough, gives no rows. Other columns are ignored.
Counts may reach 10^16; arithmetic is decimal.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import discard, small_side, steps, written
from .words import words

#: Bytes of text of a chunk, and keys of a range.
CHUNK, RANGE = 4 << 20, 1 << 19
#: Chunks that place the range bounds, keys that each gives, and the largest number of ranges.
SAMPLED, KEYS, RANGES = 256, 1024, 1 << 16
#: Phrases that one task ranks for a language.
RANKED = 200_000
#: What parts pieces, and what parts words.
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(10, 14)]] = True
_WORD = ~_BREAK
_WORD[[32, 9]] = False


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def planes_of(numbers: np.ndarray, digits: int) -> np.ndarray:
    """The 16-bit digits of rows of numbers, the most significant first: [columns * digits, rows]."""
    return np.concatenate([np.stack([(c >> (16 * d)) & 0xFFFF for d in reversed(range(digits))]) for c in numbers]).astype(np.uint16)


def numbers_of(planes: np.ndarray, digits: int) -> np.ndarray:
    """The inverse of planes_of."""
    wide = planes.astype(np.int64).reshape(len(planes) // digits, digits, planes.shape[1])
    return sum(wide[:, d] << (16 * (digits - 1 - d)) for d in range(digits))


def radix_runs(planes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts: stable counting sorts, the least significant digit first."""
    order = np.arange(planes.shape[1])
    for digit in planes[::-1]:
        if digit.size and (digit != digit[0]).any():
            order = order[np.argsort(digit[order], kind="stable")]
    planes = planes[:, order]
    same = np.ones(planes.shape[1], bool)
    same[:1] = False
    for digit in planes:
        same[1:] &= digit[1:] == digit[:-1]
    at = np.flatnonzero(~same)
    return planes[:, at], np.add.reduceat(n[order], at) if len(at) else n[:0]


def as_bytes(planes: np.ndarray) -> np.ndarray:
    """Keys as byte strings that compare as the keys do."""
    raw = np.ascontiguousarray(planes.T.astype(">u2"))
    return raw.view(f"S{2 * len(planes)}").ravel() if raw.size else np.zeros(0, f"S{2 * len(planes)}")


def _chunks(docs: DataFrame) -> DataFrame:
    """(chunk, lang, total, words, counts, codes): a chunk's distinct words, their counts, and its words as their numbers with a bit for a break before."""
    schema = "chunk long, lang string, total long, words array<binary>, counts array<long>, codes binary"
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                for _, some in steps(texts, texts, CHUNK):
                    doc, start, end, h, data = words(some, _WORD)
                    if not len(h):
                        continue
                    _, first, code, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                    breaks = np.cumsum(_BREAK[data])
                    cut = np.ones(len(h), bool)
                    cut[1:] = (doc[1:] != doc[:-1]) | (breaks[start[1:]] != breaks[end[:-1]-1])
                    size = end[first] - start[first]
                    ends = np.cumsum(size)
                    held = data[np.repeat(start[first] - ends + size, size) + np.arange(ends[-1])]
                    names = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(held)])
                    packed = code.astype(np.uint32) << 1 | cut
                    planes = (packed & 0xFFFF).astype(np.uint16).tobytes() + (packed >> 16).astype(np.uint16).tobytes()
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(first)], pa.int32()), x) for x in (names, pa.array(n.astype(np.int64)))]
                    columns = [pa.array([next(number)], pa.int64()), pa.array([lang], pa.string()), pa.array([len(h)], pa.int64()), *lists, pa.array([zstandard.compress(planes, 3)], pa.binary())]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    lang, text = F.coalesce("lang", F.lit("und")), F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(lang.alias("lang"), text.alias("text")).mapInArrow(run, schema)


def _numbered(words_: DataFrame) -> tuple[DataFrame, str, int]:
    """The words with dense numbers from 1: a number in its file's order behind those of the files before."""
    held, at = written(words_.withColumn("_place", F.monotonically_increasing_id()))
    part, within = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r[0], r[1]) for r in held.groupBy(part).count().collect())  # a row for each file
    if not sizes:
        return held.withColumn("id", F.lit(0).cast("long")).drop("_place"), at, 0
    before = np.cumsum([1, *(n for _, n in sizes)]).tolist()
    starts = words_.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "_part long, _before long")
    ids = held.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("id", F.col("_before") + within)
    return ids.drop("_place", "_part", "_before"), at, before[-1] - 1


def _known(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    """chunk, codes, and the dictionary's words in it as two arrays: their numbers in the chunk and in the dictionary."""
    for chunk, codes, known in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
        local, ids = (known.values.field(k).to_numpy() for k in (0, 1))
        yield chunk.as_py(), zstandard.decompress(codes.as_buffer()), local, ids


def _keys(codes: bytes, local: np.ndarray, ids: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of a chunk and their counts."""
    n = len(codes) // 4
    packed = np.frombuffer(codes, np.uint16, n).astype(np.int64) | np.frombuffer(codes, np.uint16, n, 2 * n).astype(np.int64) << 16
    cut, code = packed & 1 == 1, packed >> 1
    number = np.zeros(int(code.max()) + 1, np.int64)
    number[local] = ids
    one = np.concatenate([number[code], [0, 0]])
    cut = np.concatenate([cut, [True, True]])
    two = np.where(cut[1:-1], 0, one[1:-1])
    three = np.where(cut[2:] | (two == 0), 0, one[2:])
    some = (one[:-2] > 0) & (two > 0)
    planes = planes_of(np.stack([one[:-2][some], two[some], three[some]]), digits)
    return radix_runs(planes, np.ones(planes.shape[1], np.int64))


def _bounds(encoded: DataFrame, digits: int) -> np.ndarray:
    """The ranges' lower bounds but the first's: quantiles of the keys of SAMPLED chunks at most; a bound that repeats marks a key that fills whole ranges."""
    chunks = encoded.count()
    some = encoded.where(F.pmod(F.xxhash64("chunk"), F.lit(-(-chunks // SAMPLED))) == 0) if chunks > SAMPLED else encoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, codes, local, ids in _known(batch):
                keys = as_bytes(_keys(codes, local, ids, digits)[0])
                take = np.unique(np.linspace(0, len(keys) - 1, min(len(keys), KEYS)).astype(int)) if len(keys) else []
                yield pa.RecordBatch.from_arrays([pa.array([len(keys)], pa.int64()), pa.array([[bytes(k).ljust(6 * digits, b"\0") for k in keys[take]]], pa.list_(pa.binary()))], names=["n", "keys"])

    got = [r for r in some.select("chunk", "codes", "known").mapInArrow(run, "n long, keys array<binary>").collect() if r["n"]]
    if not got:
        return np.zeros(0, f"S{6 * digits}")
    total = sum(r["n"] for r in got) * chunks / len(got)
    ranges = min(RANGES, max(1, math.ceil(total / RANGE)))
    keys = np.concatenate([np.array([bytes(k) for k in r["keys"]], f"S{6 * digits}") for r in got])
    weight = np.concatenate([np.full(len(r["keys"]), r["n"] / len(r["keys"])) for r in got])
    order = np.argsort(keys, kind="stable")
    reached = np.cumsum(weight[order])
    return keys[order][np.searchsorted(reached, reached[-1] * np.arange(1, ranges) / ranges)]


def _range_of(keys: np.ndarray, bounds: np.ndarray, salt: int) -> np.ndarray:
    """The range of each sorted key; a key equal to several bounds is dealt over their ranges by the salt."""
    low, high = np.searchsorted(bounds, keys, "left"), np.searchsorted(bounds, keys, "right")
    same = high - low
    return np.where(same > 1, low + 1 + salt % np.maximum(same, 1), high)


def _counted(encoded: DataFrame, digits: int, at_least: int) -> DataFrame:
    """(a, b, c, n): all pairs (c is 0) and triples that occur at_least times."""
    bounds = _bounds(encoded, digits)
    ranges = len(bounds) + 1
    sent, schema = _arrow("range int, keys binary"), "a long, b long, c long, n long"
    arrow = _arrow(schema)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, codes, local, ids in _known(batch):
                planes, n = _keys(codes, local, ids, digits)
                to = _range_of(as_bytes(planes), bounds, chunk * 0x9E3779B1 >> 7)
                order = np.argsort(to, kind="stable")
                cuts = np.flatnonzero(np.diff(to[order], prepend=-1))
                small = n.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if n.max(initial=0) <= np.iinfo(t).max))
                blocks = [zstandard.compress(pickle.dumps((planes[:, some], small[some]), 5), 3) for some in np.split(order, cuts[1:])] if len(order) else []
                yield pa.RecordBatch.from_arrays([pa.array(to[order[cuts]] if len(order) else [], pa.int32()), pa.array(blocks, pa.binary())], schema=sent)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged():
            return radix_runs(np.concatenate([p for p, _ in held], 1), np.concatenate([n.astype(np.int64) for _, n in held]))

        for batch in batches:
            for value in batch.column(1):
                held.append(pickle.loads(zstandard.decompress(value.as_buffer())))
                size += len(held[-1][1])
                if size > 2 * RANGE and len(held) > 1:
                    held = [merged()]
                    size = len(held[0][1]) // 2  # the next merge comes after as many new keys again
        if not held:
            return
        planes, n = merged()
        held.clear()
        first = np.ones(len(n), bool)
        for digit in planes[: 2 * digits]:
            first[1:] &= digit[1:] == digit[:-1]
        first[1:] = ~first[1:]
        starts = np.flatnonzero(first)
        pair_n = np.add.reduceat(n, starts)
        often = pair_n >= at_least
        often[[0, -1]] = True
        pairs = numbers_of(planes[:, starts[often]], digits)
        pairs[2] = 0
        often3 = n >= at_least
        often3[0] = True
        often3 &= planes[2 * digits :].any(0)
        ids, n = np.concatenate([pairs, numbers_of(planes[:, often3], digits)], 1), np.concatenate([pair_n[often], n[often3]])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*ids, n)], schema=arrow)

    parts = encoded.select("chunk", "codes", "known").mapInArrow(deal, "range int, keys binary").repartitionById(ranges, "range").mapInArrow(merge, schema)
    return parts.groupBy("a", "b", "c").agg(F.sum("n").alias("n")).where(F.col("n") >= at_least)


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(10^6 * a^2 / (l * r)), exactly."""
    wide = lambda c: c.cast("decimal(16,0)")
    over = (wide(a) * wide(a)).cast("decimal(32,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", over.cast("decimal(38,0)"), (wide(l) * wide(r)).cast("decimal(38,0)"))


def _cut(pairs: DataFrame, *sides: str) -> DataFrame:
    """The pairs' counts under the names of two columns and `f_` with both."""
    return pairs.select(F.col("a").alias(sides[0]), F.col("b").alias(sides[1]), F.col("n").alias("f_" + "".join(sides)))


def _ranked(grams: DataFrame, dictionary: DataFrame, totals: DataFrame, share: int, top: int) -> DataFrame:
    pairs, triples = grams.where("c = 0"), grams.where("c > 0")
    within = triples.select("a", "b", "n").unionByName(triples.select(F.col("b").alias("a"), F.col("c").alias("b"), "n"))
    longest = within.groupBy("a", "b").agg(F.max("n").alias("longest"))
    free = pairs.join(longest, ["a", "b"], "left").where(F.coalesce(100 * F.col("longest") < share * F.col("n"), F.lit(True)))
    whole = triples.join(_cut(pairs, "a", "b"), ["a", "b"]).join(_cut(pairs, "b", "c"), ["b", "c"])
    none = F.lit(None).cast("long")
    rows = free.select("a", "b", "c", "n", none.alias("f_ab"), none.alias("f_bc")).unionByName(whole.select("a", "b", "c", "n", "f_ab", "f_bc"))
    names = dictionary.select("id", "lang", "word", "f")
    for side in "abc":
        named = names.select(F.col("id").alias(side), F.col("word").alias(f"w_{side}"), F.col("f").alias(f"f_{side}"), *(["lang"] if side == "a" else []))
        rows = rows.join(named, side, "left" if side == "c" else "inner")
    # The cuts, the one after the first word before the one after the second: of equal scores the first is taken.
    cut = lambda k, l, r: F.struct(_score(F.col("n"), F.col(l), F.col(r)).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r"))  # noqa: E731, E741
    best = F.when(F.col("c") == 0, cut(1, "f_a", "f_b")).otherwise(F.least(cut(1, "f_a", "f_bc"), cut(2, "f_ab", "f_c")))
    phrase = F.concat_ws(" ", F.col("w_a").cast("string"), F.col("w_b").cast("string"), F.col("w_c").cast("string"))
    scored = rows.select("lang", phrase.alias("phrase"), F.col("n").alias("a"), best.alias("best")).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = -(-grams.count() // RANKED)
    if parts > 1:
        near = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*order)
        scored = scored.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= top).drop("rank")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, at_least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases of two or three words.

    A phrase occurs at_least times. Its score is the lowest, over its cuts, of floor(10^6 * a^2 / (l * r)), where a, l
    and r are the counts of the phrase and of the cut's sides, and n the language's words. A phrase within a longer one
    that has `share` percent of its places, or more, is left out.
    """
    spark = docs.sparkSession
    chunks, at_chunks = written(_chunks(docs))
    local = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("local", "x")).select("chunk", "lang", "local", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    totals, _ = written(chunks.groupBy("lang").agg(F.sum("total").alias("n")))
    dictionary, at_words, size = _numbered(local.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= at_least))
    dictionary, _ = written(dictionary)
    known = local.select("chunk", "lang", "local", "word").join(dictionary.select("lang", "word", "id"), ["lang", "word"])
    known = known.groupBy("chunk").agg(F.collect_list(F.struct("local", "id")).alias("known"))
    encoded, at_encoded = written(chunks.select("chunk", "codes").join(known, "chunk"))
    discard(spark, at_chunks, at_words)
    grams, _ = written(_counted(encoded, max(1, math.ceil(size.bit_length() / 16)), at_least))
    discard(spark, at_encoded)
    return _ranked(grams, dictionary, small_side(totals), share, top)
