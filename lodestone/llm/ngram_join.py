"""N-gram Jaccard join: sets of word 4-grams in prefix trees.

1. Each text becomes the set of 64-bit hashes of its distinct 4-grams; equal sets are one class.
2. Hashes are dealt by value into buckets of bounded size, which count in how many classes each occurs. N-grams that
   very many texts have are found while the sets are made: they are taken as shared and dealt by class, so that no bucket
   holds an entry for each class. A class can only link if 85 % of its set is shared with others, so the rest is done.
3. The shared n-grams of the classes left are ordered by (frequency, hash). By the prefix bound two linked classes
   have a common n-gram among the first |x| - ceil(0.85 |x|) + 1 of each.
4. Classes meet where they share such an n-gram. A meeting puts its sets into a prefix tree (frequent first, so that
   near copies share paths), descends it with every set, carries the overlap so far down each path, and leaves a
   subtree as soon as overlap plus what remains can't reach the bound, or when all of it is known to be linked.
   First every class goes to two meetings, in blocks. Then the classes that share such an n-gram with another
   component meet, all that hang together at once, large meetings in tiles of two blocks: no task's meeting grows with
   an n-gram's frequency.
5. Components of the links give the result.

Edge cases: a text without words, or null, has an empty set and links with nothing; fewer than four words are one
n-gram; rows with the same id stay rows of their own with the same component; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import discard, map_texts, materialize, small_side, steps, unused, with_texts, written
from .components import components
from .words import MASK48, U, get48, mix, put48, words

#: N-grams of a counting bucket, of a map task's flush, and of a meeting's block.
BUCKET, FLUSH, BLOCK = 1 << 20, 1 << 19, 1 << 19
#: Classes of a step (1 MB of texts) that make an n-gram worth counting before the buckets, and the sum from which it is hot.
OFTEN, HOT = 6, 1 << 16
_ORDER = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(16)], U)  # up to 16 words


def need(n: int, percent: int = 85) -> int:
    """The least overlap of a set of n with any set that it links to."""
    return -(-percent * n // 100)


def least_overlap(a: int, b: int, percent: int = 85) -> int:
    """The least overlap for 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def shingle_sets(texts: list[bytes], width: int = 4) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    doc, _, _, h, _ = words(texts)
    bound = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    with np.errstate(over="ignore"):
        grams = sum((h[k : len(h) - width + 1 + k] * _ORDER[k] for k in range(width)), np.zeros(max(0, len(h) - width + 1), U)) if len(h) >= width else np.zeros(0, U)
        grams = mix(grams)
        for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
            if b - a >= width:
                out.append(np.unique(grams[a : b - width + 1]))
            elif b > a:
                out.append(mix((h[a:b] * _ORDER[: b - a]).sum(keepdims=True, dtype=U) + U(b - a)))
            else:
                out.append(np.zeros(0, U))
    return out


def signature(s: np.ndarray) -> int:
    """A 64-bit digest of a set."""
    with np.errstate(over="ignore"):
        return int((mix(s ^ U(0xA0761D6478BD642F)).sum(dtype=U) + U(len(s)) * U(0xE7037ED1A0B428DB)).astype(np.int64))


def class_of(df: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, n_shingles, the class (the digest of the set; null for an empty one), and the n-grams that many texts of a step have, at its first row."""

    def run(ids, texts):
        sets = shingle_sets(texts, width)
        distinct = {signature(s): s for s in sets if len(s)}
        h, times = np.unique(np.concatenate([*distinct.values(), np.zeros(0, U)]), return_counts=True)
        often = [{"h": int(x), "times": int(n)} for x, n in zip(h[times >= OFTEN].view(np.int64), times[times >= OFTEN], strict=True)]
        return {"doc_id": ids, "n_shingles": [len(s) for s in sets], "cls": [signature(s) if len(s) else None for s in sets], "often": [often, *([None] * (len(ids) - 1))]}

    return map_texts(df, run, "doc_id long, n_shingles long, cls long, often array<struct<h:long,times:long>>")


def hot_grams(docs: DataFrame) -> dict[int, int]:
    """The n-grams that stand in HOT texts or more, as counted from class_of's steps, and these counts: fewer than 1 / HOT of all n-grams."""
    found = docs.select(F.explode("often").alias("o")).groupBy("o.h").agg(F.sum("o.times").alias("times")).where(F.col("times") >= HOT)
    return {r["h"]: r["times"] for r in found.collect()}


def shared(df: DataFrame, buckets: int, width: int = 4, hot: dict[int, int] | None = None) -> DataFrame:
    """(cls, n, h, df) of every n-gram that more than one class has, with the number of those classes.

    Hot n-grams don't meet in a bucket: they count as shared, have the count they come with, and are dealt by class.
    """
    hot_h = np.array(sorted(hot or {}), np.int64)
    hot_df = np.array([hot[h] for h in hot_h.tolist()], np.int64) if hot else np.zeros(0, np.int64)
    bucket_of = lambda h: ((h >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
    # Six bytes of an n-gram travel; its bucket tells as much of the other two as there are buckets.
    named = lambda b, low: (b.astype(U) * U(1 << 16) // U(buckets) << U(48) | low).view(np.int64)
    hot_name = named(bucket_of(hot_h.view(U)), hot_h.view(U) & MASK48) if len(hot_h) else hot_h

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        names: dict[int, int] = {}
        size = 0

        def flush():
            order, docs = np.concatenate(held), np.repeat(np.arange(len(held)), [len(s) for s in held])
            b, low = bucket_of(order), order & MASK48
            if len(hot_h):
                at = np.minimum(np.searchsorted(hot_h, order.view(np.int64)), len(hot_h) - 1)
                is_hot = hot_h[at] == order.view(np.int64)
                b = np.where(is_hot, np.fromiter(names, np.int64, len(names))[docs] % buckets + buckets, b)
                low = np.where(is_hot, at.astype(U), low)
            by = np.argsort(b, kind="stable")
            at = np.arange(2 * buckets + 1)
            cut = np.searchsorted(b[by], at)
            # within a bucket the n-grams stand by class: each class once, with its number of n-grams there
            pair, times = np.unique(b * len(held) + docs, return_counts=True)
            cut2 = np.searchsorted(pair, at * len(held))
            cls, n = np.fromiter(names, np.int64, len(names))[pair % len(held)], np.fromiter(names.values(), np.int32, len(names))[pair % len(held)]
            have = np.flatnonzero(np.diff(cut))
            part = lambda a, c: pa.array([a[c[k] : c[k + 1]].tobytes() for k in have], pa.binary())
            low = low[by]
            grams = pa.array([put48(low[cut[k] : cut[k + 1]]) for k in have], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(have.astype(np.int32)), grams, part(cls, cut2), part(n, cut2), part(times.astype(np.int32), cut2)], ["bucket", "h", "cls", "n", "times"])

        for batch in batches:
            for _, texts in steps([None] * batch.num_rows, batch.column(0).to_pylist()):
                for s in shingle_sets(texts, width):
                    if len(s) and (c := signature(s)) not in names:
                        names[c] = len(s)
                        held.append(s)
                        size += len(s)
                if size >= FLUSH:
                    yield flush()
                    held, names, size = [], {}, 0
        if held:
            yield flush()

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        bucket, cls = int(rows["bucket"].iloc[0]), np.frombuffer(b"".join(rows["cls"]), np.int64)
        low = np.concatenate([get48(x) for x in rows["h"]])
        h = hot_name[low.astype(np.int64)] if bucket >= buckets else named(np.full(1, bucket), low)
        n, times = (np.frombuffer(b"".join(rows[c]), np.int32) for c in ("n", "times"))
        cls, n = np.repeat(cls, times), np.repeat(n, times)
        if bucket >= buckets:  # hot n-grams of some classes: each pair once
            by = np.lexsort((h, cls))
            by = by[np.append(True, (cls[by][1:] != cls[by][:-1]) | (h[by][1:] != h[by][:-1]))]
            df_ = np.minimum(hot_df[low[by].astype(np.int64)], np.iinfo(np.int32).max)
            return pd.DataFrame({"cls": cls[by], "n": n[by], "h": h[by], "df": df_.astype(np.int32)})
        by = np.argsort(h, kind="stable")
        hs = h[by]
        same = hs[1:] == hs[:-1]
        by = by[np.append(same, False) | np.insert(same, 0, False)] if len(hs) else by
        h, cls, n = h[by], cls[by], n[by]
        by = np.lexsort((cls, h))
        h, cls, n = h[by], cls[by], n[by]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (cls[1:] != cls[:-1])
        h, cls, n = h[first], cls[first], n[first]
        _, place, times = np.unique(h, return_inverse=True, return_counts=True)
        times = times[place]
        keep = times > 1
        return pd.DataFrame({"cls": cls[keep], "n": n[keep], "h": h[keep], "df": times[keep].astype(np.int32)})

    dealt = df.select(F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).mapInArrow(deal, "bucket int, h binary, cls binary, n binary, times binary")
    return dealt.groupBy("bucket").applyInPandas(count, "cls long, n int, h long, df int")


class Meeting:
    """A prefix tree over some classes' sets, with the links found in it (a forest: one edge joins two components)."""

    def __init__(self, sets: list[np.ndarray], sizes: list[int], roots: list[int], percent: int):
        self.sizes, self.percent = sizes, percent
        self.parent = list(range(len(sets)))
        seen: dict[int, int] = {}
        for k, r in enumerate(roots):  # known components
            self.parent[k] = seen.setdefault(r, k)
        flat = np.concatenate(sets)
        _, inverse, times = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(times), np.int64)
        rank[np.argsort(-times, kind="stable")] = np.arange(len(times))
        ranks = rank[inverse]
        cut = np.cumsum([0, *(len(s) for s in sets)])
        self.sets = [np.sort(ranks[a:b]).tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        # A node: [tokens, children by first token, members that end here, most tokens below it, smallest set below, a member]
        self.root = [[], {}, [], 0, 1 << 60, -1]
        self.links: list[tuple[int, int]] = []

    def find(self, k: int) -> int:
        p = self.parent
        while p[k] != k:
            p[k] = p[p[k]]
            k = p[k]
        return k

    def insert(self, k: int) -> None:
        s, i, node = self.sets[k], 0, self.root
        while True:
            if len(node) > 6 and self.find(node[6]) != self.find(k):
                del node[6:]  # its members are no longer of one component
            node[3] = max(node[3], len(s) - i)
            node[4] = min(node[4], self.sizes[k])
            if i == len(s):
                node[2].append(k)
                return
            child = node[1].get(s[i])
            if child is None:
                node[1][s[i]] = [s[i:], {}, [k], 0, self.sizes[k], k]
                return
            seg, j = child[0], 0
            while j < len(seg) and i + j < len(s) and seg[j] == s[i + j]:
                j += 1
            if j < len(seg):
                lower = [seg[j:], child[1], child[2], child[3], child[4], child[5]]
                child[:] = [seg[:j], {seg[j]: lower}, [], child[3] + len(seg) - j, child[4], child[5]]
            i, node = i + j, child

    def uniform(self, node: list) -> int:
        """The component of all members below a node, or -1 if there are several. Components only grow, so what was found once holds."""
        r = self.find(node[5])
        todo: list[tuple[list, Iterator]] = []
        here = node
        while True:
            if here is not None and not (len(here) > 6 and self.find(here[6]) == r):
                if any(self.find(k) != r for k in here[2]):
                    return -1
                todo.append((here, iter(here[1].values())))
            if not todo:
                return r
            here = next(todo[-1][1], None)
            if here is None:
                done = todo.pop()[0]
                del done[6:]
                done.append(r)

    def probe(self, k: int) -> None:
        """Links k to every component in the tree that has a set close enough."""
        s, size = self.sets[k], self.sizes[k]
        have = set(s)
        at = {t: i for i, t in enumerate(s)}
        todo = [(c, 0, 0) for c in self.root[1].values()]
        while todo:
            node, overlap, passed = todo.pop()
            if self.uniform(node) == self.find(k):
                continue
            seg = node[0]
            got = [t for t in seg if t in have]
            overlap += len(got)
            if got:
                passed = at[got[-1]] + 1
            # what can still be met: of k's set after the last met token, and of the longest set below
            if overlap + min(len(s) - passed, node[3]) < least_overlap(size, max(node[4], need(size, self.percent)), self.percent):
                continue
            for m in node[2]:
                if self.find(m) != self.find(k) and overlap >= least_overlap(size, self.sizes[m], self.percent):
                    self.links.append((k, m))
                    self.parent[self.find(m)] = self.find(k)
            todo += [(c, overlap, passed) for c in node[1].values()]


def meet(cls: list[int], sets: list[np.ndarray], sizes: list[int], roots: list[int], side: list[int], percent: int) -> list[tuple[int, int]]:
    """Links between the classes of one meeting; with two sides only those between them."""
    m = Meeting(sets, sizes, roots, percent)
    order = sorted(range(len(cls)), key=lambda k: (side[k], sizes[k], cls[k]))
    two = len(set(side)) > 1
    for k in order:
        if not two or side[k]:
            m.probe(k)
        if not two or not side[k]:
            m.insert(k)
    return [(cls[a], cls[b]) for a, b in m.links]


def hold(meetings: DataFrame, percent: int) -> DataFrame:
    """Runs meetings (rows key, tile, side, cls, n, root, toks), each one's rows together: (a, b) links."""
    place = ["key", "tile"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []
        for batch in batches:
            key, tile, side, cls, n, root = (batch.column(i).to_pylist() for i in range(6))
            toks = batch.column(6)
            for i in range(batch.num_rows):
                if (key[i], tile[i]) != now:
                    out += _met(rows, percent)
                    now, rows = (key[i], tile[i]), []
                rows.append((cls[i], toks[i].values.to_numpy(), n[i], root[i], side[i]))
            if out:
                yield _edges(out)
                out = []
        yield _edges(_met(rows, percent))

    dealt = meetings.select(*place, "side", "cls", "n", "root", "toks").repartition(*place).sortWithinPartitions(*place)
    return dealt.mapInArrow(run, "a long, b long")


def _met(rows: list, percent: int) -> list[tuple[int, int]]:
    if len(rows) < 2:
        return []
    cls, sets, sizes, roots, side = (list(x) for x in zip(*rows, strict=True))
    return meet(cls, sets, sizes, roots, side, percent) if len(set(roots)) > 1 else []


def _edges(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[i] for e in out], pa.int64()) for i in (0, 1)], ["a", "b"])


def links(df: DataFrame, total: int, percent: int = 85, width: int = 4, hot: dict[int, int] | None = None) -> DataFrame:
    """(a, b): links between classes that have the same components as all links."""
    exact = F.expr(f"cast((n * {percent} + 99) div 100 as int)")
    # Written between its two shuffles, whose files are let go of as soon as they are read: never are both on disk.
    spark = df.sparkSession
    found, found_at = written(shared(df, max(1, -(-total // BUCKET)), width, hot))
    discard(spark)
    sets = found.groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("toks")).where(F.size("toks") >= exact)
    sets = materialize(sets.select("cls", "n", F.col("toks.h").alias("toks"), (F.col("n") - exact + 1 - (F.col("n") - F.size("toks"))).alias("q")))
    discard(spark, found_at)
    # First meetings: at the first and at the last n-gram of the prefix, in blocks.
    ends = sets.select("cls", F.size("toks").alias("m"), F.explode(F.array_distinct(F.array(F.element_at("toks", 1), F.element_at("toks", F.col("q"))))).alias("key"))
    crowd = ends.groupBy("key").agg(F.count("*").alias("count"), F.sum("m").alias("m")).where("count > 1")
    first = ends.drop("m").join(crowd, "key").select("cls", "key", F.pmod(F.xxhash64("cls"), F.ceil(F.col("m") / BLOCK)).alias("tile")).join(sets, "cls")
    edges = materialize(hold(first.select("key", "tile", F.lit(0).alias("side"), "cls", "n", F.col("cls").alias("root"), "toks"), percent))
    known = components(edges)
    # What is left: classes that share an n-gram of their prefixes with another component. All that hang together by such
    # n-grams are one meeting, to which each set goes once, or in tiles of two blocks if it is large.
    rooted = materialize(sets.join(known.withColumnRenamed("id", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")))
    places = rooted.select("cls", "root", F.explode(F.slice("toks", 1, F.col("q"))).alias("key"))
    crowd = places.groupBy("key").agg(F.min("cls").alias("hub"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    family = components(places.join(crowd, "key").select(F.col("cls").alias("a"), F.col("hub").alias("b")).distinct())
    open_ = family.select(F.col("id").alias("cls"), F.col("root").alias("key")).join(rooted, "cls")
    size = open_.groupBy("key").agg(F.ceil(F.sum(F.size("toks")) / BLOCK).cast("long").alias("parts"))
    mine = F.pmod(F.xxhash64("cls"), F.col("parts"))
    # Tiles (i, j) with i <= j; a class of block b sits on side 0 of (b, j) and on side 1 of (i, b); (b, b) has one side.
    tiled = open_.join(size, "key").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    tile = F.least("mine", "other") * F.col("parts") + F.greatest("mine", "other")
    rest = hold(tiled.select("key", tile.alias("tile"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "cls", "n", "root", "toks"), percent)
    return edges.union(materialize(rest))


def _joined(df: DataFrame, percent: int, width: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles and cls of each row, written; cls, least doc_id and root of each class)."""
    docs = materialize(class_of(df, width))
    classes = docs.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("doc_id").alias("least"), F.max("n_shingles").alias("n"))
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    roots = components(links(df, int(total), percent, width, hot_grams(docs)))
    return docs, classes.join(roots.withColumnRenamed("id", "cls"), "cls", "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))


def ngram_join(df: DataFrame, percent: int = 85, width: int = 4) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach, its own included)."""
    docs, named = _joined(df, percent, width)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    final = named.join(least, "root").select("cls", "component_id")
    return docs.join(final, "cls", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def first_of_groups(df: DataFrame, percent: int = 85, width: int = 4) -> DataFrame:
    """The rows of df of which one is left of each component: that of its smallest doc_id (any one if all are null); texts without a set stay.

    Rows that share their doc_id, or have none, are told apart by a key that is written with them.
    """
    docs, named = _joined(df, percent, width)
    rows = docs.select("doc_id", "cls").join(named.select("cls", "root"), "cls", "left")
    first = named.groupBy("root").agg(F.min("least").alias("first"))
    count = docs.groupBy("doc_id").agg(F.count("*").alias("rows"))
    odd = materialize(count.where((F.col("rows") > 1) | F.col("doc_id").isNull()).select("doc_id"))
    gone = rows.join(first, "root").where(F.col("doc_id") != F.col("first")).select("doc_id").distinct()
    if not odd.limit(1).count():
        return df.join(small_side(materialize(gone)), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in df.columns))
    same = unused(df, "same")
    key, cls = unused(df, "key"), unused(df, "cls")
    odd = small_side(odd).withColumnRenamed("doc_id", same)
    is_odd = df["doc_id"].eqNullSafe(F.col(same))
    plain = df.join(odd, is_odd, "left_anti").join(small_side(materialize(gone)), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in df.columns))
    held = with_texts(df.join(odd, is_odd, "left_semi").withColumn(key, F.monotonically_increasing_id()), cls, LongType(), lambda texts: [signature(s) if len(s) else None for s in shingle_sets(texts, width)])
    held = materialize(held)
    mine = held.select(F.col(key).alias("key"), F.col(cls).alias("cls"), "doc_id").join(named.select("cls", "root"), "cls").join(first, "root")
    one = mine.where(F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("root").agg(F.min("key").alias("key"))
    lost = materialize(mine.select("key").join(one.select("key"), "key", "left_anti").withColumnRenamed("key", key))
    return plain.unionByName(held.join(small_side(lost), key, "left_anti").select(*(F.col(f"`{c}`") for c in df.columns)))
