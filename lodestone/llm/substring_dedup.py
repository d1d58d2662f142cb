"""Substring dedup by recompression: long word sequences that repeat across documents lose all but their first place.

A text is parsed by rounds of recompression. First, runs of one token become a symbol named by the token and the run's
length. Then, LEVELS times, each symbol falls to the left or the right side by a bit of its name, and each left symbol
followed by a right one becomes a new symbol, named by the two names. What is merged depends on the neighbours only: of
a window's symbols, those that an outside neighbour could change stand at its ends, and what is inside (its stable
interior, kept exactly through the levels) is the same wherever the window stands. Names are 64-bit fingerprints, so
that map tasks build them; Spark's rounds look them up globally, packed by hash buckets:

1. All names of the last level, and one for each whole text, are sent to their buckets, which answer with two bits:
   whether another document has the name, and whether one with a smaller id has it. Texts that a smaller document has as
   a whole are removed. A window stays a candidate only if every symbol of its stable interior is shared (windows whose
   interior is empty, as in long runs, stay).
2. The candidates are verified as wholes: two independent fingerprints of the 50 words, of which one chooses the bucket
   and one is compared there, are answered in the same way. Windows that a smaller document has are removed.

Texts are kept as compressed chunks, so that both rounds move them once; documents without candidates end in the first.
Bucket rows are at most as many as names. A name that very many chunks have puts one entry of each in one bucket.

Edge cases: null and empty texts have no words; texts shorter than a window lose nothing. Rows that repeat an id are
one document, which doesn't remove its own words; rows without an id come after all others, and don't remove each
other's words. A long text is a chunk of its own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import discard, steps, written
from .words import SPACED, U, mix, words

#: Bytes of text of a chunk, rounds of pairs, and names of a bucket.
CHUNK, LEVELS, BUCKET = 4 << 20, 7, 1 << 20
NONE = np.iinfo(np.int64).max
_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_SALT = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)]
SHARED, SMALLER = 1, 2
RESULT = "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_sha256 string, text string"


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


@lru_cache(maxsize=4)
def _powers(which: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    base = _BASES[which]
    return tuple(np.cumprod(np.concatenate([[U(1)], np.full(size, U(b), U)]), dtype=U) for b in (base, pow(base, -1, 1 << 64)))


class Prints:
    """Fingerprints of stretches of words from prefix sums."""

    def __init__(self, h: np.ndarray, which: int):
        size = 1 << max(10, len(h).bit_length())
        self.power, self.inverse = _powers(which, size)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([[U(0)], np.cumsum(mix(h ^ _SALT[which]) * self.power[: len(h)], dtype=U)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + U(1))


def parse(h: np.ndarray, doc: np.ndarray, first: np.ndarray, width: int, levels: int = LEVELS):
    """(names, documents of the symbols; low, high): windows that start at the words `first` have the symbols low..high-1 as stable interior, at the last level."""
    if not len(h):
        return h, doc, first, first
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    size = np.diff(np.append(starts, len(h))).astype(U)
    names, home = np.where(size > 1, mix(h[starts] ^ mix(size)), h[starts]), doc[starts]
    low, high = run[first] + 1, run[first + width - 1]
    with np.errstate(over="ignore"):
        for level in range(levels):
            left = mix(names ^ mix(U(level + 1))) & U(1) == U(1)
            pair = np.zeros(len(names), bool)
            pair[:-1] = left[:-1] & ~left[1:] & (home[1:] == home[:-1])
            # A right symbol that comes first may belong to a pair outside; so may a left one that comes last.
            low = low + ~np.append(left, True)[low]
            high = high - ((high > low) & left[high - 1])
            keep = np.append(True, ~pair[:-1])
            at = np.cumsum(keep) - 1
            low, high = np.append(at, at[-1] + 1)[low], np.where(high > 0, at[high - 1] + 1, 0)
            joined = mix(names * U(_BASES[0]) + mix(np.append(names[1:], U(0))) * U(_BASES[1]))
            names, home = np.where(pair, joined, names)[keep], home[keep]
    return names, home, low, high


class Chunk:
    """A chunk's texts as words, and the windows that fit into its documents."""

    def __init__(self, texts: list[bytes], ids: list, width: int):
        self.texts, self.ids, self.width = texts, np.array([NONE if i is None else i for i in ids], np.int64), width
        self.doc, _, _, self.h, _ = words(texts, SPACED, lower=False)
        self.ends = np.cumsum(np.bincount(self.doc, minlength=len(texts)))
        self.starts = np.append(0, self.ends[:-1])
        at = np.arange(max(0, len(self.h) - width + 1))
        self.first = at[self.doc[at] == self.doc[at + width - 1]]
        self.long = np.flatnonzero(self.ends - self.starts >= width)

    def symbols(self):
        """Names of the last level's symbols, with their documents, then of the long texts; and the interiors of the windows."""
        names, home, low, high = parse(self.h, self.doc, self.first, self.width)
        whole = Prints(self.h, 0).of(self.starts[self.long], self.ends[self.long]) ^ _SALT[2]
        return np.concatenate([names, whole]), np.concatenate([home, self.long]), low, high

    def windows(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two fingerprints of the windows that start at the words `some`."""
        return tuple(Prints(self.h, k).of(some, some + self.width) for k in (0, 1))


def distinct(names: np.ndarray, keys: np.ndarray, ids: np.ndarray):
    """(names, keys, smallest ids, whether other ids are there too, each input's place) of the distinct (name, key)."""
    order = np.lexsort((names, keys))
    new = np.ones(len(order), bool)
    new[1:] = (names[order][1:] != names[order][:-1]) | (keys[order][1:] != keys[order][:-1])
    at = np.flatnonzero(new)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    if not len(at):
        return names, keys, ids, np.zeros(0, bool), place
    least = np.minimum.reduceat(ids[order], at)
    return names[order][at], keys[order][at], least, np.maximum.reduceat(ids[order], at) != least, place


def _key(names: np.ndarray) -> np.ndarray:
    return (mix(names ^ _SALT[1]) >> U(32)).astype(np.uint32)


def _packed(names: np.ndarray, keys: np.ndarray, ids: np.ndarray, many: np.ndarray) -> bytes:
    """Names in the order of their keys, ids as small offsets."""
    low = int(ids.min()) if len(ids) else 0
    off = (ids.astype(U) - U(low % (1 << 64))) if len(ids) else ids.astype(U)
    off = off.astype(next(t for t in (np.uint16, np.uint32, U) if int(off.max(initial=0)) <= np.iinfo(t).max))
    return pickle.dumps((names, keys, low, off, np.packbits(many)), 5)


def _ids(low: int, off: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (off.astype(U) + U(low % (1 << 64))).astype(np.int64)


def answers(asked: DataFrame) -> DataFrame:
    """(chunk, bits) for written rows of (chunk, n, asks): for each distinct name, in the order of its keys, whether other documents, and smaller ones than the chunk's smallest, have it."""
    total = asked.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET))
    sent, back = _arrow("bucket int, chunk long, asks binary"), _arrow("chunk long, bucket int, bits binary")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names, keys, low, off, many = pickle.loads(value.as_buffer())
                many = np.unpackbits(many, count=len(names)).astype(bool)
                to = (keys.astype(U) * U(buckets) >> U(32)).astype(np.int64)  # ascending, as the keys are
                cut = np.append(np.flatnonzero(np.diff(to, prepend=-1)), len(to)).tolist()
                rows = [(int(to[a]), chunk, _packed(names[a:b], keys[:0], _ids(low, off[a:b]), many[a:b])) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), sent, strict=True)], schema=sent)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for batch in batches for r in batch.to_pylist()]
        if not held:
            return
        asks = [pickle.loads(r.pop("asks")) for r in held]
        names, ids = np.concatenate([a[0] for a in asks]), np.concatenate([_ids(a[2], a[3]) for a in asks])
        many = np.concatenate([np.unpackbits(a[4], count=len(a[0])) for a in asks]).astype(bool)
        order = np.argsort(names, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = names[order][1:] != names[order][:-1]
        at, group = np.flatnonzero(new), np.cumsum(new) - 1
        least = np.minimum.reduceat(ids[order], at)
        shared = (np.maximum.reduceat(ids[order], at) != least) | np.logical_or.reduceat(many[order], at)
        bits = np.empty(len(order), np.uint8)
        bits[order] = shared[group] * SHARED + (least[group] < ids[order]) * SMALLER
        parts = np.split(bits, np.cumsum([len(a[0]) for a in asks])[:-1])
        yield pa.RecordBatch.from_arrays([pa.array([r["chunk"] for r in held], pa.int64()), pa.array([r["bucket"] for r in held], pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], schema=back)

    met = asked.select("chunk", "asks").mapInArrow(deal, "bucket int, chunk long, asks binary").repartitionById(buckets, "bucket").mapInArrow(meet, "chunk long, bucket int, bits binary")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("bucket", "bits"))), lambda x: x["bits"])
    return met.groupBy("chunk").agg(ordered.alias("bits"))


def _bits(parts: list[bytes] | None) -> np.ndarray:
    return np.frombuffer(b"".join(parts or []), np.uint8)


def _result(doc_id, text: bytes, removed: np.ndarray, texts: bool) -> tuple:
    """A document's row, from a flag for each word."""
    found = text.split()
    edge = np.flatnonzero(np.diff(removed.astype(np.int8), prepend=0, append=0)).tolist()
    spans = [{"start": a, "end": b} for a, b in zip(edge[::2], edge[1::2], strict=True)]
    kept = b" ".join([w for w, gone in zip(found, removed.tolist(), strict=True) if not gone] if spans else found)
    return doc_id, len(found), int(removed.sum()), spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if texts else None


def _rows(rows: list[tuple]) -> list[dict]:
    return [dict(zip(("doc_id", "n_words", "n_removed", "removed", "kept_sha256", "text"), r, strict=True)) for r in rows]


def _blob(texts: list[bytes]) -> bytes:
    return zstandard.compress(pickle.dumps(texts, 5), 1)


def _texts(blob: bytes) -> list[bytes]:
    return pickle.loads(zstandard.decompress(blob))


def substring_dedup(docs: DataFrame, width: int = 50, texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept_sha256, text) of every document.

    removed has the spans of words, from 0, that a window of `width` words covers which also stands in a document of a
    smaller id. kept_sha256 is the digest of the other words, joined by spaces; text has them if `texts` is set.
    """
    spark = docs.sparkSession
    begun_ddl = "chunk long, ids array<long>, blob binary, n long, asks binary"
    resolved_ddl = f"chunk long, ids array<long>, blob binary, alive binary, n long, asks binary, done array<{StructType.fromDDL(RESULT).simpleString()}>"
    begun, resolved = _arrow(begun_ddl), _arrow(resolved_ddl)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            for ids, some in steps(batch.column(0).to_pylist(), batch.column(1).to_pylist(), CHUNK):
                c = Chunk(some, ids, width)
                names, home, _, _ = c.symbols()
                names, keys, least, many, _ = distinct(names, _key(names), c.ids[home])
                row = [next(number)], [ids], [_blob(some)], [len(names)], [_packed(names, keys, least, many)]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, begun, strict=True)], schema=begun)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                some, ids = _texts(r["blob"]), r["ids"]
                c = Chunk(some, ids, width)
                names, home, low, high = c.symbols()
                _, _, least, _, place = distinct(names, _key(names), c.ids[home])
                bits, symbols = _bits(r["bits"])[place], len(names) - len(c.long)
                smaller = (bits[symbols:] & SMALLER > 0) | (least[place[symbols:]] < c.ids[c.long])
                copy = np.zeros(len(some), bool)
                copy[c.long[smaller]] = True
                lone = np.append(0, np.cumsum(bits[:symbols] & SHARED == 0))
                alive = c.first[((high <= low) | (lone[high] == lone[np.minimum(low, high)])) & ~copy[c.doc[c.first]]]
                open_ = np.zeros(len(some), bool)
                open_[c.doc[alive]] = True
                done = [_result(ids[k], some[k], np.full(c.ends[k] - c.starts[k], copy[k]), texts) for k in np.flatnonzero(~open_).tolist()]
                one, two = c.windows(alive)
                one, keys, least, many, _ = distinct(one, (two >> U(32)).astype(np.uint32), c.ids[c.doc[alive]])
                mask = np.zeros(len(c.h), bool)
                mask[alive] = True
                left = np.flatnonzero(open_).tolist()
                row = [r["chunk"]], [[ids[k] for k in left]], [_blob([some[k] for k in left])], [np.packbits(mask[open_[c.doc]]).tobytes()], [len(one)], [_packed(one, keys, least, many)], [_rows(done)]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, resolved, strict=True)], schema=resolved)

    final = _arrow(RESULT)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                some, ids = _texts(r["blob"]), r["ids"]
                c = Chunk(some, ids, width)
                alive = np.flatnonzero(np.unpackbits(np.frombuffer(r["alive"], np.uint8), count=len(c.h)))
                one, two = c.windows(alive)
                owner = c.ids[c.doc[alive]]
                _, _, least, _, place = distinct(one, (two >> U(32)).astype(np.uint32), owner)
                gone = alive[(_bits(r["bits"])[place] & SMALLER > 0) | (least[place] < owner)]
                edge = np.zeros(len(c.h) + 1, np.int64)
                np.add.at(edge, gone, 1)
                np.add.at(edge, gone + width, -1)
                covered = np.cumsum(edge[:-1]) > 0
                rows = [_result(i, t, covered[a:b], texts) for i, t, a, b in zip(ids, some, c.starts.tolist(), c.ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pylist(_rows(rows), schema=final)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    chunks, at_chunks = written(source.mapInArrow(begin, begun_ddl))
    known = chunks.select("chunk", "ids", "blob").join(answers(chunks), "chunk", "left")
    rest, _ = written(known.mapInArrow(resolve, resolved_ddl))
    discard(spark, at_chunks)
    done = rest.select(F.explode("done").alias("x")).select("x.*")
    left = rest.where("n > 0")
    return done.unionByName(left.select("chunk", "ids", "blob", "alive").join(answers(left), "chunk", "left").mapInArrow(finish, RESULT))
