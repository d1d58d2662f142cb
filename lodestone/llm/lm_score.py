"""Language-model scores: a hierarchical Pitman-Yor model of word pairs, beside an add-one unigram base.

Every word of the training texts is a context and has a restaurant, whose dishes are the words behind it; all of them
share one parent, the restaurant of all words, over a uniform base. A table of a context's restaurant is a customer of
the parent's. Nothing has a fixed size: words, contexts and pairs are counted over all training texts, and the tables
that hold them are dealt over shards whose number grows with the texts.

1. Words are counted. Texts' pairs are counted once per flush and dealt by context, and each shard sums its restaurants.
   Contexts with more than SHARD customers are dealt by context and word; at most HOT of them exist.
2. A dish of one customer has one table. The tables of the others are drawn by Gibbs sweeps inside their shard, given the
   parent's probability of each dish; the tables' sums go to the words' shards as customers of the parent, which is
   sampled likewise and answers with new probabilities. Both levels take turns for `rounds`; means are over the sweeps
   after burn-in. Each shard sees the others' tables as of the round before. Discounts follow from the numbers of dishes
   with one and two customers.
3. Texts are grouped into packs. A pack asks the shards for its distinct words and pairs, and gets back, in the same
   order, counts and predictive terms; the text's score is the sum over its tokens. Packs are answered in BLOCKS parts.

Words of contexts are told apart by 48 bits of their hash, words themselves by 64. Edge cases: a null text is an empty
one: its one token is the end; a null doc_id counts as fold 0; without training rows every count is 0 and both models are
uniform; repeated rows are answered each on its own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fold, materialize, steps, written
from .pitman_yor import seat_alike, sweep
from .words import END, U, get48, mix, put48, words

#: Tokens of a flush or pack, training tokens of a shard, and the largest number of contexts that are split.
PACK, SHARD, HOT = 1 << 19, 1 << 20, 1 << 16
#: Parts of the packs that are scored one after the other, so that what they ask and are answered is never on disk as a whole.
BLOCKS = 6
ROW = "key long, kind int, src long, a binary, b binary, c binary, x double, y double"
WORDS, SINGLES, ASKED, MODEL, PARENT, PRIOR, TABLES, SEATED, ASK_WORDS, ASK_PAIRS, ALONE = range(11)
STRENGTH, SWEEPS, BURN = 1.0, 4, 1


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Document index and hash of every token; each text ends with END."""
    doc, _, _, h, _ = words(texts)
    at = np.searchsorted(doc, np.arange(1, len(texts) + 1))
    return np.insert(doc, at, np.arange(len(texts))), np.insert(h, at, END)


def _many_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """tokens() of any number of texts, with little memory beside the result."""
    docs, hs, first = [np.zeros(0, np.int64)], [np.zeros(0, U)], 0
    for _, some in steps(texts, texts):
        doc, h = tokens(some)
        docs.append(doc + first)
        hs.append(h)
        first += len(some)
    return np.concatenate(docs), np.concatenate(hs)


def _text_only(df: DataFrame) -> DataFrame:
    return df.select(F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def _size():
    """Bytes of a row's text and of what stands for its end."""
    return F.coalesce(F.octet_length("text"), F.lit(0)) + 8


def _flushes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Document index and hash of the tokens of about PACK tokens of texts at a time."""
    held, size, first = [], 0, 0
    for batch in batches:
        for _, texts in steps([None] * batch.num_rows, batch.column(0).to_pylist()):
            doc, h = tokens(texts)
            held.append((doc + first, h))
            first, size = first + len(texts), size + len(h)
            if size >= PACK:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, size, first = [], 0, 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


class Rows:
    """Rows of ROW, as a batch or a pandas frame."""

    def __init__(self):
        self.columns: list[list] = [[] for _ in range(8)]

    def add(self, key: int, kind: int, src: int, a: bytes = b"", b: bytes = b"", c: bytes = b"", x: float = 0.0, y: float = 0.0) -> None:
        for column, value in zip(self.columns, (int(key), kind, int(src), a, b, c, float(x), float(y)), strict=True):
            column.append(value)

    def batch(self) -> pa.RecordBatch:
        types = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(self.columns, types, strict=True)], [x.split()[0] for x in ROW.split(", ")])

    def frame(self) -> pd.DataFrame:
        return self.batch().to_pandas()


def _short(h: np.ndarray) -> np.ndarray:
    return h >> U(16)


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a 64-bit hash, in the hash's order."""
    return ((h >> U(32)) * U(shards) >> U(32)).astype(np.int64)


def _dealt(shard: np.ndarray, shards: int) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of each run of an ordered array."""
    cut = np.searchsorted(shard, np.arange(shards + 1))
    for k in np.flatnonzero(np.diff(cut)).tolist():
        yield k, int(cut[k]), int(cut[k + 1])


class Pairs:
    """The distinct words of some texts and their distinct pairs, ordered by the shard that holds them."""

    def __init__(self, doc: np.ndarray, h: np.ndarray, shards: int, hot: np.ndarray, parts: np.ndarray, inverse: bool = False):
        self.words, ids = np.unique(h, return_inverse=True)
        pair = np.full(len(h), np.searchsorted(self.words, END), np.int64)
        pair[1:] = np.where(doc[1:] == doc[:-1], ids[:-1], pair[1:])
        pair <<= 32
        pair |= ids
        self.ids = ids.astype(np.int32)
        del ids
        if inverse:  # each token's pair, for its score
            pair, at, times = np.unique(pair, return_inverse=True, return_counts=True)
            self.inverse = at.astype(np.int32)
            del at
        else:
            pair, times = np.unique(pair, return_counts=True)
        times = times.astype(np.uint32)
        v, w = (pair >> 32).astype(np.int32), (pair & 0xFFFFFFFF).astype(np.int32)
        del pair
        shard = _shard(self.words, shards)[v]
        if len(hot):
            at = np.minimum(np.searchsorted(hot, self.words), len(hot) - 1)
            n = np.where(hot[at] == self.words, parts[at], 1)[v]
            some = np.flatnonzero(n > 1)
            part = (_short(self.words[w[some]]) % n[some].astype(U)).astype(U)
            with np.errstate(over="ignore"):
                shard[some] = _shard(mix(self.words[v[some]] + part * U(0x9E3779B97F4A7C15)), shards)
        self.by = np.argsort(shard, kind="stable")
        self.v, self.w, self.times, self.shard = v[self.by], w[self.by], times[self.by], shard[self.by]

    def segments(self, shards: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """(shard, from, to, contexts, pairs of each context)."""
        for k, a, b in _dealt(self.shard, shards):
            v = self.v[a:b]
            first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            yield k, a, b, self.words[v[first]], np.diff(np.append(first, b - a)).astype(np.uint32)


def _grouped(df: DataFrame, f) -> DataFrame:
    return df.groupBy("key").applyInPandas(f, ROW)


def _of(rows: pd.DataFrame, kind: int) -> pd.DataFrame:
    return rows[rows["kind"] == kind]


def word_rows(train: DataFrame, shards: int) -> DataFrame:
    """WORDS rows: each shard's words and counts, in order, with their sum and number; of the words that are more often than SHARD, again in c."""

    def deal(batches):
        for _, h in _flushes(batches):
            h, c = np.unique(h, return_counts=True)
            out = Rows()
            for k, a, b in _dealt(_shard(h, shards), shards):
                out.add(k, WORDS, 0, h[a:b].tobytes(), c[a:b].astype(np.uint32).tobytes())
            yield out.batch()

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        h, c = np.frombuffer(b"".join(rows["a"]), U), np.frombuffer(b"".join(rows["b"]), np.uint32).astype(np.int64)
        by = np.argsort(h)
        h = h[by]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        h, c, out = h[first], np.add.reduceat(c[by], first), Rows()
        often = c > SHARD
        out.add(rows["key"].iloc[0], WORDS, 0, h.tobytes(), c.tobytes(), h[often].tobytes() + c[often].tobytes(), c.sum(), len(c))
        return out.frame()

    return _grouped(_text_only(train).mapInArrow(deal, ROW), count)


def _words(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = _of(rows, WORDS)
    return np.frombuffer(b"".join(rows["a"]), U), np.frombuffer(b"".join(rows["b"]), np.int64)  # one row


def restaurants(train: DataFrame, shards: int, hot: np.ndarray, parts: np.ndarray) -> DataFrame:
    """MODEL (a shard's contexts with their dishes of one customer, and the other dishes), SINGLES (the former, by word) and ASKED (the words whose probabilities the shard needs)."""

    def deal(batches):
        for doc, h in _flushes(batches):
            p, out = Pairs(doc, h, shards, hot, parts), Rows()
            short = _short(p.words)
            for k, a, b, v, n in p.segments(shards):
                out.add(k, MODEL, 0, v.tobytes() + n.tobytes(), put48(short[p.w[a:b]]), p.times[a:b].tobytes())
            yield out.batch()

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        v, w, c = [], [], []
        for a, b, t in zip(rows["a"], rows["b"], rows["c"], strict=True):
            k = len(a) // 12
            v.append(np.repeat(np.frombuffer(a, U, k), np.frombuffer(a, np.uint32, k, 8 * k)))
            w.append(get48(b))
            c.append(np.frombuffer(t, np.uint32))
        v, w, c = np.concatenate(v), np.concatenate(w), np.concatenate(c).astype(np.int64)
        by = np.lexsort((w, v))
        v, w = v[by], w[by]
        first = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (w[1:] != w[:-1])))
        v, w, c = v[first], w[first], np.add.reduceat(c[by], first)
        one, out = c == 1, Rows()
        contexts, room = np.unique(v, return_inverse=True)
        singles = np.bincount(room[one], minlength=len(contexts)).astype(np.uint32)
        more = np.bincount(room[~one], minlength=len(contexts)).astype(np.uint32)
        out.add(rows["key"].iloc[0], MODEL, 0, contexts.tobytes() + singles.tobytes() + more.tobytes(), put48(w[~one]), c[~one].astype(np.uint32).tobytes(), one.sum(), (c == 2).sum())
        # Dishes of one customer are found again among the pairs that are asked for: kept as words, by context.
        out.add(rows["key"].iloc[0], ALONE, 0, put48(w[one]))
        for kind, some in ((SINGLES, w[one]), (ASKED, w[~one])):
            u, n = np.unique(some, return_counts=True)
            for k, a, b in _dealt(_shard(u << U(16), shards), shards):
                out.add(k, kind, rows["key"].iloc[0], put48(u[a:b]), n[a:b].astype(np.uint32).tobytes())
        return out.frame()

    return _grouped(_text_only(train).mapInArrow(deal, ROW), count)


def parents(rows: DataFrame, vocabulary: int, total: float, d: float, seed: int) -> DataFrame:
    """PARENT rows: customers and mean tables of a shard's words in the restaurant of all words. total: its tables before."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        h, _ = _words(rows)
        short, c = _short(h), np.zeros(len(h))
        asked = {}
        for src, a, n in _of(rows, ASKED)[["src", "a", "b"]].itertuples(index=False):
            asked[src] = np.searchsorted(short, get48(a)), np.frombuffer(n, np.uint32)
        for a, n in _of(rows, SINGLES)[["a", "b"]].itertuples(index=False):
            np.add.at(c, np.searchsorted(short, get48(a)), np.frombuffer(n, np.uint32))
        seated = dict(_of(rows, TABLES)[["src", "a"]].itertuples(index=False))
        for src, (at, n) in asked.items():  # before the first round each dish has one table
            np.add.at(c, at, np.frombuffer(seated[src], np.float32) if src in seated else n)
        c = np.round(c).astype(np.int64)
        elsewhere, t, mean = max(0.0, total - (c > 0).sum()), np.minimum(c, 1), np.zeros(len(c))
        r = np.random.default_rng([seed, int(rows["key"].iloc[0])])
        for k in range(SWEEPS):  # all words have one prior; beside all tables, a word's own ones are as good as one
            t = seat_alike(c, 1 / (vocabulary + 1), STRENGTH + d * max(0.0, elsewhere + t.sum() - 1), d, r)
            mean += t * (k >= BURN) / (SWEEPS - BURN)
        out = Rows()
        out.add(rows["key"].iloc[0], PARENT, 0, c.tobytes(), mean.astype(np.float32).tobytes(), b"", c.sum(), mean.sum())
        return out.frame()

    return _grouped(rows, run)


class Parent:
    """Predictive probabilities of the restaurant of all words."""

    def __init__(self, vocabulary: int, customers: float, tables: float, d: float):
        self.back = (STRENGTH + d * tables) / (vocabulary + 1)
        self.all, self.d = STRENGTH + customers, d

    def __call__(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        return (c - self.d * t + self.back) / self.all


def _parent_of(rows: pd.DataFrame, parent: Parent) -> np.ndarray:
    one = _of(rows, PARENT)
    if not len(one):
        return np.zeros(0)
    return parent(np.frombuffer(one["a"].iloc[0], np.int64), np.frombuffer(one["b"].iloc[0], np.float32))


def priors(rows: DataFrame, parent: Parent) -> DataFrame:
    """PRIOR rows: the parent's probabilities of the words that a shard asked for, in its order."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        h, _ = _words(rows)
        p, out = _parent_of(rows, parent), Rows()
        short = _short(h)
        for src, a in _of(rows, ASKED)[["src", "a"]].itertuples(index=False):
            out.add(src, PRIOR, rows["key"].iloc[0], p[np.searchsorted(short, get48(a))].astype(np.float64).tobytes())
        return out.frame()

    return _grouped(rows, run)


def _model(rows: pd.DataFrame):
    """(contexts, dishes of one customer and others by context, the latter's words and customers) of a shard."""
    row = _of(rows, MODEL).iloc[0]
    k = len(row["a"]) // 16
    contexts = np.frombuffer(row["a"], U, k)
    singles, more = np.frombuffer(row["a"], np.uint32, 2 * k, 8 * k).reshape(2, k).astype(np.int64)
    return contexts, singles, more, get48(row["b"]), np.frombuffer(row["c"], np.uint32).astype(np.int64)


def seatings(rows: DataFrame, shards: int, d: float, hot: np.ndarray, elsewhere: np.ndarray, seed: int) -> DataFrame:
    """TABLES (tables by word, for the words' shards) and SEATED (mean tables of each dish; of split contexts also their sum). elsewhere: tables of split contexts in all shards."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if not len(_of(rows, MODEL)):
            return Rows().frame()
        key = int(rows["key"].iloc[0])
        contexts, singles, more, w, c = _model(rows)
        asked, at = np.unique(w, return_inverse=True)
        prior = _of(rows, PRIOR).sort_values("src")  # shards follow the words' order
        p0 = np.frombuffer(b"".join(prior["a"]), np.float64)[at] if len(w) else np.zeros(0)
        room = np.repeat(np.arange(len(contexts)), more)
        fixed = singles.astype(float)
        split = np.flatnonzero(np.isin(contexts, hot)) if len(hot) else np.zeros(0, np.int64)
        if len(split):
            fixed[split] += np.maximum(elsewhere[np.searchsorted(hot, contexts[split])] - singles[split] - more[split], 0)
        mean, last = sweep(room, len(contexts), c, fixed, p0, d, STRENGTH, np.random.default_rng([seed, key]), SWEEPS, BURN)
        out, sums = Rows(), np.bincount(at, last, len(asked)).astype(np.float32)
        for k, a, b in _dealt(_shard(asked << U(16), shards), shards):
            out.add(k, TABLES, key, sums[a:b].tobytes())
        tables = singles + np.bincount(room, mean, len(contexts))
        out.add(key, SEATED, 0, mean.astype(np.float32).tobytes(), contexts[split].tobytes(), tables[split].tobytes())
        return out.frame()

    return _grouped(rows, run)


def answer_tables(rows: DataFrame, d: float, hot: np.ndarray, hot_c: np.ndarray, elsewhere: np.ndarray) -> DataFrame:
    """One row for each shard: contexts with what goes to the parent and the customers; ordered keys of the dishes of one customer, and of the others with their customers less discounts."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        contexts, singles, more, w, c = _model(rows)
        alone, mean = get48(_of(rows, ALONE)["a"].iloc[0]), np.frombuffer(_of(rows, SEATED)["a"].iloc[0], np.float32)
        room = np.repeat(np.arange(len(contexts)), more)
        tables, customers = singles + np.bincount(room, mean, len(contexts)), singles + np.bincount(room, c, len(contexts))
        split = np.flatnonzero(np.isin(contexts, hot)) if len(hot) else np.zeros(0, np.int64)
        if len(split):
            at = np.searchsorted(hot, contexts[split])
            tables[split], customers[split] = elsewhere[at], hot_c[at]
        back, over = ((STRENGTH + d * tables) / (STRENGTH + customers)).astype(np.float32), (STRENGTH + customers).astype(np.float32)
        one, others = np.sort(_pair_keys(np.repeat(np.arange(len(contexts)), singles), alone)), _pair_keys(room, w)
        by, out = np.argsort(others), Rows()
        out.add(rows["key"].iloc[0], MODEL, 0, contexts.tobytes() + back.tobytes() + over.tobytes(), put48(one), put48(others[by]) + (c - d * mean)[by].astype(np.float32).tobytes())
        return out.frame()

    return _grouped(rows, run)


def _split_tables(seated: DataFrame, hot: np.ndarray) -> np.ndarray:
    """The tables of each split context over all shards; one small row for each shard that has any."""
    out = np.zeros(len(hot))
    for r in seated.where((F.col("kind") == SEATED) & (F.length("b") > 0)).select("b", "c").toLocalIterator():
        np.add.at(out, np.searchsorted(hot, np.frombuffer(r["b"], U)), np.frombuffer(r["c"], np.float64))
    return out


class PitmanYorModel:
    """The written tables of a model, and the few numbers that all tasks need."""

    def __init__(self, train: DataFrame, rounds: int = 2, seed: int = 17):
        spark = train.sparkSession
        size = train.agg(F.coalesce(F.sum(_size()), F.lit(0))).first()[0]
        self.shards = max(1, -(-int(size) // (6 * SHARD)))  # a token has about 6 bytes
        self.words, _ = written(word_rows(train, self.shards))
        n, v = self.words.agg(F.coalesce(F.sum("x"), F.lit(0.0)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
        self.n, self.v = int(n), int(v)
        often = [(np.frombuffer(r["c"], U, len(r["c"]) // 16), np.frombuffer(r["c"], np.int64, len(r["c"]) // 16, len(r["c"]) // 2)) for r in self.words.where(F.length("c") > 0).select("c").toLocalIterator()]
        h, c = (np.concatenate([x[k] for x in often]) if often else np.zeros(0, t) for k, t in ((0, U), (1, np.int64)))
        top = np.argsort(-c, kind="stable")[:HOT]
        by = np.argsort(h[top])
        self.hot, self.hot_c = h[top][by], c[top][by]
        self.parts = -(-self.hot_c // SHARD)
        found, place = written(restaurants(train, self.shards, self.hot, self.parts), "kind")
        kind, old = F.col("kind"), []
        one, two = found.where(kind == MODEL).agg(F.coalesce(F.sum("x"), F.lit(0.0)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
        self.d = min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5
        asked, tables, total = found.where(kind.isin(SINGLES, ASKED)), None, float(self.v)
        elsewhere, before = np.zeros(len(self.hot)), []
        for k in range(rounds + 1):
            rows = self.words.union(asked) if tables is None else self.words.union(asked).union(tables)
            self.parent, parent_at = written(parents(rows, self.v, total, 0.5, seed + k))
            discard(spark, *old)
            customers, total = (float(x or 0) for x in self.parent.agg(F.sum("x"), F.sum("y")).first())
            self.predict = Parent(self.v, customers, total, 0.5)
            if k < rounds:
                answers = priors(self.words.union(self.parent).union(asked.where(kind == ASKED)), self.predict)
                got, got_at = written(seatings(found.where(kind == MODEL).union(answers), self.shards, self.d, self.hot, elsewhere, seed + 100 + k), "kind")
                seated, tables = got.where(kind == SEATED), got.where(kind == TABLES)
                elsewhere = _split_tables(got, self.hot)
                old = [parent_at, *before]
                before = [got_at]
        discard(spark, f"{place}/kind={SINGLES}", f"{place}/kind={ASKED}", f"{got_at}/kind={TABLES}")
        self.tables, _ = written(answer_tables(found.where(kind.isin(MODEL, ALONE)).union(seated), self.d, self.hot, self.hot_c, elsewhere))
        discard(spark, place, got_at)


def _asks(model_shards: int, hot: np.ndarray, parts: np.ndarray):
    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        doc, h = _many_tokens(list(rows["text"]))
        p, out, pack = Pairs(doc, h, model_shards, hot, parts), Rows(), int(rows["pack"].iloc[0])
        for k, a, b in _dealt(_shard(p.words, model_shards), model_shards):
            out.add(k, ASK_WORDS, pack, p.words[a:b].tobytes())
        short = _short(p.words)
        for k, a, b, v, n in p.segments(model_shards):
            out.add(model_shards + k, ASK_PAIRS, pack, v.tobytes() + n.tobytes(), put48(short[p.w[a:b]]))
        return out.frame()

    return ask


def _among(ordered: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each x is among the ordered numbers, and where."""
    if not len(ordered):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)
    return ordered[at] == x, at


def _answers(shards: int, predict: Parent, d: float):
    def words_of(rows: pd.DataFrame, key: int) -> pd.DataFrame:
        h, c = _words(rows)
        p, out = _parent_of(rows, predict), Rows()
        for src, a in _of(rows, ASK_WORDS)[["src", "a"]].itertuples(index=False):
            w = np.frombuffer(a, U)
            at = np.minimum(np.searchsorted(h, w), max(len(h) - 1, 0))
            hit = h[at] == w if len(h) else np.zeros(len(w), bool)
            at = at[hit]
            times, prob = np.zeros(len(w), np.int64), np.full(len(w), predict(np.zeros(1), np.zeros(1))[0])
            times[hit], prob[hit] = c[at], p[at]
            out.add(src, ASK_WORDS, key, times.tobytes(), prob.astype(np.float32).tobytes())
        return out.frame()

    def pairs_of(rows: pd.DataFrame, key: int) -> pd.DataFrame:
        out, known_ = Rows(), _of(rows, MODEL)
        if len(known_):
            m = known_.iloc[0]
            k, n = len(m["a"]) // 16, len(m["c"]) // 10
            contexts, (back, over) = np.frombuffer(m["a"], U, k), np.frombuffer(m["a"], np.float32, 2 * k, 8 * k).reshape(2, k)
            alone, others, weight = get48(m["b"]), get48(m["c"][: 6 * n]), np.frombuffer(m["c"], np.float32, n, 6 * n)
        for src, a, b in _of(rows, ASK_PAIRS)[["src", "a", "b"]].itertuples(index=False):
            k = len(a) // 12
            v, n, w = np.frombuffer(a, U, k), np.frombuffer(a, np.uint32, k, 8 * k), get48(b)
            held, rest, whole = np.zeros(len(w), np.float32), np.ones(k, np.float32), np.ones(k, np.float32)
            if len(known_):
                at = np.minimum(np.searchsorted(contexts, v), len(contexts) - 1)
                known = contexts[at] == v
                rest[known], whole[known] = back[at[known]], over[at[known]]
                asked, mine = _pair_keys(np.repeat(at, n), w), np.repeat(known, n)
                held[mine & _among(alone, asked)[0]] = 1 - d
                hit, place = _among(others, asked)
                hit &= mine
                held[hit] = weight[place[hit]]
            out.add(src, ASK_PAIRS, key, held.tobytes(), rest.tobytes(), whole.tobytes())
        return out.frame()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        key = int(rows["key"].iloc[0])
        return words_of(rows, key) if key < shards else pairs_of(rows, key)

    return run


def _pair_keys(room: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _short(mix(room.astype(U) * U(0x9E3779B97F4A7C15) + w))


SCORED = "doc_id string, n_tokens long, n_known long, base double, score double"


def _score(shards: int, whole: float, hot: np.ndarray, parts: np.ndarray):
    def score(docs: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        doc, h = _many_tokens(list(docs["text"]))
        p = Pairs(doc, h, shards, hot, parts, True)
        by_kind = {k: _of(got, k).sort_values("src") for k in (ASK_WORDS, ASK_PAIRS)}
        times, prior = (np.frombuffer(b"".join(by_kind[ASK_WORDS][c]), t) for c, t in (("a", np.int64), ("b", np.float32)))
        held, rest, over = (np.frombuffer(b"".join(by_kind[ASK_PAIRS][c]), np.float32) for c in ("a", "b", "c"))
        n = np.concatenate([n for *_, n in p.segments(shards)])
        value = np.empty(len(p.by))
        value[p.by] = np.log10(held / np.repeat(over, n) + np.repeat(rest, n) * prior[p.w].astype(np.float64))
        c, size = times[p.ids], len(docs)
        return pd.DataFrame({
            "doc_id": docs["doc_id"].to_numpy(),
            "n_tokens": np.bincount(doc, minlength=size),
            "n_known": np.bincount(doc, c > 0, size).astype(np.int64),
            "base": np.bincount(doc, np.log10((c + 1) / whole), size),
            "score": np.bincount(doc, value[p.inverse], size),
        })

    return score


def lm_score(df: DataFrame, train: DataFrame | None = None, rounds: int = 2) -> DataFrame:
    """One row per document: n_tokens, n_known, train_tokens, base_score and score (log10 probabilities), and perplexity per token.

    Learns from `train`, by default from the rows of df whose fold of seven isn't 2.
    """
    train = df.where(fold("doc_id", 7) != 2) if train is None else train
    m = PitmanYorModel(train, rounds)
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    size = df.agg(F.coalesce(F.sum(_size()), F.lit(0))).first()[0]
    packs = max(1, -(-int(size) // (6 * PACK)))  # a token has about 6 bytes
    blocks = min(BLOCKS, packs)
    pack = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(packs)).alias("pack")
    texts = df.select(F.col("doc_id").cast("string").alias("doc_id"), text.alias("text"), pack)
    tables = m.words.union(m.parent).union(m.tables.withColumn("key", F.col("key") + m.shards))
    done = None
    for k in range(blocks):
        docs = texts.where(F.col("pack") % blocks == k).repartition(min(-(-packs // blocks), 4096), "pack")
        asks = docs.groupBy("pack").applyInPandas(_asks(m.shards, m.hot, m.parts), ROW)
        answers = _grouped(tables.union(asks), _answers(m.shards, m.predict, m.d)).select(F.col("key").alias("pack"), "kind", "src", "a", "b", "c")
        some = docs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInPandas(_score(m.shards, float(m.n + 1 * (m.v + 1)), m.hot, m.parts), SCORED)
        some = materialize(some)
        done = some if done is None else done.union(some)
        del docs, asks, answers
        discard(df.sparkSession)
    return done.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (fold(F.col("doc_id").cast("long"), 7) == 2).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(m.n).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
