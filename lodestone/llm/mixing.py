"""Mixing to target weights: iterative proportional fitting of token weights, then sampling with calibrated probabilities.

Documents fall into cells of source, language and topic; a value outside the targets of its dimension is pooled as
`other`, so that the number of cells is bounded by the targets and not by the data. The tokens to take from each cell
are raked with an upper bound, the tokens that the cell has: each round scales one dimension's cells so that its
marginal meets its targets, where a cell at its bound stays there and the others make up for it. Weights and bounds are
thus solved together, and a cell's tokens to take over those it has are its documents' probability. The budget is the
largest share of all tokens, up to the one asked for, at which every target is met within `TOLERANCE`; if there is
none, as where the cells that a target needs don't exist, the asked budget is used and what each value falls short by is
returned. A document is kept if a uniform number that its id determines lies below its probability; of SALTS such
numbers, the one whose sample is nearest to the marginals is taken, so that a few large documents don't spoil it.

Topics are learned within languages, as words of two languages would tell the languages apart and nothing else: for
each language with enough documents, a mixture of word distributions (words by one of 4,096 hashes), fitted by
expectation and maximisation to the counts of all its documents; one of all documents serves the other languages. The
texts are read once, and their counts are written, then laid out in blocks of one language; each round of the fit is one
aggregation of these, to as many rows as the models have words. It takes time for the words that documents have, not for
all 4,096, and for the components that a document has a share of. Components begin with the distinct texts of smallest hash. Log-probabilities and shares are
multiples of small powers of 2, so that all sums are exact and the models don't depend on how rows are dealt out. A
text's topic is the component of the best mean likelihood of a word; small offsets even out the components' tokens, and
the components are numbered by size.

Edge cases: nulls in source or lang are the value `none`; a null or empty text has no tokens but is sampled with its
cell; targets for values without tokens are given to the others; documents of one id share their fate, those without
an id draw by their text, language and source; an empty table gives an empty result; other columns are kept by sample()
and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from .common import discard, materialize, short_batches, unused, with_texts, written
from .words import U, words

OTHER, NONE = "other", "none"
DIMENSIONS = ("source", "lang", "topic")


BUCKETS = 12  # bits


def _bucket_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and bucket of each word, and words of each text."""
    doc, _, _, h, _ = words(texts)
    return doc, (h >> U(64 - BUCKETS)).astype(np.int64), np.bincount(doc, minlength=len(texts))


#: Documents that a language needs for topics of its own; a mean word's likelihood counts as this many words; offsets of the components, at most.
ENOUGH, PER, OFFSET = 40, 100.0, 100.0


@dataclass
class Topics:
    """Offsets of the components, and logarithms of their words' probabilities by bucket, for each language; those of all languages are under OTHER."""

    models: dict[str, tuple[np.ndarray, np.ndarray]]

    def of(self, texts: list[bytes], langs: list[str | None]) -> tuple[list[str], list[int]]:
        """Topic and number of words of each text; one without words has the topic of the largest offset."""
        doc, bucket, n = _bucket_counts(texts)
        named = np.array([x if x in self.models else OTHER for x in langs], object)
        best = np.zeros(len(texts), np.int64)
        for lang in set(named.tolist()):
            offset, word = self.models[lang]
            here = np.flatnonzero(named == lang)
            mine = np.isin(doc, here)
            like = np.stack([np.bincount(doc[mine], word[bucket[mine], k], len(texts))[here] for k in range(len(offset))], 1)
            best[here] = (PER * like / np.maximum(n[here], 1)[:, None] + offset).argmax(1)
        return [f"topic{k}" for k in best.tolist()], n.tolist()


#: Languages with topics of their own, at most (those with most documents); passes that even out the components, and sizes of their moves.
LANGS, PASSES, STEPS = 64, 12, np.geomspace(OFFSET, 0.02, 16)
#: Documents whose winners are found at once.
STEP = 2048
#: A component that wins a smaller share of its model's tokens without offsets wins none with them: what fits no text best is no topic.
FEWEST = 0.002
#: Log-probabilities are multiples of 2^-16 and shares of a document multiples of 2^-20: sums of such numbers are exact.
LOGS, SHARES = float(1 << 16), float(1 << 20)
_PAIR = np.dtype([("bucket", "<u2"), ("times", "<u4")])
COUNTED = StructType([StructField("h", LongType()), StructField("tokens", LongType()), StructField("x", BinaryType())])


def _counts(texts: list[bytes]) -> list[dict]:
    """Of each text a hash, its words, and its buckets with their numbers of words."""
    doc, bucket, n = _bucket_counts(texts)
    code, times = np.unique(doc << BUCKETS | bucket, return_counts=True)
    pairs = np.empty(len(code), _PAIR)
    pairs["bucket"], pairs["times"] = code & ((1 << BUCKETS) - 1), times
    cut = np.searchsorted(code >> BUCKETS, np.arange(len(texts) + 1)).tolist()
    return [{"h": xxhash.xxh64_intdigest(t) >> 1, "tokens": k, "x": pairs[i:j].tobytes()} for t, k, i, j in zip(texts, n.tolist(), cut[:-1], cut[1:], strict=True)]


def counts(df: DataFrame) -> DataFrame:
    """doc_id, source, lang, draw (what determines its numbers), h, tokens and x (the words' counts) of each row."""
    named = df.select("doc_id", F.coalesce("source", F.lit(NONE)).alias("source"), F.coalesce("lang", F.lit(NONE)).alias("lang"), "text")
    return with_texts(named, "found", COUNTED, _counts).select("doc_id", "source", "lang", draw().alias("draw"), "found.*")


#: Entries (a bucket and its number of words) that documents of one block have, about; words of an entry, at most: larger numbers are several entries.
ENTRIES, MOST = 1 << 16, 255


def _blocks(langs: list[str], x: pa.Array, models) -> Iterator[tuple[np.ndarray, str, np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of documents of one language: their places, the model that is theirs, and their entries' buckets, words, and numbers."""
    parts = x.cast(pa.large_binary())
    data = np.frombuffer(parts.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset : parts.offset + len(parts) + 1]
    pairs, ends = data[ends[0] : ends[-1]].view(_PAIR), (ends - ends[0]) // _PAIR.itemsize
    buckets, numbers = np.ascontiguousarray(pairs["bucket"]), np.ascontiguousarray(pairs["times"])
    named = np.array([v if v in models else OTHER for v in langs], object)
    for lang in sorted(set(named.tolist())):
        here = np.flatnonzero(named == lang)
        size = np.cumsum(ends[here + 1] - ends[here])
        for at in np.split(here, np.flatnonzero(np.diff(size // ENTRIES)) + 1):
            n = ends[at + 1] - ends[at]
            entry = np.repeat(ends[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            bucket, times = buckets[entry], numbers[entry]
            if len(times) and times.max() > MOST:
                more = -(-times.astype(np.int64) // MOST)
                n = np.diff(np.concatenate([[0], np.cumsum(more)])[np.concatenate([[0], np.cumsum(n)])])
                last, rest = np.cumsum(more) - 1, times - (more - 1) * MOST
                bucket, times = np.repeat(bucket, more), np.full(int(more.sum()), MOST)
                times[last] = rest
            yield at, lang, bucket, times.astype(np.uint8), n


#: Entries whose words' numbers are held at once: they stay in a core's cache.
HELD = 4096


def _likelihoods(bucket: np.ndarray, times: np.ndarray, n: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The log-likelihoods of a block's documents under a model or several, side by side."""
    times, ends = times.astype(float), np.cumsum(n)
    out, first, start = np.empty((len(n), word.shape[1])), 0, 0
    held = np.empty((HELD + int(n.max()), word.shape[1]))
    for last in [*(np.flatnonzero(np.diff(ends // HELD)) + 1).tolist(), len(n)]:
        end, at = int(ends[last - 1]), 0
        some, many = word.take(bucket[start:end], 0, held[: end - start], "clip"), times[start:end]
        for row, k in zip(out[first:last], n[first:last].tolist(), strict=True):
            np.dot(many[at : at + k], some[at : at + k], out=row)
            at += k
        first, start = last, end
    return out


def _masses(bucket: np.ndarray, times: np.ndarray, n: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """By bucket and component the words of a block's documents, times their weights; a component takes time for the documents that have a share of it."""
    times, starts = times.astype(float), np.cumsum(n) - n
    out = np.zeros((weights.shape[1], 1 << BUCKETS))
    for mass, w in zip(out, np.ascontiguousarray(weights.T), strict=True):
        doc = np.flatnonzero(w)
        if len(doc) > len(n) // 2:
            mass += np.bincount(bucket, np.repeat(w, n) * times, len(mass))
        elif len(doc):
            many = n[doc]
            entry = np.repeat(starts[doc] - (np.cumsum(many) - many), many)
            entry += np.arange(len(entry))
            mass += np.bincount(bucket.take(entry), np.repeat(w[doc], many) * times.take(entry), len(mass))
    return out.T


LAID = ("model", "tokens", "bucket", "times", "n")


def _lay(counted: DataFrame, names: list[str]) -> DataFrame:
    """counts()'s rows of texts with a word as _blocks, a row each, so that a round hands workers few rows and no entry is laid out twice."""

    def run(batches):
        for batch in batches:
            tokens = batch.column(2).to_numpy()
            for at, model, bucket, times, n in _blocks(batch.column(0).to_pylist(), batch.column(1), names):
                row = (model, tokens[at].tobytes(), bucket.tobytes(), times.tobytes(), n.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], LAID)

    return short_batches(counted.select("lang", "x", "tokens")).mapInArrow(run, "model string, tokens binary, bucket binary, times binary, n binary")


def _laid(batches) -> Iterator[tuple[str, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Model, tokens and entries of each block."""
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield r[0], np.frombuffer(r[1], np.int64), (np.frombuffer(r[2], "<u2").astype(np.int64), np.frombuffer(r[3], np.uint8), np.frombuffer(r[4], "<u4").astype(np.int64))


def _own(model: str) -> list[str]:
    """The models that a model's documents count for: it and that of all documents."""
    return [model, OTHER] if model != OTHER else [OTHER]


def _sums(laid: DataFrame, models: dict[str, np.ndarray], shares: dict[str, np.ndarray] | None) -> dict[str, np.ndarray]:
    """One round over all documents: of each model, by bucket and component, the words that fall to it, and behind the buckets the documents; in units of 1 / SHARES. Without shares all falls to the first component."""
    names, width = sorted(models), next(iter(models.values())).shape[1]
    logs = {m: np.rint(w * LOGS).astype(np.int32) for m, w in models.items()}  # as they are, in half the bytes

    def run(batches):
        total = {m: np.zeros(((1 << BUCKETS) + 1, width)) for m in names}
        both = {m: np.concatenate([logs[x] for x in _own(m)], 1) / LOGS for m in names}
        for model, tokens, entries in _laid(batches):
            own, weights = _own(model), np.zeros((len(tokens), both[model].shape[1]))
            if shares is None:
                weights[:, ::width] = SHARES
            else:
                like = _likelihoods(*entries, both[model])
                for j, m in enumerate(own):
                    some = like[:, j * width : (j + 1) * width] + shares[m]
                    p = np.exp(some - some.max(1, keepdims=True))
                    weights[:, j * width : (j + 1) * width] = np.rint(p / p.sum(1, keepdims=True) * SHARES)
            mass = _masses(*entries, weights)
            for j, m in enumerate(own):
                total[m][:-1] += mass[:, j * width : (j + 1) * width]
                total[m][-1] += weights[:, j * width : (j + 1) * width].sum(0)
        for j, m in enumerate(names):
            some = np.flatnonzero(total[m].any(1))
            columns = [np.full(len(some), j, np.int32), some.astype(np.int32), *total[m][some].astype(np.int64).T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["model", "place", *(f"s{k}" for k in range(width))])

    some = laid.mapInArrow(run, "model int, place int" + "".join(f", s{k} long" for k in range(width)))
    return _placed(some, names, (1 << BUCKETS) + 1, width)


def _placed(rows: DataFrame, names: list[str], places: int, width: int) -> dict[str, np.ndarray]:
    """The rows' sums by model and place; as many as the models have numbers, whatever the documents."""
    got = rows.groupBy("model", "place").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(width))).toArrow()
    out = np.zeros((len(names), places, width))
    out[got.column("model").to_numpy(), got.column("place").to_numpy()] = np.stack([got.column(f"s{k}").to_numpy() for k in range(width)], 1)
    return dict(zip(names, out, strict=True))


def _begin(counted: DataFrame, langs: list[str], topics: int) -> dict[str, np.ndarray]:
    """Of each model the counts of the distinct texts of smallest hash, repeated if they are fewer than the topics."""
    keys = counted.select("lang", "h")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen: dict[str, list[int]] = {m: [] for m in langs}
    for r in keys.where(F.col("lang").isin(langs)).distinct().withColumn("k", first).where(F.col("k") <= topics).orderBy("lang", "h").collect():
        chosen[r["lang"]].append(r["h"])
    chosen[OTHER] = [r["h"] for r in keys.select("h").distinct().orderBy("h").limit(topics).collect()]
    texts = counted.where(F.col("h").isin(sorted({h for hs in chosen.values() for h in hs}))).groupBy("h").agg(F.min("x").alias("x")).collect()
    dense = {}
    for r in texts:
        some = np.frombuffer(r["x"], _PAIR)
        dense[r["h"]] = np.zeros(1 << BUCKETS)
        dense[r["h"]][some["bucket"]] = some["times"]
    return {m: np.stack([dense[hs[k % len(hs)]] for k in range(topics)]) for m, hs in chosen.items()}


def _even(laid: DataFrame, words_: dict[str, np.ndarray]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Of each model the offsets, within OFFSET, for which the tokens that its components win are most even, and these tokens.

    They minimise a convex sum, the tokens' best values less the mean offset, whose slopes are what the components win
    too much. A pass takes it and the tokens won for moves of STEPS sizes: of all components against the slopes, of one of
    the three that are farthest from their part, and the last move again; the best is where the next pass begins.
    """
    names, k = sorted(words_), next(iter(words_.values())).shape[1]

    def score(batches):
        for model, n, entries in _laid(batches):
            for m in _own(model):
                means = PER * _likelihoods(*entries, words_[m]) / n[:, None]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((names.index(m), pa.int32()), (n.tobytes(), pa.binary()), (means.tobytes(), pa.binary()))], ["model", "tokens", "means"])

    scored, path = written(laid.mapInArrow(score, "model int, tokens binary, means binary"))
    scored = scored.coalesce(max(scored.sparkSession.sparkContext.defaultParallelism, scored.rdd.getNumPartitions() // 4))
    tried, alive = {m: np.zeros((1, k)) for m in names}, {}
    least: dict[str, tuple[float, np.ndarray, np.ndarray]] = {}
    best: dict[str, tuple[float, np.ndarray, np.ndarray]] = {}
    for turn in range(1 + PASSES):

        def run(batches, tried=tried):
            won = np.zeros((len(names), max(map(len, tried.values())), k + 1))
            for batch in batches:
                model, tokens, means = (c.to_pylist() for c in batch.columns)
                for j in sorted(set(model)):
                    rows = [i for i, m in enumerate(model) if m == j]
                    mine = np.ascontiguousarray(np.frombuffer(b"".join(means[i] for i in rows)).reshape(-1, k).T)
                    weight = np.frombuffer(b"".join(tokens[i] for i in rows), np.int64).astype(float)
                    for at in range(0, len(weight), STEP):
                        some, n = mine[:, at : at + STEP], weight[at : at + STEP]
                        for place, offset in enumerate(tried[names[j]]):
                            moved = some + offset[:, None]
                            best_ = moved.max(0)
                            wins = moved == best_
                            if wins.sum() > len(n):  # the first of equal ones
                                wins = moved.argmax(0) == np.arange(k)[:, None]
                            won[j, place, :k] += wins @ n
                            won[j, place, k] += np.rint(16 * n * best_).sum()
            model, place = np.nonzero(won.any(2))
            columns = [model.astype(np.int32), place.astype(np.int32), *won[model, place].astype(np.int64).T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["model", "place", *(f"s{j}" for j in range(k + 1))])

        got = _placed(scored.mapInArrow(run, "model int, place int" + "".join(f", s{j} long" for j in range(k + 1))), names, max(map(len, tried.values())), k + 1)
        for m in names:
            if m not in alive:
                won = got[m][0, :k]
                alive[m] = won >= FEWEST * won.sum()
                tried[m] = np.where(alive[m], 0, -np.inf)[None]
                continue
            here = alive[m]
            before = least[m][1] if m in least else tried[m][0]
            for offset, (*won, high) in zip(tried[m], got[m], strict=False):
                won = np.array(won)
                total = max(won.sum(), 1)
                off, value = float(np.abs(won / total - 1 / here.sum())[here].max()), high / 16 / total - offset[here].mean()
                if m not in best or off < best[m][0]:
                    best[m] = (off, offset, won)
                if m not in least or value < least[m][0]:
                    least[m] = (value, offset, won)
            _, offset, won = least[m]
            short, last = np.zeros(k), np.zeros(k)
            short[here] = np.clip(1 - here.sum() * won / max(won.sum(), 1), -1, 1)[here]
            last[here] = offset[here] - before[here]
            single = [np.where(np.arange(k) == j, np.sign(short), 0) for j in np.argsort(-np.abs(short), kind="stable")[:3]]
            ways = (short / max(np.abs(short).max(), 1e-9), *single, last / max(np.abs(last).max(), 1e-9))
            moves = np.clip(offset + np.concatenate([np.outer(STEPS, way) for way in ways]), -OFFSET, OFFSET)
            tried[m] = np.where(here, moves, -np.inf)
        if turn % 5 == 4:
            discard(scored.sparkSession)
    discard(scored.sparkSession, path)
    return {m: (o, won) for m, (_, o, won) in best.items()}


def fit_topics(counted: DataFrame, topics: int = 8, rounds: int = 20) -> Topics:
    """Fits the mixtures to counts(), written, of all documents with a word."""
    spark = counted.sparkSession
    counted = counted.where(F.col("tokens") > 0)
    sizes = counted.groupBy("lang").count().where(F.col("count") >= ENOUGH).orderBy(F.col("count").desc(), "lang").limit(LANGS).collect()
    langs = sorted(r["lang"] for r in sizes if r["lang"] != OTHER)
    if counted.isEmpty():
        return Topics({OTHER: (np.zeros(topics), np.full((1 << BUCKETS, topics), -np.log(1 << BUCKETS)))})
    laid, path = written(_lay(counted, langs))
    laid = laid.coalesce(max(spark.sparkContext.defaultParallelism, laid.rdd.getNumPartitions() // 4))
    rounded = lambda p: np.rint(np.log(p) * LOGS) / LOGS
    begin = _begin(counted, langs, topics)
    first = {m: x[:, 0] / SHARES for m, x in _sums(laid, {m: np.zeros((1 << BUCKETS, topics)) for m in begin}, None).items()}
    size = {m: x[-1] for m, x in first.items()}
    every = {m: (x[:-1] + 0.5) / (x[:-1].sum() + 0.5 * (1 << BUCKETS)) for m, x in first.items()}
    word = {m: rounded(0.5 * every[m][:, None] + 0.5 * (b.T + 0.01) / (b.sum(1) + 0.01 * (1 << BUCKETS))) for m, b in begin.items()}
    share = {m: np.full(topics, -np.log(topics)) for m in word}
    for k in range(rounds):
        for m, x in _sums(laid, word, share).items():
            mass, held = x[:-1] / SHARES, x[-1] / SHARES
            share[m] = np.log((held + 1) / (size[m] + topics))
            word[m] = rounded((mass + 200 * every[m][:, None]) / (mass.sum(0) + 200))
        if k % 5 == 4:
            discard(spark)
    models = {}
    for m, (offset, won) in _even(laid, word).items():
        # By size, so that the languages' topics of one number are about equally large.
        order = np.argsort(-won, kind="stable")
        models[m] = (offset[order], word[m][:, order])
    discard(spark, path)
    return Topics(models)


def train_topics(df: DataFrame, topics: int = 8, rounds: int = 20) -> Topics:
    """fit_topics() of df's texts."""
    counted, path = written(counts(df))
    out = fit_topics(counted, topics, rounds)
    discard(df.sparkSession, path)
    return out


TOPICAL = StructType([StructField("topic", StringType()), StructField("tokens", LongType())])


def with_topic(df: DataFrame, topics: Topics, name: str) -> DataFrame:
    """df's columns and a struct of its text's topic and tokens (words between spaces)."""
    return with_texts(df, name, TOPICAL, lambda texts, langs: [{"topic": t, "tokens": n} for t, n in zip(*topics.of(texts, [x or NONE for x in langs]), strict=True)], extra=("lang",))


def cells(counted: DataFrame, topics: Topics) -> DataFrame:
    """doc_id, source, lang, topic, tokens and draw of counts()'s rows."""
    words_ = {m: w for m, (_, w) in topics.models.items()}
    kept = counted.select("doc_id", "source", "lang", "tokens", "draw", "x")

    def run(batches):
        for batch in batches:
            n, best = np.maximum(batch.column(3).to_numpy(), 1), np.zeros(batch.num_rows, np.int64)
            for at, m, *entries in _blocks(batch.column(2).to_pylist(), batch.column(5), words_):
                best[at] = (PER * _likelihoods(*entries, words_[m]) / n[at][:, None] + topics.models[m][0]).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([f"topic{t}" for t in best.tolist()])], [*batch.schema.names[:5], "topic"])

    return kept.mapInArrow(run, "doc_id long, source string, lang string, tokens long, draw string, topic string")


def draw() -> Column:
    """What a row draws by: its id, or its text, language and source."""
    own = F.md5(F.to_json(F.struct("text", F.coalesce("lang", F.lit(NONE)).alias("l"), F.coalesce("source", F.lit(NONE)).alias("s"))).cast("binary"))
    return F.coalesce(F.col("doc_id").cast("string"), own)


def uniform(by: str | Column = "doc_id", salt: int | Column = 0) -> Column:
    """A number in [0, 1) that `by` and the salt determine."""
    by, salt = F.col(by) if isinstance(by, str) else by, F.lit(salt) if isinstance(salt, int) else salt
    name = F.concat(F.coalesce(by.cast("string"), F.lit(NONE)), F.when(salt > 0, F.concat(F.lit(":"), salt.cast("string"))).otherwise(""))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


@dataclass
class Mix:
    """Cells with their tokens, raked weights (summing to 1) and sampling probabilities; the cells' salts; and by dimension and value the target, the share that the probabilities give, and that of the sample."""

    known: dict[str, set[str]]
    rows: list[tuple[str, str, str, float, float, float]]
    rounds: int
    topics: Topics
    celled: DataFrame  # cells() of what it was fitted to, written
    salts: dict[tuple[str, ...], int]
    shares: dict[str, dict[str, tuple[float, float, float]]]

    def marginal(self, dimension: str) -> dict[str, float]:
        out: dict[str, float] = {}
        for r in self.rows:
            k = r[DIMENSIONS.index(dimension)]
            out[k] = out.get(k, 0.0) + r[4]
        return out


def _wanted(tokens: dict[tuple[str, ...], float], targets: list[dict[str, float]]) -> list[dict[str, float]]:
    """The targets, normalised over the values that have tokens."""
    out = []
    for d, target in enumerate(targets):
        there = sorted({k[d] for k, v in tokens.items() if v > 0})
        have = {v: max(0.0, target.get(v, 0.0)) for v in there}
        s = sum(have.values())
        out.append({v: x / s for v, x in have.items()} if s else {v: 1 / len(there) for v in there})
    return out


def bounded(tokens: dict[tuple[str, ...], float], targets: list[dict[str, float]], goal: float, rounds: int = 200, tolerance: float = 1e-7) -> tuple[dict, float, int]:
    """(tokens to take from each cell, the largest gap between a marginal's share and its target, rounds): raking with the cells' tokens as upper bounds."""
    keys = [k for k, v in tokens.items() if v > 0]
    most = np.array([tokens[k] for k in keys])
    wanted = _wanted(tokens, targets)
    names = [sorted(w) for w in wanted]
    place = [np.array([n.index(k[d]) for k in keys], np.int64) for d, n in enumerate(names)]
    aim = [goal * np.array([w[v] for v in n]) for w, n in zip(wanted, names, strict=True)]
    take, done, gap = most * (goal / max(most.sum(), 1e-300)), 0, 0.0
    for done in range(1, rounds + 1):
        for at, want in zip(place, aim, strict=True):
            low, high = np.zeros(len(want)), np.ones(len(want))
            sums = lambda f, at=at: np.bincount(at, np.minimum(most, take * f[at]), len(f))
            for _ in range(60):  # beyond its bounds a value takes all it has
                short = sums(high) < want * (1 - 1e-12)
                if not short.any() or high.max() > 1e15:
                    break
                high = np.where(short, high * 2, high)
            for _ in range(50):
                mid = (low + high) / 2
                under = sums(mid) < want
                low, high = np.where(under, mid, low), np.where(under, high, mid)
            take = np.minimum(most, take * high[at])
        total = max(take.sum(), 1e-300)
        gap = max(float(np.abs(np.bincount(at, take, len(want)) / total - want / goal).max()) for at, want in zip(place, aim, strict=True)) if goal else 0.0
        if gap < tolerance:
            break
    return dict(zip(keys, take.tolist(), strict=True)), gap, done


def rake(tokens: dict[tuple[str, ...], float], targets: list[dict[str, float]], rounds: int = 200) -> tuple[dict[tuple[str, ...], float], int]:
    """Raked weights without bounds: so small a goal that no cell comes near its own."""
    take, _, done = bounded(tokens, targets, 1e-9 * min([v for v in tokens.values() if v > 0], default=0.0), rounds)
    s = sum(take.values())
    return {k: v / s for k, v in take.items()}, done


#: Gap of a marginal's share that counts as met, least share of the budget that is tried, salts that a draw is chosen from.
TOLERANCE, LEAST, SALTS = 0.003, 0.05, 32


def calibrate(tokens: dict, targets: list[dict[str, float]], budget: float) -> tuple[dict, dict, int]:
    """(weights, probabilities, rounds) at the largest budget, up to the one asked for, that meets the targets."""
    total = sum(tokens.values())
    solve = lambda share: bounded(tokens, targets, share * budget * total)
    take, gap, done = solve(1.0)
    if gap > TOLERANCE:
        low, high = LEAST, 1.0
        tried = solve(low)
        for _ in range(12):
            if tried[1] > TOLERANCE:
                break
            mid = (low + high) / 2
            now = solve(mid)
            low, high, tried = (mid, high, now) if now[1] <= TOLERANCE else (low, mid, tried)
        if tried[1] <= TOLERANCE:
            take, gap, done = tried
    s = sum(take.values())
    return {k: v / s if s else 0.0 for k, v in take.items()}, {k: min(1.0, take[k] / v) if v > 0 else 1.0 for k, v in tokens.items()}, done


def tempered(tokens: dict[str, float], power: float) -> dict[str, float]:
    """Targets in proportion to tokens raised to a power below 1: smaller values gain."""
    raised = {k: v**power for k, v in tokens.items() if v > 0}
    s = sum(raised.values())
    return {k: v / s for k, v in raised.items()}


def fit(df: DataFrame, targets: dict[str, dict[str, float]] | None = None, budget: float = 0.5, power: float = 0.5, values: int = 64) -> Mix:
    """Rakes df's tokens to the targets of each dimension; without any, to its own shares raised to `power`.

    A dimension without targets takes its `values` largest values; at most (values + 1)^3 cells can exist.
    """
    # One pass over the texts, whose counts give the topics and the cells; all sums come from the cells' rows.
    counted, path = written(counts(df))
    topics = fit_topics(counted)
    celled = materialize(cells(counted, topics))
    discard(df.sparkSession, path)
    base = materialize(celled.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")))
    chosen: dict[str, dict[str, float]] = {}
    for d in DIMENSIONS:
        if targets and d in targets:
            chosen[d] = dict(targets[d])
        else:
            top = base.groupBy(d).agg(F.sum("tokens").alias("t")).orderBy(F.col("t").desc(), d).limit(values).collect()
            every = float(base.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
            share = {r[0]: float(r[1]) for r in top}
            share[OTHER] = share.get(OTHER, 0.0) + max(0.0, every - sum(share.values()))
            chosen[d] = tempered(share, power)
    known = {d: set(chosen[d]) for d in DIMENSIONS}
    pooled = [F.when(F.col(d).isin(sorted(known[d])), F.col(d)).otherwise(OTHER).alias(f"{d}_cell") for d in DIMENSIONS]
    sums = base.groupBy(*pooled).agg(F.sum("tokens").alias("tokens")).collect()  # bounded by the targets
    tokens = {(r[0], r[1], r[2]): float(r[3]) for r in sorted(sums)}
    targets_ = [chosen[d] for d in DIMENSIONS]
    weight, p, rounds = calibrate(tokens, targets_, budget)
    mix = Mix(known, [(*k, v, weight.get(k, 0.0), p[k]) for k, v in tokens.items()], rounds, topics, celled, {}, {})
    _choose_draw(mix, _wanted(tokens, targets_))
    return mix


def _shares(taken: dict[tuple[str, ...], float], d: int) -> dict[str, float]:
    out: dict[str, float] = {}
    for k, v in taken.items():
        out[k[d]] = out.get(k[d], 0.0) + v
    s = sum(out.values())
    return {k: v / s if s else 0.0 for k, v in out.items()}


def _choose_draw(mix: Mix, wanted: list[dict[str, float]]) -> None:
    """Sets the cells' salts, the largest cell's first and each again twice, and the shares that the probabilities and the sample give."""
    names = [f"{d}_cell" for d in DIMENSIONS]
    celled = mix.celled.withColumns({n: _pooled(mix, d, F.col(d)) for n, d in zip(names, DIMENSIONS, strict=True)})
    joined = celled.join(_chances(celled.sparkSession, mix, [*names, "_weight", "_chance", "_salt"]), names, "left")
    drawn = [F.sum(F.when(uniform("draw", s) < F.coalesce("_chance", F.lit(1.0)), F.col("tokens")).otherwise(0)).alias(f"s{s}") for s in range(SALTS)]
    sums = {tuple(r[n] for n in names): np.array([float(r[f"s{s}"]) for s in range(SALTS)]) for r in joined.groupBy(*names).agg(*drawn).collect()}  # a row for each cell
    expected = {tuple(r[:3]): r[3] * r[5] for r in mix.rows}
    off = [dict.fromkeys(w, 0.0) for w in wanted]
    salts: dict[tuple[str, ...], int] = {}
    for k in 3 * sorted((k for k in sums if k in expected and all(v in o for v, o in zip(k, off, strict=True))), key=lambda k: (-expected[k], k)):
        gone = sums[k][salts[k]] - expected[k] if k in salts else 0.0
        here = np.array([off[d][k[d]] - gone for d in range(3)])
        gain = sums[k] - expected[k]
        salts[k] = int(np.argmin(((here[:, None] + gain) ** 2).sum(0)))
        for d in range(3):
            off[d][k[d]] = here[d] + gain[salts[k]]
    mix.salts = salts
    taken = {k: v[salts.get(k, 0)] for k, v in sums.items()}
    mix.shares = {d: {v: (w, _shares(expected, i).get(v, 0.0), _shares(taken, i).get(v, 0.0)) for v, w in wanted[i].items()} for i, d in enumerate(DIMENSIONS)}


def _chances(spark: SparkSession, mix: Mix, names: list[str]) -> DataFrame:
    rows = [(*r[:3], r[4] / r[3] if r[3] else 0.0, r[5], mix.salts.get(tuple(r[:3]), 0)) for r in mix.rows]
    types = ("string", "string", "string", "double", "double", "int")
    return F.broadcast(spark.createDataFrame(rows, ", ".join(f"`{n}` {t}" for n, t in zip(names, types, strict=True))))  # as many rows as cells, which the targets bound


def _pooled(mix: Mix, d: str, value: Column) -> Column:
    return F.when(value.isin(sorted(mix.known[d])), value).otherwise(OTHER)


def mixing(mix: Mix) -> DataFrame:
    """One row per document that the mix was fitted to: its cell, tokens, the weight that the mixture gives one of its tokens, its probability, whether it is sampled, and by how much its cell's source, language or topic falls short of its target in the sample, at most."""
    names = [*(f"{d}_cell" for d in DIMENSIONS), "token_weight", "probability", "salt"]
    celled = mix.celled.withColumns({f"{d}_cell": _pooled(mix, d, F.col(d)) for d in DIMENSIONS})
    out = celled.join(_chances(celled.sparkSession, mix, names), names[:3], "left")
    chance = F.coalesce("probability", F.lit(1.0))
    gaps = [F.coalesce(F.element_at(F.create_map(*(F.lit(x) for v, (want, _, got) in sorted(mix.shares[d].items()) for x in (v, max(0.0, want - got)))), F.col(f"{d}_cell")), F.lit(0.0)) for d in DIMENSIONS if mix.shares.get(d)]
    short = F.round(F.greatest(F.lit(0.0), F.lit(0.0), *gaps), 9).alias("shortfall")
    return out.select("doc_id", *names[:3], F.col("tokens").alias("n_tokens"), F.coalesce("token_weight", F.lit(0.0)).alias("token_weight"), F.round(chance, 9).alias("probability"), (uniform("draw", F.coalesce("salt", F.lit(0))) < chance).alias("sampled"), short)


def sample(df: DataFrame, mix: Mix) -> DataFrame:
    """The documents that are sampled, with df's columns, whatever their names."""
    names = [unused(df, n) for n in ("source_cell", "lang_cell", "topic_cell", "token_weight", "probability", "salt", "found")]
    found = names.pop()
    values = (F.coalesce("source", F.lit(NONE)), F.coalesce("lang", F.lit(NONE)), F.col(found)["topic"])
    out = with_topic(df, mix.topics, found).withColumns({n: _pooled(mix, d, x) for n, d, x in zip(names, DIMENSIONS, values, strict=False)})
    out = out.join(_chances(df.sparkSession, mix, names), names[:3], "left")
    return out.where(uniform(draw(), F.coalesce(names[5], F.lit(0))) < F.coalesce(names[4], F.lit(1.0))).select(*(F.col(f"`{c}`") for c in df.columns))
