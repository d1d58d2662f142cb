"""Secret scan: three base patterns, and a character convolutional network over every candidate and its context.

A candidate is every run of 12 or more characters `[A-Za-z0-9+/_=-]`, whether or not a base pattern found it. The network
sees it and what stands before and behind it as character classes. It is trained in numpy on the distinct windows of all
texts, which the base patterns label: candidates that touch a base finding are positive, and made strings in credential
and other contexts stand for kinds that the base patterns miss. Other candidates are negative but for those that a first
network, trained without them, takes for findings: no pattern found these, which doesn't make them harmless. Tenths of the findings serve
training (5), calibration by Platt's method (2), the threshold (2: the largest one that keeps the wanted recall there),
and the measured recall and false alarms (1), which the model carries.

Windows are dealt by their hash into shards of bounded size, which are written once. In each epoch a task descends from
the same weights over each shard, in batches that hold both labels, and the shards' weights are averaged as integers; logits
are counted by label in bins of 1/32 for calibration, threshold and measures. Both labels count alike.

Flagged candidates that lie inside a base finding confirm it; all others are spans of kind cnn.

Edge cases: a null text is an empty one (no spans, the hash of the empty list); repeated rows are answered each on
its own; an empty table gives an empty result (and a network of made strings only); other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
import string

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_texts, short_batches, steps, written

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "cnn")

_RUN = np.zeros(256, np.int8)
_RUN[[*map(ord, string.ascii_letters + string.digits + "+/_=-")]] = 1
_HEX = np.zeros(256, np.int8)
_HEX[[*map(ord, "0123456789abcdef")]] = 1
BEFORE, INSIDE, AFTER, MIN_RUN = 20, 44, 8, 12


def _classes() -> np.ndarray:
    """Characters as one of 40 classes: letters by themselves in lower case, upper case by thirds, digits, and marks."""
    c = np.full(256, 39, np.int64)
    c[97:123] = np.arange(26)
    c[65:91] = 26 + np.arange(26) // 9
    c[48:58] = 29 + np.arange(10) // 5
    for k, marks in enumerate(("\"'`", "=:", "+/", "_-", " \t", "\n\r", ".,;!?", "()[]{}<>")):
        c[[*map(ord, marks)]] = 31 + k
    return c


CLASSES = _classes()

#: Distinct windows of a shard, about; made ones that each shard gets; bins of logits on either side of 0; units of averaged weights.
SHARD, MADE, BINS, UNITS = 1 << 15, 1000, 1 << 11, float(1 << 32)


def runs(data: np.ndarray, member: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edges = np.flatnonzero(np.diff(member[data], prepend=0, append=0))
    start, end = edges[::2], edges[1::2]
    keep = end - start >= least
    return start[keep], end[keep]


def base_spans(text: str, low: bytes, hexes: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings; hexes are given in code points."""
    found = [(s, 2, e) for s, e in hexes]
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"akia" in low:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    return sorted(found)


def window(data: bytes, s: int, e: int) -> np.ndarray:
    """The classes of what stands before, in and after a candidate, each cut or filled to a fixed width (a long candidate keeps both its ends)."""
    inside = data[s:e] if e - s <= INSIDE else data[s : s + INSIDE // 2] + data[e - INSIDE // 2 : e]
    return CLASSES[np.frombuffer(data[max(0, s - BEFORE) : s].rjust(BEFORE) + inside.ljust(INSIDE) + data[e : e + AFTER].ljust(AFTER), np.uint8)]


class CharCnn:
    """Embedding, one convolution, maximum and mean over places, and one output; plain numpy, Adam."""

    def __init__(self, filters: int = 24, width: int = 5, dim: int = 10, seed: int = 7):
        r = np.random.default_rng(seed)
        self.width, self.filters = width, filters
        self.p = {"emb": r.normal(0, 0.3, (40, dim)), "w": r.normal(0, 0.25, (width * dim, filters)), "b": np.zeros(filters), "out": r.normal(0, 0.2, 2 * filters), "bias": np.zeros(1)}
        self.platt, self.threshold = (1.0, 0.0), 1.1
        self.recall = self.false_alarms = 0.0

    def _forward(self, x: np.ndarray):
        e = self.p["emb"][x]
        n, length, dim = e.shape
        cols = np.lib.stride_tricks.sliding_window_view(e, self.width, axis=1).transpose(0, 1, 3, 2).reshape(n, length - self.width + 1, -1)
        z = np.maximum(cols @ self.p["w"] + self.p["b"], 0)
        top = z.argmax(1)
        feats = np.concatenate([z.max(1), z.mean(1)], 1)
        return feats @ self.p["out"] + self.p["bias"][0], (cols, z, top, feats, e.shape)

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Inference: each place's convolution is a sum of rows that embedding and filters give for a class at an offset."""
        emb, w = self.p["emb"], self.p["w"].reshape(self.width, -1, self.filters)
        tables = [(emb @ w[j]).astype(np.float32) for j in range(self.width)]
        bias, out = self.p["b"].astype(np.float32), np.zeros(len(x))
        for k in range(0, len(x), 256):
            some = x[k : k + 256]
            n = some.shape[1] - self.width + 1
            z = tables[0][some[:, :n]] + bias
            for j in range(1, self.width):
                z += tables[j][some[:, j : j + n]]
            np.maximum(z, 0, out=z)
            out[k : k + 256] = np.concatenate([z.max(1), z.mean(1)], 1) @ self.p["out"] + self.p["bias"][0]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * self.logits(x) + b, -30, 30)))

    def _descend(self, x: np.ndarray, y: np.ndarray, batches, rate: float, moments: dict) -> None:
        """Adam over batches of (places, weights)."""
        for at, weight in batches:
            xb, yb = x[at], y[at]
            out, (cols, z, top, feats, shape) = self._forward(xb)
            d = (1 / (1 + np.exp(-out)) - yb) * weight / len(yb)
            df = d[:, None] * self.p["out"]
            dz = np.repeat(df[:, None, self.filters :] / z.shape[1], z.shape[1], 1)
            np.add.at(dz, (np.arange(len(yb))[:, None], top, np.arange(self.filters)), df[:, : self.filters])
            dz *= z > 0
            flat = dz.reshape(-1, self.filters)
            dcols = (flat @ self.p["w"].T).reshape(len(yb), z.shape[1], self.width, -1)
            de = np.zeros(shape)
            for j in range(self.width):
                de[:, j : j + z.shape[1]] += dcols[:, :, j]
            code = xb.ravel()
            emb = np.stack([np.bincount(code, de[:, :, k].ravel(), 40) for k in range(shape[2])], 1)
            g = {"out": feats.T @ d, "bias": np.array([d.sum()]), "w": cols.reshape(-1, cols.shape[2]).T @ flat, "b": flat.sum(0), "emb": emb}
            t = moments["t"] = moments.get("t", 0) + 1
            for name, grad in g.items():
                m = moments["m", name] = 0.9 * moments.get(("m", name), 0) + 0.1 * grad
                v = moments["v", name] = 0.999 * moments.get(("v", name), 0) + 0.001 * grad**2
                self.p[name] = self.p[name] - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    def descend(self, x: np.ndarray, y: np.ndarray, seed: list[int], rate: float = 0.01) -> None:
        """One epoch over all rows of the label that has more; those of the other one are taken again and again."""
        r = np.random.default_rng(seed)
        few, many = sorted((r.permutation(np.flatnonzero(y == k)) for k in (0, 1)), key=len)
        if len(few):
            part = min(32, max(16, round(64 * len(few) / len(x))))
            begins = range(0, len(many), 64 - part)
            again = np.resize(few, part * len(begins)).reshape(-1, part)

            def batches():
                for k, begin in enumerate(begins):
                    some = many[begin : begin + 64 - part]
                    both = np.concatenate([some, again[k]])
                    yield both, np.repeat([len(both) / 2 / len(some), len(both) / 2 / part], [len(some), part])

            self._descend(x, y, batches(), rate, {})

    def calibrate(self, bins: dict[tuple[int, int], np.ndarray], recall: float) -> None:
        """Sets calibration, threshold and measures from numbers of logits by (tenths' use, label) and bin."""
        s = np.arange(-BINS, BINS) / 32
        share = {k: v / max(v.sum(), 1) / 2 for k, v in bins.items()}
        a, b = 1.0, 0.0
        for _ in range(300):
            p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
            off = share[0, 0] * p + share[0, 1] * (p - 1)
            a, b = a - 0.05 * (float(off @ s) + 0.01 * (a - 1)), b - 0.05 * float(off.sum())
        self.platt = (a, b)
        judged = np.cumsum(bins[1, 1])
        if judged[-1]:
            at = int(np.searchsorted(judged, int((1 - recall) * judged[-1]) + 1))
            self.threshold = float(1 / (1 + np.exp(-np.clip(a * (s[at] - 1 / 64) + b, -30, 30)))) if at else 0.0
            self.recall, self.false_alarms = (float(bins[2, k][at:].sum() / max(bins[2, k].sum(), 1)) for k in (1, 0))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, rate: float = 0.01, recall: float = 0.99, seed: int = 11) -> "CharCnn":
        """Of ten findings five train, two calibrate, two set the threshold and one measures recall and false alarms."""
        if not len(x) or y.min() == y.max():
            return self
        tenth = np.arange(len(x)) % 10
        held, judged, measured = tenth < 2, (tenth == 2) | (tenth == 3), tenth == 4
        r = np.random.default_rng(seed)
        train = np.flatnonzero(tenth > 4)
        moments: dict = {}
        for _ in range(epochs):
            r.shuffle(train)
            self._descend(x, y, ((train[k : k + 64], 1.0) for k in range(0, len(train), 64)), rate, moments)
        s, yh, a, b = self.logits(x[held]), y[held], 1.0, 0.0
        for _ in range(300):
            p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
            a, b = a - 0.05 * float(((p - yh) * s).mean() + 0.01 * (a - 1)), b - 0.05 * float((p - yh).mean())
        self.platt = (a, b)
        p = np.sort(self.probability(x[judged][y[judged] == 1]))
        self.threshold = float(p[int((1 - recall) * len(p))]) if len(p) else 1.1
        said = self.probability(x[measured]) >= self.threshold
        self.recall, self.false_alarms = (float(said[y[measured] == k].mean()) if (y[measured] == k).any() else 0.0 for k in (1, 0))
        return self


def _synthetic(n: int, seed: int = 5) -> tuple[list[np.ndarray], list[int]]:
    """Made findings: random keys of several alphabets in credential contexts (1), numbers, names and paths elsewhere (0)."""
    r = random.Random(seed)
    alnum, base64s, words = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", ("alpha", "build", "config", "report", "value", "index", "image", "stage", "north", "table")
    letters = string.ascii_letters
    xs, ys = [], []
    for k in range(n):
        if k % 2:
            key = "".join(r.choices(r.choice((alnum, base64s, "0123456789abcdef", letters)), k=r.randint(14, 48)))
            before = r.choice(("key = \"", "auth: ", "client_secret=", "bearer ", "credential='", "private_key: "))
        else:
            plain = "".join(r.choice(("th", "er", "on", "an", "re", "in", "ed", "st", "en", "ti", "la", "no", "mi", "co", "ra", "sch", "ung", "eau", "ci")) for _ in range(r.randint(6, 14)))
            key = r.choice((plain, plain.capitalize(), plain.upper(), "-".join(r.choices(words, k=4)) + str(r.randint(1, 99)), "/".join(r.choices(words, k=4)) + str(r.randint(1, 9)), "".join(r.choices("0123456789", k=r.randint(16, 20))), "_".join(r.choices(words, k=4)) + "2024"))
            before = r.choice(("see the ", "in file ", "order ", "and then ", "(", "http://"))
        text = (before + key + r.choice((" ", "\"\n", ", ", "."))).encode()
        xs.append(window(text, len(before), len(before) + len(key)))
        ys.append(k % 2)
    return xs, ys


def _scanned(texts: list[bytes]):
    """For each text its base findings and its candidates (code points), and the bytes' places of those."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    hs, he = runs(data, _HEX, 16)
    rs, re_ = runs(data, _RUN, MIN_RUN)
    hdoc, rdoc = (np.searchsorted(first, s, "right") - 1 for s in (hs, rs))
    hexes: dict[int, list] = {}
    cands: dict[int, list] = {}
    for k, s, e in zip(hdoc.tolist(), hs.tolist(), he.tolist(), strict=True):
        hexes.setdefault(k, []).append((s - int(first[k]), e - int(first[k])))
    for k, s, e in zip(rdoc.tolist(), rs.tolist(), re_.tolist(), strict=True):
        cands.setdefault(k, []).append((s - int(first[k]), e - int(first[k])))
    for k, raw in enumerate(texts):
        low = raw.lower()
        h, c = hexes.get(k, []), cands.get(k, [])
        if not h and not c and b"akia" not in low and not any(w in low for w in KEYWORDS):
            yield [], []
            continue
        text = raw.decode("utf-8", "replace")
        if len(text) == len(raw):
            at = int
        else:
            before = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
            at = lambda b, before=before: int(before[b])
        yield base_spans(text, low, [(at(s), at(e)) for s, e in h]), [(at(s), at(e), s, e) for s, e in c]


def _touches(s: int, e: int, spans) -> bool:
    return any(s < y and x < e for x, _, y in spans)


def labelled(df: DataFrame) -> DataFrame:
    """(y, h, x): all distinct windows and whether any of their places touches a base finding."""

    def run(batches):
        for batch in batches:
            for _, texts in steps([None] * batch.num_rows, batch.column(0).to_pylist()):
                held: dict[bytes, bool] = {}
                for raw, (spans, cands) in zip(texts, _scanned(texts), strict=True):
                    for s, e, bs, be in cands:
                        x = window(raw, bs, be).astype(np.uint8).tobytes()
                        held[x] = held.get(x, False) or _touches(s, e, spans)
                rows = [list(map(int, held.values())), [xxhash.xxh64_intdigest(x) >> 1 for x in held], list(held)]
                yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["y", "h", "x"])

    texts = short_batches(df.select(F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")))
    return texts.mapInArrow(run, "y int, h long, x binary").groupBy("h").agg(F.max("y").alias("y"), F.min("x").alias("x")).select("y", "h", "x")


_SHARDS = "shard long, tenth binary, y binary, x binary"


def _packed(windows: DataFrame, shards: int) -> DataFrame:
    """A row for each shard: tenths, labels and windows, by hash."""

    def pack(some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values("h")
        tenth = (some["h"].to_numpy() // shards % 10).astype(np.uint8)
        return pd.DataFrame({"shard": [some["shard"].iloc[0]], "tenth": [tenth.tobytes()], "y": [some["y"].to_numpy().astype(np.uint8).tobytes()], "x": [b"".join(some["x"])]})

    return windows.withColumn("shard", F.col("h") % shards).groupBy("shard").applyInPandas(pack, _SHARDS)


def _shards(batches):
    """(shard, tenths, labels, windows) of each row."""
    for batch in batches:
        for shard, *parts in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            tenth, y, x = (np.frombuffer(p, np.uint8) for p in parts)
            yield shard, tenth, y, x.reshape(len(y), -1)


def _with_made(shard: int, tenth: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    xs, ys = _synthetic(MADE, 5 + shard)
    made = np.random.default_rng([3, shard]).permutation(MADE) % 10
    return np.concatenate([tenth, made]), np.concatenate([y, ys]).astype(float), np.concatenate([x, np.array(xs, np.uint8)])


def _fitted(packed: DataFrame, labels: tuple[int, ...], recall: float, epochs: int = 8) -> CharCnn:
    """The network of all shards' windows of these labels and of made ones."""
    model = CharCnn()
    names = list(model.p)

    def chosen(batches):
        for shard, tenth, y, x in _shards(batches):
            some = np.isin(y, labels)
            yield shard, *_with_made(shard, tenth[some], y[some], x[some])

    for epoch in range(epochs):

        def descend(batches, model=model, epoch=epoch):
            for shard, tenth, y, x in chosen(batches):
                mine = CharCnn()
                mine.p = dict(model.p)
                mine.descend(x[tenth > 4], y[tenth > 4], [11, epoch, shard])
                weights = np.rint(np.concatenate([mine.p[n].ravel() for n in names]) * UNITS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([weights], pa.list_(pa.int64()))], ["weights"])

        each = packed.mapInArrow(descend, "weights array<long>").select(F.posexplode("weights").alias("k", "weight"))
        got = np.array([r["total"] / r["n"] for r in each.groupBy("k").agg(F.sum("weight").alias("total"), F.count("*").alias("n")).orderBy("k").collect()]) / UNITS
        for n, part in zip(names, np.split(got, np.cumsum([model.p[n].size for n in names])[:-1]), strict=True):
            model.p[n] = part.reshape(model.p[n].shape)

    def logits(batches):
        for _, tenth, y, x in chosen(batches):
            use = np.array([0, 0, 1, 1, 2])
            some = tenth < 5
            at = np.clip(np.rint(32 * model.logits(x[some])), -BINS, BINS - 1).astype(np.int64) + BINS
            code, n = np.unique((use[tenth[some]] * 2 + y[some].astype(np.int64)) * 2 * BINS + at, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

    counted = np.zeros(6 * 2 * BINS)
    for r in packed.mapInArrow(logits, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():  # as many rows as bins
        counted[r["code"]] = r["n"]
    model.calibrate({(k // 2, k % 2): part for k, part in enumerate(counted.reshape(6, -1))}, recall)
    return model


def train(df: DataFrame, recall: float = 0.99) -> CharCnn:
    """Fits the network on all distinct windows of df's texts, and made ones."""
    spark = df.sparkSession
    windows, path = written(labelled(df))
    n = windows.count()
    if not n:
        xs, ys = _synthetic(MADE)
        order = np.random.default_rng(3).permutation(MADE)
        return CharCnn().fit(np.array(xs)[order], np.array(ys, float)[order], recall=recall)
    packed, at_packed = written(_packed(windows, -(-n // SHARD)))
    discard(spark, path)
    first = _fitted(packed, (1,), recall)

    def plain(batches):  # what no pattern found may still be a secret: a first network without it says which are
        for shard, tenth, y, x in _shards(batches):
            keep = y == 1
            keep[~keep] = first.probability(x[~keep]) < 0.5
            rows = ([shard], *([np.ascontiguousarray(a[keep]).tobytes()] for a in (tenth, y, x)))
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["shard", "tenth", "y", "x"])

    kept, at_kept = written(packed.mapInArrow(plain, _SHARDS))
    discard(spark, at_packed)
    model = _fitted(kept, (0, 1), recall)
    discard(spark, at_kept)
    return model


def secret_scan(df: DataFrame, model: CharCnn | None = None) -> DataFrame:
    """One row per document: base counts, the digest of the base findings, all spans, the number of those of the network (kind cnn), and of base findings that it confirms."""
    model = model or train(df)

    def scan(ids, texts):
        out = {k: [] for k in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_cnn", "n_confirmed")}
        rows, asked = [], []
        for i, raw, (spans, cands) in zip(ids, texts, _scanned(texts), strict=True):
            asked += [(len(rows), s, e, raw, bs, be) for s, e, bs, be in cands]
            rows.append((i, spans, [], set()))
        for k in range(0, len(asked), 1 << 12):
            some = asked[k : k + (1 << 12)]
            for (n, s, e, *_), p in zip(some, model.probability(np.array([window(raw, bs, be) for *_, raw, bs, be in some])), strict=True):
                if p >= model.threshold:
                    _, spans, more, sure = rows[n]
                    over = [x for x in spans if x[0] < e and s < x[2]]
                    sure.update(over)
                    if not any(x[0] <= s and e <= x[2] for x in over):
                        more.append((s, 3, e))
        for i, spans, more, sure in rows:
            said = lambda xs: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(xs))
            for name, value in zip(out, (i, *(sum(k == n for _, k, _ in spans) for n in range(3)), hashlib.sha256(said(spans).encode()).hexdigest(), said(spans + more), len(more), len(sure)), strict=True):
                out[name].append(value)
        return out

    return map_texts(df, scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_cnn long, n_confirmed long")
