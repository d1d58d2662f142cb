"""Collocations against counting in Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import collocations as co


def plain(rows, at_least=10, share=50, top=2000):
    counts, total = {}, Counter()
    for text, lang in rows:
        lang, low = lang or "und", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        f = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                f.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        cand = {g: a for g, a in f.items() if len(g) > 1 and a >= at_least}
        inner = {}
        for g, a in cand.items():
            if len(g) == 3:
                for h in (g[:2], g[1:]):
                    inner[h] = max(inner.get(h, 0), a)
        rows_ = []
        for g, a in cand.items():
            if 100 * inner.get(g, -1) >= share * a:
                continue
            score, _, left, right = min((10**6 * a * a // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            rows_.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows_)[:top])]
    return sorted(out)


def made(seed, n=150):
    rng = random.Random(seed)
    vocabulary = ["the", "THE", "of", "é", "übèr", "naïve", "x" * 40] + [f"w{i}" for i in range(40)]
    rows = []
    for _ in range(n):
        words = [rng.choice(vocabulary[: rng.choice([3, 8, 47])]) for _ in range(rng.randrange(0, 120))]
        rows.append(("".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\v", ": "]) for w in words), rng.choice(["en", "de", None])))
    return rows + [(None, "en"), ("", "de"), ("...", "xx"), ("one two", "fr"), ("of the of the " * 3000, "en")]


def got(docs, rows, **kw):
    return sorted(map(tuple, co.collocations(docs([(i, t, lang) for i, (t, lang) in enumerate(rows)]), **kw).collect()))


def test_counts_and_scores(docs):
    rows = made(1)
    assert got(docs, rows) == plain(rows)


def test_many_ranges_hot_keys_and_shuffled_dictionary(docs, monkeypatch):
    """Ranges of a few keys, so that common triples fill several, and a dictionary that isn't broadcast; ranks in salted parts."""
    monkeypatch.setattr(co, "RANGE", 3)
    monkeypatch.setattr(co, "small_side", lambda df: df)
    monkeypatch.setattr(co, "RANKED", 20)
    rows = made(2, 60) + [("of the w1 of the w2", "en")] * 40
    want = plain(rows, top=15)
    assert got(docs, rows, top=15) == want and len(want) > 20


@pytest.mark.parametrize("digits", [1, 2, 3])
def test_radix_runs(digits):
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 1 << (16 * digits - 2), (3, 6))[:, rng.integers(0, 6, 4000)]
    n = rng.integers(1, 9, 4000)
    planes, sums = co.radix_runs(co.planes_of(ids, digits), n)
    want = Counter()
    for key, k in zip(map(tuple, ids.T.tolist()), n.tolist(), strict=True):
        want[key] += k
    assert [(*map(int, k), int(s)) for k, s in zip(co.numbers_of(planes, digits).T, sums, strict=True)] == [(*k, want[k]) for k in sorted(want)]
    keys = co.as_bytes(planes)
    assert (keys[1:] > keys[:-1]).all()


def test_ranges_of_repeated_bounds():
    bounds = np.array([b"b", b"d", b"d", b"d", b"f"])
    keys = np.array([b"a", b"b", b"c", b"d", b"e", b"f", b"g"])
    for salt in range(9):
        to = co._range_of(keys, bounds, salt)
        assert to[[0, 1, 2, 4, 5, 6]].tolist() == [0, 1, 1, 4, 5, 5] and to[3] == 2 + salt % 3


def test_big_products_are_exact(spark):
    a, left, right = 9_000_000_000_000_001, 9_000_000_000_000_007, 9_100_000_000_000_003
    from pyspark.sql import functions as F

    row = spark.range(1).select(co._score(F.lit(a), F.lit(left), F.lit(right)).alias("s")).first()
    assert row.s == 10**6 * a * a // (left * right)


def test_nothing_often_enough(docs, edge):
    assert co.collocations(docs([])).collect() == []
    assert co.collocations(docs([(1, "a b c d"), (2, None), (3, ". . .")])).collect() == []
    words = {r.phrase: r for r in co.collocations(edge).collect()}
    assert words["word word word"].a == 29998 and words["word word word"].n > 30000 - 1
