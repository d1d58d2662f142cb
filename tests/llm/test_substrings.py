"""Substring dedup against comparing all windows, and the parse's stable interiors."""

import hashlib
import random
import re

import numpy as np
import pytest

from lodestone.llm import substring_dedup as sd


def plain(rows, width):
    texts = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    key = lambda i: float("inf") if i is None else i
    least = {}
    for (i, _), w in zip(rows, texts, strict=True):
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            least[g] = min(least.get(g, float("inf")), key(i))
    out = []
    for (i, _), w in zip(rows, texts, strict=True):
        gone = set()
        for k in range(len(w) - width + 1):
            if least[tuple(w[k : k + width])] < key(i):
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, width):
    """Texts of shared passages, copies, runs, periods and edits."""
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "The", "of", "é", "x,"]) if rng.random() < 0.3 else f"w{rng.randrange(3000)}"
    passages = [[word() for _ in range(rng.randrange(width - 5, 3 * width))] for _ in range(8)]
    rows = []
    for i in range(60):
        w = [word() for _ in range(rng.randrange(3 * width))]
        for _ in range(rng.randrange(3)):
            p, at = rng.choice(passages), rng.randrange(len(w) + 1)
            w[at:at] = p[rng.randrange(5) : len(p) - rng.randrange(5)]
        if rng.random() < 0.2:
            w += ["run"] * rng.randrange(3 * width)
        if rng.random() < 0.2:
            w += (["a", "b", "c"] * width)[: rng.randrange(3 * width)]
        rows.append((i * 2, rng.choice([" ", "\n", " \t"]).join(w)))
    for i in range(30):
        w = rows[rng.randrange(60)][1].split()
        if i % 2 and w:
            w[rng.randrange(len(w))] = "edited"
        rows.append((i * 2 + 1, " ".join(w)))
    rng.shuffle(rows)
    return [*rows, (500, None), (501, ""), (None, rows[0][1]), (None, rows[0][1]), (rows[1][0], rows[1][1]), (502, "run " * 3000)]


@pytest.mark.parametrize("width", [12, 50])
def test_windows_by_comparison(docs, monkeypatch, width):
    monkeypatch.setattr(sd, "BUCKET", 200)
    for seed, parts in ((1, 1), (2, 7)):
        rows = made(seed, width)
        got = sd.substring_dedup(docs(rows).repartition(parts), width=width).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == plain(rows, width)
        assert all(r.n_removed == sum(s.end - s.start for s in r.removed) for r in got)


def test_texts_without_the_removed_words(docs):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"one {passage} two"), (2, f"three  {passage}\nfour five"), (3, passage), (4, "six " + passage.replace("p30 ", "other "))]
    got = {r.doc_id: r for r in sd.substring_dedup(docs(rows), texts=True).collect()}
    assert (got[1].removed, got[1].text) == ([], f"one {passage} two")
    assert ([(s.start, s.end) for s in got[2].removed], got[2].text) == ([(1, 61)], "three four five")
    assert got[3].text == "" and got[4].removed == []


def test_interiors_are_the_same_wherever_a_window_stands():
    """The symbols inside a window don't depend on what stands around it, and most windows have some."""
    rng = np.random.default_rng(7)
    for vocabulary in (3, 50, 10**6):
        core = rng.integers(0, vocabulary, 50)
        seen = set()
        for _ in range(30):
            before, after = rng.integers(0, vocabulary, rng.integers(0, 40)), rng.integers(0, vocabulary, rng.integers(0, 40))
            h = sd.mix(np.concatenate([before, core, after]).astype(np.uint64))
            names, _, low, high = sd.parse(h, np.zeros(len(h), int), np.array([len(before)]), 50)
            seen.add(tuple(names[low[0] : high[0]].tolist()))
        assert len(seen) == 1
    h = sd.mix(rng.integers(0, 10**6, 20_000).astype(np.uint64))
    names, _, low, high = sd.parse(h, np.zeros(len(h), int), np.arange(len(h) - 49), 50)
    assert len(names) < 0.2 * len(h) and (high > low).mean() > 0.9


def test_edges(docs, edge):
    assert sd.substring_dedup(docs([])).collect() == []
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in sd.substring_dedup(edge).collect())
    assert got == sorted([("1", 0, 0), ("2", 0, 0), ("3", 30000, 0), ("None", 6, 0), ("4", 4, 0), ("4", 4, 0), ("5", 0, 0), ("6", 1, 0)])
