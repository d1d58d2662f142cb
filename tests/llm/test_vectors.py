"""Filtering Lloyd against plain Lloyd rounds over all entries."""

import hashlib

import numpy as np
import pytest

from lodestone.llm.vector_codes import assign, build, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v string"


def plain(rows, parts=8, entries=16, rounds=6):
    """{row: (code, error)} and the digest, by comparing every part with every entry in Python's integers."""
    x = [[int(np.floor(4096.0 * float(c))) for c in v] for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    width = len(x[0]) // parts
    piece = [[row[p * width : (p + 1) * width] for row in x] for p in range(parts)]
    books = [[list(piece[p][i]) for i in order[:entries]] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    near = lambda p: [min((far(a, e), k) for k, e in enumerate(books[p])) for a in piece[p]]
    for _ in range(rounds):
        for p in range(parts):
            got = [k for _, k in near(p)]
            for k in set(got):
                own = [a for a, g in zip(piece[p], got, strict=True) if g == k]
                books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = [near(p) for p in range(parts)]
    said = ",".join(str(c) for b in books for e in b for c in e)
    return [("".join(f"{last[p][i][1]:02x}" for p in range(parts)), sum(last[p][i][0] for p in range(parts))) for i in range(len(rows))], hashlib.sha256(said.encode()).hexdigest()


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


@pytest.mark.parametrize("spread", ["normal", "ties", "large"])
def test_plain_rounds_agree(spark, spread):
    rng = np.random.default_rng(5)
    if spread == "normal":
        x = rng.normal(0, 0.2, (700, 16)) + rng.integers(0, 3, (700, 1))
    elif spread == "ties":
        x = rng.integers(-1, 2, (700, 16)) / 4096
    else:
        x = rng.normal(0, 1, (300, 16)) * 2.0 ** rng.integers(0, 18, (300, 1))
    x = x.astype(np.float32)
    rows = [(int(i) * 3, v.tolist(), int(i) % 4 if i % 7 else None) for i, v in zip(rng.permutation(len(x)), x, strict=True)]
    want, digest = plain(rows)
    got = {r.vec_id: r for r in vector_codes(table(spark, rows)).collect()}
    assert len(got) == len(rows) and {r.codebooks_sha256 for r in got.values()} == {digest}
    sums = {}
    for (i, _, label), (code, error) in zip(rows, want, strict=True):
        assert (got[i].code, got[i].error) == (code, error)
        sums[label] = sums.get(label, 0) + error
    assert all(got[i].label_error == sums[label] for i, _, label in rows)


@pytest.mark.parametrize("kind", [np.int64, object])
def test_a_tree_assigns_like_a_table(kind):
    """Ties, repeated entries and far points; Python's integers where longs end."""
    rng = np.random.default_rng(1)
    for times in (1, 2**40 if kind is object else 50):
        points = (rng.integers(-6, 7, (3000, 3)) * times).astype(kind)
        book = np.concatenate([points[:9], points[:3]])
        tree = build(points)
        counts, sums, codes = assign(tree, book, codes=True)
        far = ((points[:, None].astype(object) - book[None].astype(object)) ** 2).sum(-1)
        want = np.array([min(range(len(book)), key=lambda k: (row[k], k)) for row in far])
        assert (codes == want[tree[0]]).all() and (counts == np.bincount(want, minlength=len(book))).all()
        assert all((sums[k] == points[want == k].sum(0)).all() for k in range(len(book)) if counts[k])


def test_separated_points_are_assigned_by_subtrees():
    """Nodes far from all other entries are never opened, so that the leaves needn't hold their points."""
    points = np.concatenate([np.random.default_rng(k).integers(0, 9, (512, 4)) + 10_000 * k for k in range(2)])
    order, here, cut, rows = build(points)
    counts, _, _ = assign((order, np.zeros_like(here), cut, rows), np.array([[4] * 4, [10_004] * 4]))
    assert counts.tolist() == [512, 512]


def test_rows_that_hold_no_vector(spark):
    good = [(i, [float(i), -float(i)] * 4, None) for i in range(5)]
    bad = [(9, None, 1), (10, [float("nan")] * 8, 1), (11, [1.0, None] * 4, 1), (12, [], 1), (13, [float("inf")] * 8, 1), (14, [1.0] * 7, 1), (15, [1.0] * 16, 1), (16, [1e30] * 8, 1)]
    again = [(3, [3.0, -3.0] * 4, 2), (None, [7.0, 1.0] * 4, 2)]
    got = vector_codes(table(spark, good + bad + again)).collect()
    want, digest = plain(good + again)
    assert sorted(((r.vec_id is None, r.vec_id or 0), r.code, r.error) for r in got) == sorted(((i is None, i or 0), *w) for (i, _, _), w in zip(good + again, want, strict=True))
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_empty_table(spark):
    assert vector_codes(table(spark, [])).collect() == []
