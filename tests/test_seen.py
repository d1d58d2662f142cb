"""Incremental scans against full ones."""

from lodestone.operators.detect import first_versions
from lodestone.plans.scan import scan
from lodestone.sources import seen

COLS = "doc_id long, commit string, seq int, path string, oid string, text string"


def test_the_second_run_reads_new_texts_only(spark, tmp_path):
    at = str(tmp_path / "seen")
    one = [(1, "c0", 0, "a.txt", "o1", "8.8.8.8"), (2, "c0", 0, "b.txt", "o1", "8.8.8.8"), (3, "c1", 1, "a.txt", "o2", "8.8.4.4"), (4, "c1", 1, "a.txt", "o1", "8.8.8.8")]
    two = [*one, (5, "c2", 2, "a.txt", "o3", "9.9.9.9 9.9.9.10"), (6, "c2", 2, "c.txt", "o1", "8.8.8.8"), (7, "c3", 3, "a.txt", "o3", "9.9.9.9 9.9.9.10"), (8, "c3", 3, "b.txt", "o1", "8.8.8.8"), (None, "c3", 3, "d.txt", "o4", "1.1.1.1")]
    key = lambda r: (r.path, r.oid, r.commit, r.start)
    got, texts = [], []
    for rows in (one, two, two):
        now = spark.createDataFrame(rows, COLS)
        chosen = seen.unseen(now, seen.read_seen(spark, at))
        assert "text" not in chosen.columns
        fresh = seen.with_text(now, chosen)
        texts.append(fresh.count())
        got += map(key, scan(fresh).collect())
        seen.remember(spark.createDataFrame(chosen.collect(), chosen.schema), at)
    assert texts == [3, 3, 0]
    assert sorted(got) == sorted(map(key, scan(spark.createDataFrame(two, COLS)).collect()))


def test_first_versions_with_and_without_texts(spark):
    rows = [(i % 5 or None, f"c{i % 4}", i % 4, f"{i % 3}", f"o{i % 2}", "t") for i in range(60)]
    df = spark.createDataFrame(rows, COLS)
    want = {}
    for d, c, s, p, o, _ in rows:
        k = (s, c, d is not None, d or 0)
        want[p, o] = min(want.get((p, o), k), k)
    for got in (first_versions(df).drop("text").distinct(), first_versions(df.drop("text"))):
        assert {(r.path, r.oid): (r.seq, r.commit, r.doc_id is not None, r.doc_id or 0) for r in got.collect()} == want


def test_nothing_stored_and_nothing_given(spark, tmp_path):
    empty = spark.createDataFrame([], COLS)
    chosen = seen.unseen(empty, seen.read_seen(spark, str(tmp_path / "none")))
    assert chosen.count() == 0 and seen.with_text(empty, chosen).count() == 0
