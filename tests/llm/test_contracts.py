"""Each registered query on the small tables: its columns, one row for each document, and base columns by brute force."""

import hashlib
import os
import re
import zlib

import duckdb
import pytest

from lodestone.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3_license_scan": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
    "op5_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op7_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op8_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op9_lm_score": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op10_ngram_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op11_collocations": {"lang": "string", "rank": "bigint", "phrase": "string", "a": "bigint", "l": "bigint", "r": "bigint", "n": "bigint", "score": "bigint"},
    "op12_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op13_vector_codes": {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"},
}
#: Queries whose rows aren't documents.
OTHERS = {"op11_collocations", "op13_vector_codes"}


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def held(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def check_op1(got, texts):
    assert all(x.held_out == (held(i, 5) == 0) and 0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for i, x in got.items())


def check_op5(got, texts):
    assert all(x.held_out == (held(i, 5) == 0) and 0 <= x.score <= 1 and (x.lang_pred == "und") == (not any(c.isalpha() for c in texts[i])) for i, x in got.items())


def check_op3(got, texts):
    phrases = ((["mit", "license"], "mit"), (["apache", "license"], "apache"), (["general", "public", "license"], "gpl"))
    for i, x in got.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(texts[i]))
        at = [(k, lab) for p, lab in phrases for k in range(len(w)) if w[k : k + len(p)] == p]
        assert (x.n_words, x.n_base, x.base_labels) == (len(w), len(at), ",".join(sorted({b for _, b in at})))
        assert (x.first_word, x.last_word) == (min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))


def check_op7(got, texts):
    for i, x in got.items():
        w, seen = re.findall(r"[^\x20\x09-\x0D]+", texts[i]), {}
        for k in range(len(w) - 7):
            seen.setdefault(tuple(w[k : k + 8]), []).append(k)
        covered = {q for ps in seen.values() if len(ps) > 1 for p in ps for q in range(p, p + 8)}
        lines = [y for y in texts[i].split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in texts[i]), len(lines) - len(set(lines)), len(covered))


def check_op8(got, texts):
    for i, x in got.items():
        found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", texts[i], re.I | re.A) if len(m[2]) >= 12]
        found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", texts[i]) if len(m[0]) >= 18]
        found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", texts[i]) if len(m[0]) >= 16]
        said = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))
        assert x.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and set(filter(None, said.split(","))) <= set(filter(None, x.spans.split(",")))


def check_op9(got, texts):
    train = [t for i, t in texts.items() if held(i, 7) != 2]
    n = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) + 1 for t in train)
    assert all(x.train_tokens == n and x.held_out == (held(i, 7) == 2) and x.n_tokens == len(re.findall(r"[^\x20\x09-\x0D]+", texts[i])) + 1 and x.score < 0 for i, x in got.items())
    better = [x.score > x.base_score for x in got.values() if x.held_out]
    assert sum(better) >= 0.8 * len(better)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, texts, name):
    out = QUERIES[name](spark, SF)
    for c, kind in COLUMNS.get(name, {"doc_id": "bigint"}).items():
        assert dict(out.dtypes)[c] == kind
    if name in OTHERS:
        return
    rows = out.collect()
    got = {x.doc_id: x for x in rows}
    assert len(rows) == len(texts) and set(got) == set(texts)
    check = globals().get(f"check_{name.split('_')[0]}")
    if check:
        check(got, texts)


def test_sql_of_the_join(spark):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    for name, sql in ORACLE_SQL.items():
        want = con.execute(sql).df()
        got = QUERIES[name](spark, SF).toPandas()
        cols = sorted(want.columns)
        assert sorted(map(tuple, got[cols].values.tolist())) == sorted(map(tuple, want[cols].values.tolist()))


def test_blanks_cost_no_more_than_words(spark, docs):
    """A text of a million blanks, in time that grows with its length."""
    import time

    from lodestone.llm.quality_rules import quality_rules

    began = time.time()
    row = quality_rules(docs([(1, "a" + " " * 1_000_000 + "b")]), []).first()
    assert (row.n_words, row.word_chars) == (2, 2) and time.time() - began < 30
