"""Table and index fixtures: what is admitted, and what isn't."""

import time

import pytest
from pyspark.sql import functions as F

from lodestone.functions.fixtures import schema_only

ADMITTED = [
    "CREATE TABLE sample (id INTEGER);",
    "-- Structure only.\nCREATE TABLE items (\n  id TEXT PRIMARY KEY,\n  label TEXT DEFAULT 'fixture',\n  n INTEGER CHECK (n >= 0)\n);\nCREATE INDEX by_label ON items (label);\nCREATE UNIQUE INDEX tagged ON items (label) WHERE label LIKE 'tag:%';\n",
    "/* CREATE TRIGGER x; INSERT y; */ CREATE TABLE s (\"a;b\" TEXT DEFAULT 'v; -- t /* l */ it''s (safe', `o;c` TEXT, [f;c] TEXT); -- end\ncreate index i on s (\"a;b\");",
    "create table t (a text default '--;/*');",
    "CREATE TABLE t (a TEXT DEFAULT ')))');",
    "CREATE INDEX i ON t (lower(a), (b)) WHERE a LIKE '';",
    "CREATE INDEX i ON t (a) WHERE a LIKE 'it''s;%';",
    "CREATE TABLE t (a INT) /* after */ ;\n\n-- last\n",
    "CREATE TABLE t (a INT DEFAULT 4-2, b INT DEFAULT 4/2);",
    "CREATE TABLE t (a TEXT DEFAULT 'AS SELECT');",
    "CREATE TABLE t (as_select INT);",
    "CREATE TABLE t (a INT);" * 512,
]
DENIED = [
    None, "", " \n", "-- only a comment", "/* only */", ";",
    "CREATE TABLE t (a INT)", "CREATE TABLE t (a INT;", "CREATE TABLE t (a INT));", "CREATE TABLE t (a INT);;", "CREATE TABLE t (a INT)(b INT);", "CREATE TABLE t )a INT(;", "CREATE TABLE t ();",
    "CREATE TABLE t (a TEXT DEFAULT 'open);", "CREATE TABLE t (a TEXT DEFAULT 'it''s);", 'CREATE TABLE t ("a INT);', "CREATE TABLE t (`a INT);", "CREATE TABLE t ([a INT);", "CREATE TABLE t (a] INT);",
    "CREATE TABLE t (a INT); /* open", "CREATE TABLE t (a INT); x", "CREATE TABLE t (a INT); INSERT INTO t VALUES (1);", "INSERT INTO t VALUES ('CREATE TABLE t (a INT)');",
    "CREATE TABLE t AS SELECT * FROM s;", "CREATE TABLE t (a INT) AS WITH s AS (SELECT 1) SELECT * FROM s;", "CREATE TABLE t (a INT) AS /* c */ SELECT (1);",
    "CREATE VIEW v AS SELECT (1);", "CREATE VIRTUAL TABLE t USING m(a);", "CREATE TEMP TABLE t (a INT);", "CREATE TABLE \"t\" (a INT);", "CREATE TABLE 2t (a INT);", "DROP TABLE t;", "BEGIN; CREATE TABLE t (a INT); COMMIT;",
    "CREATE INDEX i ON t (a) WHERE a = 1;", "CREATE INDEX i ON t (a) WHERE a LIKE b;", "CREATE INDEX i ON t (a) WHERE a LIKE \"b\";",
    "CREATE TABLE t (a\x00 INT);", "CREATE TABLE t (a INT);" * 513, "CREATE TABLE t (a TEXT DEFAULT '" + "é" * 131_072 + "');",
]


def test_cases(spark):
    cases = [(i, t) for i, t in enumerate(ADMITTED + DENIED)]
    got = {r.i: r.ok for r in spark.createDataFrame(cases, "i int, text string").select("i", schema_only(F.col("text")).alias("ok")).collect()}
    assert [t for i, t in cases if got[i] != (i < len(ADMITTED))] == []


@pytest.mark.parametrize("text", ["CREATE TABLE t (a TEXT DEFAULT '" + "''" * 120_000 + "');", "CREATE TABLE t (" + "(" * 100_000 + "1" + ")" * 100_000 + ");", "CREATE TABLE t (a INT);" + "-- c\n" * 50_000])
def test_long_fixtures_take_no_deep_stack_and_little_time(spark, text):
    began = time.time()
    assert spark.createDataFrame([(text,)], "text string").select(schema_only(F.col("text"))).first()[0]
    assert time.time() - began < 15
