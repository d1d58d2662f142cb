"""Queries against their SQL on rows that the small tables lack."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.plans import catalog


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query's rows on the given tables are those of its SQL; gives them."""

    def check(name, **tables):
        con = duckdb.connect()
        for t, df in tables.items():
            df.write.parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        got = catalog.QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
        rows = sorted(map(str, map(tuple, got.collect())))
        assert rows == sorted(map(str, want))
        return rows

    return check


def test_addresses_of_many_customers(spark, same):
    """The addresses of customers from 65,536 on have more than 16 bits in their last number."""
    customers = spark.createDataFrame([(k,) for k in (2, 18, 65_522, 65_538, 70_002, 900_002, 2**33 + 7)], "c_custkey long")
    rows = same("network_membership", customer=customers, orders=spark.range(1, 50).select(F.col("id").alias("o_orderkey")), part=spark.range(1, 5_000).select(F.col("id").alias("p_partkey")))
    assert sum(r.startswith("('2001:") for r in rows) == 7


WORDS = ["weiß", "ﬁn", "ᾳx", "ŉa", "ẞ", "ὈΔΌΣ", "İz", "𐐨a", "ǆ"]


def _texts(spark):
    """Each word as the third of a text that has it in other places, too."""
    return spark.createDataFrame([(6 * i + k, f"a b {w} {w}c") for i, w in enumerate(WORDS, 7) for k in range(6)], "doc_id long, text string")


def test_upper_case_of_single_letters(spark, same):
    """Words whose upper case has more letters are markers as SQL writes them."""
    rows = same("contract_verdicts", documents=_texts(spark))
    assert any("'WEIẞ', 'met'" in r for r in rows)


def test_states_of_rules_with_such_words(spark, same):
    rows = same("rule_states", documents=_texts(spark))
    assert sum(int(r.split(", ")[2]) for r in rows) > 10
