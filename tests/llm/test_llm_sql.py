"""Registered queries agree with their reference SQL, on given and on odd rows."""

import duckdb
import odd
import pandas as pd
import pytest

import check
from scatterloom.llm import licenses, lines, mixing, queries, secret_scan


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_agrees_with_sql(spark, con, sf, name):
    assert check.differences(spark, con, name, sf) == []


def of_odd_rows(spark, name):
    """What the SQL of a query says for odd rows that have an id and don't repeat."""
    df = odd.documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r.asDict() for r in df.select("doc_id", "text", "source").collect()]))
    return df, check.ordered(con.execute(queries.SQL[name]).df())


def same(got, want):
    got = check.ordered(got.select(*want.columns).toPandas())
    return got.astype(object).where(got.notna(), None).values.tolist() == want.astype(object).where(want.notna(), None).values.tolist()


def test_licenses_of_odd_rows(spark):
    df, want = of_odd_rows(spark, "op2_licenses")
    assert same(licenses.digest(licenses.scan(df)), want)


def test_secrets_of_odd_rows(spark):
    df, want = of_odd_rows(spark, "op9_secrets")
    assert same(secret_scan.digest(secret_scan.scan(df)), want)


def test_lines_of_odd_rows(spark):
    df, want = of_odd_rows(spark, "op7_line_dedup")
    from pyspark.sql import functions as F

    got = lines.dedup(df).select("doc_id", "n_lines", "n_dropped", F.length("text").cast("bigint").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
    assert same(got, want)


def test_mixing_of_odd_rows(spark):
    df, want = of_odd_rows(spark, "op8_mixing")
    assert same(mixing.mix(df, mixing.shares_by_size(df)), want)


def test_mixing_of_many_sources(spark):
    """The smallest of a hundred sources needs a longer period."""
    rows = [(i, odd.sentence(i, 5 + 60 * (i % 100 == 0)), f"s{i % 100}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    shares = mixing.shares_by_size(df)
    assert sum(shares.values()) > 1.5 * mixing.PERIOD
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r.asDict() for r in df.collect()]))
    assert same(mixing.mix(df, shares), check.ordered(con.execute(queries.SQL["op8_mixing"]).df()))
