import re

import duckdb
import pytest
import regex

import __spark_entry__ as entry
from docframe.plans.queries import QUERIES, SQL

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def rows(pdf):
    names = sorted(pdf.columns)
    pdf = pdf[names].astype(object)
    clean = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else v
    return names, sorted((tuple(clean(v) for v in r) for r in pdf.values.tolist()), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, D).toPandas()) == rows(duck.execute(SQL[name]).df())


def test_wrap():
    from docframe.operators.layout import wrap

    assert wrap("hi abcdef", 35) == ["hi", "abcdef"]
    assert wrap("abcdefghij", 20) == ["abcd", "efgh", "ij"]
    assert wrap("one\ntwo\n", 100) == ["one", "two", ""]


def test_line_wrapping_runs(spark):
    assert QUERIES["q21_line_wrapping"](spark, D).count() == spark.read.parquet(f"{D}/documents.parquet").count()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_line_wrapping_counts(spark):
    def n_lines(text):
        n = 0
        for part in text.split("\n"):
            n, used = n + 1, 0
            for token in re.findall(r"[ \t]+|[^ \t]+", part):
                size = len(regex.findall(r"\X", token))
                if token[0] not in " \t":
                    if used and used + size > 90:
                        n, used = n + 1, 0
                    while used + size > 90:
                        n, size, used = n + 1, size - (90 - used), 0
                used += size
        return n

    want = {r["doc_id"]: n_lines(r["text"]) for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    assert {r["doc_id"]: r["n_lines"] for r in QUERIES["q21_line_wrapping"](spark, D).collect()} == want


def test_diagnostics_without_broadcast(spark):
    plan = QUERIES["q25_diagnostics"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Broadcast" not in plan and "Join" not in plan


def test_diagnostics_of_odd_rows(spark, tmp_path):
    events = [(1, "view"), (2, None), (3, ""), (3, "click"), (3, "view"), (None, "click"), (None, None), (None, "view")]
    spark.createDataFrame(events, "event_id bigint, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = rows(QUERIES["q25_diagnostics"](spark, str(tmp_path)).toPandas())
    assert got == rows(con.execute(SQL["q25_diagnostics"]).df())
    assert got[1] == sorted([("view", 6), ("click", 4), (None, 4), ("", 2)], key=repr)
