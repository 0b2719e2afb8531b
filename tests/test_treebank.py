"""Tokens by the Treebank rules, on the published kinds of example."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.plans import data_queries

CASES = [
    ("Good muffins cost $3.88 in New York.  Please buy me two of them.\nThanks.", "Good muffins cost $ 3.88 in New York . Please buy me two of them . Thanks ."),
    ("They'll save and invest more.", "They 'll save and invest more ."),
    ("hi, my name can't hello,", "hi , my name ca n't hello ,"),
    ('"Hello," she said (softly).', "`` Hello , '' she said ( softly ) ."),
    ("I cannot cannot see; gimme it, it's John's -- isn't it?", "I can not can not see ; gim me it , it 's John 's -- is n't it ?"),
    ("The U.S. army has 1,000 men... and 10:30 is time: now!", "The U.S. army has 1,000 men ... and 10:30 is time : now !"),
    ("'tis wanna gonna more'n", "'t is wan na gon na more 'n"),
    ("the dogs' bone & <b>x</b>", "the dogs ' bone & < b > x < /b >"),
    ("", ""), ("  ", ""), (None, None),
]


@pytest.fixture(scope="module")
def got(spark):
    rows = spark.createDataFrame([(k, c[0]) for k, c in enumerate(CASES)], "k int, x string").select("k", F.array_join(text.treebank_tokens("x"), " ").alias("t")).collect()
    return {r["k"]: r["t"] for r in rows}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_cases(got, k):
    assert got[k] == CASES[k][1]
    assert duckdb.execute(f"SELECT array_to_string({data_queries._sql_treebank('x')}, ' ') FROM (SELECT ?::VARCHAR AS x)", [CASES[k][0]]).fetchone()[0] == CASES[k][1]
