"""Keyword matches by an index of grams against a nested loop."""

import random

import pytest
from pyspark.sql import functions as F

from fundlattice.operators.keywords import first_match, keyword_matches


@pytest.mark.parametrize("size", [1, 3])
def test_thousands_of_keywords_match_as_in_a_nested_loop(spark, size):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcdeé指数") for _ in range(n))
    names = [(k, word(r.randint(0, 30))) for k in range(300)] + [(300, None), (301, "a"), (302, "a"), (303, "abc" * 200)]
    keywords = [(k, word(r.randint(1, 6))) for k in range(3000)] + [(3000, ""), (3001, None), (3002, "zzz")]
    n = spark.createDataFrame(names, "id int, name string")
    k = spark.createDataFrame(keywords, "ord int, keyword string")
    found = keyword_matches(n, k, size=size)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    want = sorted((i, o) for i, t in names for o, w in keywords if t is not None and w and w in t)
    assert sorted((x["id"], x["ord"]) for x in found.select("id", "ord").collect()) == want
    first = {x["id"]: x["keyword"] for x in first_match(n, k, size=size).collect()}
    words = dict(keywords)
    assert first == {i: words[min(o for j, o in want if j == i)] if any(j == i for j, _ in want) else None for i, _ in names}


def test_no_keywords_match_nothing(spark):
    n = spark.createDataFrame([(1, "abc")], "id int, name string")
    k = spark.createDataFrame([], "ord int, keyword string")
    assert keyword_matches(n, k).count() == 0
    assert first_match(n, k).collect()[0]["keyword"] is None
    assert first_match(n, k.unionAll(n.select(F.lit(1), F.lit("b")))).collect()[0]["keyword"] == "b"
