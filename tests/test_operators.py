"""Operators against plain Python on generated rows."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orderboard.functions.labels import label_codes
from orderboard.functions.numbers import rounded_avg
from orderboard.operators import dimensions as dm
from orderboard.operators import key_filter
from orderboard.operators.ranking import bottom_n, first_name, ranked, top_bottom, top_n

few = settings(
    max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
FACTS = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 5)), st.integers(-9, 9)), max_size=30)
DIMENSION = st.dictionaries(st.integers(0, 5), st.one_of(st.none(), st.sampled_from("xy")))
GROUPS = st.dictionaries(st.text("abc", min_size=1, max_size=2), st.one_of(st.none(), st.integers(0, 3)))


def rows(df):
    return [tuple(r) for r in df.collect()]


@few
@given(facts=FACTS, dimension=DIMENSION)
def test_both_plans_equal_brute_force(spark, facts, dimension):
    values = defaultdict(list)
    for key, value in facts:
        if key in dimension:
            values[dimension[key]].append(value)
    want = {k: (sum(v), len(v), max(v)) for k, v in values.items()}
    left = spark.createDataFrame(facts, "k int, v int")
    right = spark.createDataFrame(list(dimension.items()), "k int, n string")
    measures = [dm.total("s", "v"), dm.row_count("c"), dm.largest("m", "v")]
    for plan in (dm.join_then_total, dm.total_then_join, dm.total_by_attributes):
        got = rows(plan(left, right, "k", ["n"], measures))
        assert {r[0]: r[1:] for r in got} == want
        assert len(got) == len(want)


@few
@given(facts=FACTS, dimension=DIMENSION)
def test_plans_agree_on_a_column_of_the_facts(spark, facts, dimension):
    left = spark.createDataFrame(facts, "k int, v int")
    right = spark.createDataFrame(list(dimension.items()), "k int, n string")
    got = [
        sorted(rows(plan(left, right, "k", ["v", "n"], [dm.row_count("c")])), key=str)
        for plan in (dm.join_then_total, dm.total_then_join)
    ]
    assert got[0] == got[1]


@few
@given(facts=FACTS, dimension=DIMENSION)
def test_key_range_loses_nothing(spark, facts, dimension):
    left = spark.createDataFrame(facts, "k int, v int")
    right = spark.createDataFrame(list(dimension.items()), "k int, n string")
    plans = [
        dm.total_by_attributes(left, right, "k", ["n"], [dm.row_count("c")], within_keys=w)
        for w in (False, True)
    ]
    assert sorted(rows(plans[0]), key=str) == sorted(rows(plans[1]), key=str)


@few
@given(groups=GROUPS, n=st.integers(1, 4), descending=st.booleans())
def test_top_n_with_null_as_largest(spark, groups, n, descending):
    def key(item):
        largest = item[1] is None
        value = float("inf") if largest else item[1]
        return (-value if descending else value, item[0])

    want = sorted(groups.items(), key=key)[:n]
    df = spark.createDataFrame(list(groups.items()), "g string, m int")
    assert rows(top_n(df, "m", n, ["g"], descending)) == want
    assert rows(ranked(df, "m", n, ["g"], descending)) == [
        (*row, i) for i, row in enumerate(want, 1)
    ]
    best = want[0][0] if want else None
    assert rows(df.agg(first_name("g", "m", descending))) == [(best,)]


@few
@given(groups=GROUPS, n=st.integers(1, 3))
def test_bottom_is_the_end_of_the_descending_order(spark, groups, n):
    df = spark.createDataFrame(list(groups.items()), "g string, m int")
    whole = rows(top_n(df, "m", 100, ["g"]))
    assert rows(bottom_n(df, "m", n, ["g"])) == whole[-n:][::-1]
    both = rows(top_bottom(df, "m", n, ["g"]))
    assert both == [(*r, "top") for r in whole[:n]] + [(*r, "bottom") for r in whole[-n:]]


@few
@given(facts=FACTS, dimension=DIMENSION, bits=st.sampled_from([4096, 1 << 20]))
def test_key_filter_loses_no_match(spark, facts, dimension, bits):
    left = spark.createDataFrame(facts, "k int, v int")
    right = spark.createDataFrame([(k, n) for k, n in dimension.items()], "k long, n string")
    passed = rows(key_filter.may_match(left, right, "k", bits))
    assert Counter(r for r in rows(left) if r[0] in dimension) <= Counter(passed) <= Counter(rows(left))


def test_key_filter_drops_most_others(spark):
    left, right = spark.range(20_000).toDF("k"), spark.range(0, 20_000, 100).toDF("k")
    assert 200 <= key_filter.may_match(left, right, "k").count() < 3000
    assert key_filter.may_match(left, right.limit(0), "k").count() == 0
    texts = left.selectExpr("string(k) AS k")
    assert 200 <= key_filter.may_match(texts, right.selectExpr("string(k) AS k"), "k").count() < 3000
    # Keys that hash apart are left to the join.
    assert key_filter.may_match(texts, right, "k").count() == 20_000
    marked = key_filter.marked(left, right, "k", "m")
    assert marked.columns == ["k", "m"] and marked.count() == 20_000
    assert rows(marked.filter("m").select("k").orderBy("k")) == rows(key_filter.may_match(left, right, "k").orderBy("k"))
    assert key_filter.marked(left, right, "k", "m", bits=0).filter("m").count() == 20_000
    # However many keys there are, the field has no more pages than its limit.
    full = key_filter.field_mask(left, 4096)
    assert left.limit(1).select(full).first()[0] == 4095
    assert key_filter.bits_within(100) == 0 and key_filter.bits_within(64 << 20) == 1 << 28


def test_measuring_a_dimension(spark):
    small = spark.createDataFrame([(k, "a") for k in range(1, 7)], "k int, n string")
    found = dm.measure(small, "k")
    assert found == (6 * (64 + 2 * 16) + 6, 6, 1) and found.joins_first(1000) and not found.joins_first(100)
    many = spark.range(100).withColumnRenamed("id", "k")
    assert dm.measure(many, "k") == (100 * (64 + 16), 100, 1)
    unbounded = spark.createDataFrame([(1, [1])], "k int, n array<int>")
    assert not dm.measure(unbounded, "k").joins_first(1 << 40)
    assert dm.measure(small.filter("k > 9"), "k") == (0, 0, 0)
    own = spark.createDataFrame([(k, str(k)) for k in range(50)], "k int, n string")
    assert not dm.measure(own, "k").joins_first(1 << 40)


def test_labels(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    shown = df.select(label_codes(F.col("c"), {"a": "A", "b": "B"}, "other"))
    assert rows(shown) == [("A",), ("other",), ("other",)]


@pytest.mark.parametrize("cents, mean", [([1, 2], "0.02"), ([1, 1, 2], "0.01"), ([None, 5], "0.05")])
def test_average_rounds_half_up_and_skips_null(spark, cents, mean):
    df = spark.createDataFrame([(c,) for c in cents], "c int").select(
        (F.col("c") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(12,2)").alias("x")
    )
    assert str(rows(df.agg(rounded_avg("x").cast("decimal(12,2)")))[0][0]) == mean
