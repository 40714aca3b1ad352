"""Ordered-scan building blocks and the folds built on them, against brute force."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeatlas.operators.ordered import row_index, running_sum, window_sum
from codeatlas.operators.packing import pack_batches
from codeatlas.operators.sampling import keyframes


def _rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("sums", [running_sum, window_sum])
def test_running_sums_with_a_hot_group(spark, sums):
    # Without coalescing the hot group spans most of the eight ranges.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rnd = random.Random(7)
    data = [(rnd.choice(["a", "b", "hot"] + ["hot"] * 5), i, rnd.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, i long, v long")
    out = sums(df, ["g"], ["i"], "v", "s")
    expect, acc = [], {}
    for g, i, v in sorted(data, key=lambda r: (r[0], r[1])):
        acc[g] = acc.get(g, 0) + v
        expect.append((g, i, acc[g]))
    assert _rows(out, "g", "i", "s") == sorted(expect)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_row_index(spark):
    df = spark.createDataFrame([("x", k, k * 10) for k in range(50)], "g string, k long, key long")
    idx = row_index(df, ["g"], ["k"], "idx")
    assert _rows(idx, "k", "idx") == [(k, k) for k in range(50)]


def _pack_reference(sizes, budget):
    batches, cur, b = [], 0, 1
    for i, s in enumerate(sizes):
        if i == 0:
            cur = s
        elif cur + s < budget:
            cur += s
        else:
            b += 1
            cur = s
        batches.append(b)
    return batches


@pytest.mark.parametrize("sizes,expect", [
    ([4, 4, 1, 4, 4], [1, 1, 1, 2, 2]),
    ([4, 4, 4], [1, 1, 2]),
    ([12, 1, 1], [1, 2, 2]),
    ([4, 4, 9, 4], [1, 1, 2, 3]),
])
def test_pack_batches_fixture(spark, sizes, expect):
    df = spark.createDataFrame([("i", k, s) for k, s in enumerate(sizes)], "inst string, k long, size long")
    out = pack_batches(df, ["inst"], ["k"], "size", budget=10)
    got = [r["batch_no"] for r in sorted(out.collect(), key=lambda r: r["k"])]
    assert got == expect
    over = {r["k"]: r["oversize"] for r in out.collect()}
    assert over[0] == (sizes[0] >= 10)


def test_pack_batches_faithful(spark):
    # literal rule: 4 4 4 -> [0,1] and item 2 lost; 12 1 1 -> empty first batch, then [0,1,2].
    df = spark.createDataFrame([("a", 0, 4), ("a", 1, 4), ("a", 2, 4), ("b", 0, 12), ("b", 1, 1), ("b", 2, 1)],
                               "inst string, k long, size long")
    out = pack_batches(df, ["inst"], ["k"], "size", budget=10, faithful=True)
    got = sorted((r["inst"], r["k"], r["batch_no"]) for r in out.collect())
    assert got == [("a", 0, 1), ("a", 1, 1), ("b", 0, 2), ("b", 1, 2), ("b", 2, 2)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=40), min_size=1, max_size=60))
def test_pack_batches_property(spark, sizes):
    df = spark.createDataFrame([("i", k, s) for k, s in enumerate(sizes)], "inst string, k long, size long")
    out = pack_batches(df, ["inst"], ["k"], "size", budget=50)
    got = [r["batch_no"] for r in sorted(out.collect(), key=lambda r: r["k"])]
    assert got == _pack_reference(sizes, 50)


def test_pack_batches_one_long_group(spark):
    rnd = random.Random(3)
    sizes = [rnd.randint(0, 30) for _ in range(200)]
    df = spark.createDataFrame([("hot", k, s) for k, s in enumerate(sizes)], "inst string, k long, size long")
    out = pack_batches(df, ["inst"], ["k"], "size", budget=64)
    got = [r["batch_no"] for r in sorted(out.collect(), key=lambda r: r["k"])]
    assert got == _pack_reference(sizes, 64)


def _keyframes_reference(values, thr, step=2):
    frames = values[::step]
    kept, last = [], None
    for i, v in enumerate(frames):
        if i == 0 or abs(v - last) > thr:
            kept.append(i * step)
            last = v
    return kept


def test_keyframes_against_brute_force(spark):
    rnd = random.Random(11)
    values = [round(rnd.uniform(0, 50), 2) for _ in range(120)]
    df = spark.createDataFrame([("s", k, v) for k, v in enumerate(values)], "seq string, k long, v double")
    out = keyframes(df, ["seq"], ["k"], "v", threshold=8.0)
    got = sorted((r["k"], r["kept_no"]) for r in out.collect())
    ref = _keyframes_reference(values, 8.0)
    assert [k for k, _ in got] == ref
    assert [n for _, n in got] == list(range(1, len(ref) + 1))


def _null_cases(spark):
    from codeatlas.operators.packing import pack_batches
    from codeatlas.operators.sampling import keyframes

    items = spark.createDataFrame([(g, i, s) for g in ("a", None) for i, s in enumerate([4, 4, 4, None])], "g string, i long, s long")
    packs = sorted(((r["g"] or "", r["i"], r["batch_no"]) for r in pack_batches(items, ["g"], ["i"], "s", budget=10).collect()))
    frames = spark.createDataFrame([(g, i, v) for g, vs in (("a", [1.0, None, 50.0, None]), (None, [None, 1.0, 50.0]))
                                    for i, v in enumerate(vs)], "g string, i long, v double")
    kept = sorted((r["g"] or "", r["i"], r["idx"], r["kept_no"]) for r in keyframes(frames, ["g"], ["i"], "v", 10.0, step=1).collect())
    return packs, kept


_PACKS = [(g, i, b) for g in ("", "a") for i, b in enumerate([1, 1, 2, 2])]
_KEPT = [("", 1, 1, 1), ("", 2, 2, 2), ("a", 0, 0, 1), ("a", 2, 2, 2)]


def test_null_groups_and_values(spark):
    assert _null_cases(spark) == (_PACKS, _KEPT)


def test_running_sum_keeps_null_groups(spark):
    rows = spark.createDataFrame([(None, 1, 1), (None, 2, 1), ("a", 1, 1)], "g string, i long, v long")
    assert sorted((r["g"] or "", r["i"], r["s"]) for r in running_sum(rows, ["g"], ["i"], "v", "s").collect()) == [
        ("", 1, 1), ("", 2, 2), ("a", 1, 1)]


def test_running_sum_over_many_batches_of_a_null_group(spark):
    """25,000 rows of one null group, three Arrow batches; big ids next to nulls stay apart."""
    big = 2**53
    df = spark.range(25_000).selectExpr("cast(null as long) as g", "id as i", "1L as v", "id % 7 as w")
    df = df.unionByName(spark.createDataFrame([(big, 1, 1, 1), (big + 1, 1, 1, 1), (big + 1, 2, 1, None)], "g long, i long, v long, w long"))
    out = running_sum(df, ["g"], ["i"], ["v", "w"], ["s", "t"])
    assert out.where("g is null").where("s <> i + 1").count() == 0
    total = 0
    for r in sorted(out.where("g is null and i < 200").collect(), key=lambda r: r["i"]):
        total += r["w"]
        assert r["t"] == total
    assert _rows(out.where("g is not null"), "g", "i", "s", "t") == [(big, 1, 1, 1), (big + 1, 1, 1, 1), (big + 1, 2, 2, 1)]
    assert _rows(row_index(df.where("g is null").drop("w"), ["g"], ["i"], "n").where("n <> i"), "i") == []


def test_running_sum_groups_of_several_types(spark):
    import datetime

    df = spark.createDataFrame([(g, x, i, 1) for g in ([1, 2], [1], None) for x in (float("nan"), 1.0, None) for i in range(3)],
                               "g array<int>, x double, i long, v long")
    assert all(r["s"] == r["i"] + 1 for r in running_sum(df, ["g", "x"], ["i"], "v", "s").collect())
    day = spark.createDataFrame([(datetime.date(2024, 1, d), i, 0.5) for d in (1, 2) for i in range(3)], "g date, i long, v double")
    assert all(r["s"] == 0.5 * (r["i"] + 1) for r in running_sum(day, ["g"], ["i"], "v", "s").collect())
