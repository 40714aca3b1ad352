"""Folds over blocks against plain loops, with sequences that span many blocks."""

import random

import numpy as np
import pytest

from codeatlas.operators.packing import pack_batches
from codeatlas.operators.sampling import keyframes, keyframes_vector


@pytest.fixture
def blocks(spark):
    """Keep the eight ranges of small tables apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _loop(values, differs, step=1):
    kept, last = [], None
    for i, v in enumerate(values):
        if i % step == 0 and v is not None and (last is None or differs(last, v)):
            kept.append(i)
            last = v
    return kept


def _cosine(a, b):
    a, b = np.array(a), np.array(b)
    return len(a) != len(b) or (a @ b) / (np.sqrt(a @ a) * np.sqrt(b @ b)) < 0.9


@pytest.mark.parametrize("measure", ["cosine", "abs"])
def test_vectors_of_a_hot_and_small_sequences(spark, blocks, measure):
    rng = np.random.default_rng(3)
    walk = np.cumsum(rng.normal(scale=.3, size=(1500, 4)), axis=0) + 5
    seqs = {"hot": [v.tolist() for v in walk], None: [v.tolist() for v in walk[:30]], "b": [v.tolist() for v in walk[100:107]], "one": [[1.0, 2.0]]}
    for i in (0, 4, 5, 6, 900):
        seqs["hot"][i] = None
    seqs["b"][2] = seqs["b"][2][:3]
    bad = {10: [], 12: [None, 1.0, 1.0, 1.0], 14: [float("nan")] * 4, 16: [float("inf"), 0.0, 0.0, 0.0]}
    differs = _cosine if measure == "cosine" else lambda a, b: len(a) != len(b) or max(abs(x - y) for x, y in zip(a, b, strict=True)) > 2.0
    rows = [(g, i, bad.get(i, v) if g == "hot" else v) for g, vs in seqs.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g string, i long, v array<double>")
    for step in (1, 3):
        out = keyframes_vector(df, ["g"], ["i"], "v", 0.9 if measure == "cosine" else 2.0, step, measure)
        assert out.columns == ["g", "i", "v", "kept_no", "idx"]
        for g, vs in seqs.items():
            got = sorted((r["kept_no"], r["i"], r["idx"]) for r in out.collect() if r["g"] == g)
            want = _loop([None if g == "hot" and i in bad else v for i, v in enumerate(vs)], differs, step)
            assert got == [(n, i, i // step) for n, i in enumerate(want, 1)]
    assert keyframes_vector(df.where("false"), ["g"], ["i"], "v").count() == 0


def test_zero_vectors_are_frames_only_for_abs(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([[0.0, 0.0], [1.0, 0.0], [2.0, 0.0], [0.0, 3.0]])], "g string, i long, v array<double>")
    assert [r["i"] for r in keyframes_vector(df, ["g"], ["i"], "v", 0.9, 1).orderBy("i").collect()] == [1, 3]
    assert [r["i"] for r in keyframes_vector(df, ["g"], ["i"], "v", 1.5, 1, "abs").orderBy("i").collect()] == [0, 2, 3]
    with pytest.raises(ValueError):
        keyframes_vector(df, ["g"], ["i"], "v", measure="other")


def test_blocks_whose_exit_hangs_on_their_entry(spark, blocks):
    """A slow ramp: where a block is entered decides every later frame, so each round settles one more block."""
    values = [i * 0.7 for i in range(400)]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "g string, i long, v double")
    got = sorted((r["kept_no"], r["i"]) for r in keyframes(df, ["g"], ["i"], "v", 5.0, 1).collect())
    assert got == list(enumerate(_loop(values, lambda a, b: abs(a - b) > 5.0), 1))


def test_packing_over_many_blocks(spark, blocks):
    rng = random.Random(9)
    groups = {g: [rng.choice([0, 1, 7, 30, 64, 99, None]) for _ in range(n)] for g, n in (("hot", 900), (None, 40), ("c", 3), ("d", 1))}
    df = spark.createDataFrame([(g, i, s, 50 if g == "c" else 64) for g, ss in groups.items() for i, s in enumerate(ss)],
                               "g string, i long, size long, room long")
    for faithful in (False, True):
        got = {(r["g"], r["i"]): (r["idx"], r["batch_no"], r["oversize"]) for r in pack_batches(df, ["g"], ["i"], "size", "room", faithful).collect()}
        want = {}
        for g, ss in groups.items():
            room, batches, total = 50 if g == "c" else 64, [], 0
            for i, s in enumerate(x or 0 for x in ss):
                if total + s < room:
                    batches = batches or [[]]
                    batches[-1].append((i, s))
                    total += s
                else:
                    batches = (batches or ([[]] if faithful else [])) + [[(i, s)]]
                    total = 0 if faithful else s
            if faithful and len(batches[-1]) == 1 and len(ss) > 1 and total == 0 and batches[-1][0][0] == len(ss) - 1:
                batches.pop()
            want |= {(g, i): (i, n, not faithful and len(b) == 1 and s >= room) for n, b in enumerate(batches, 1) for i, s in b}
        assert got == want
