"""Blocked scans and range numbering against plain Python, with one key holding most rows."""

import random

from pyspark.sql import functions as F

from workgraph.operators import intervals, scan


def lines(frame, seed=0):
    rng = random.Random(seed)
    data = [("hot", i, rng.choice([None, i])) for i in range(500)] + [("cold", i, None) for i in range(3)]
    return data, frame(data, "k string, pos int, v int")


def test_carry_forward_across_blocks(frame):
    data, df = lines(frame)
    for inclusive in (True, False):
        got = {(r.k, r.pos): r.seen for r in scan.carry_forward(df, ["k"], "pos", F.col("v"), "seen", inclusive=inclusive, block=16).collect()}
        last = {}
        for k, pos, v in data:
            before = last.get(k)
            if v is not None:
                last[k] = v
            assert got[k, pos] == (last.get(k) if inclusive else before)


def test_running_total_across_blocks(frame):
    data, df = lines(frame, 1)
    got = {(r.k, r.pos): r.total for r in scan.running_total(df, ["k"], "pos", F.col("v").isNotNull().cast("int"), "total", block=16).collect()}
    total = {}
    for k, pos, v in data:
        total[k] = total.get(k, 0) + (v is not None)
        assert got[k, pos] == total[k]


def test_ranked_numbers_a_hot_key(frame):
    rng = random.Random(2)
    data = [("hot", rng.random(), i) for i in range(2000)] + [(f"k{i}", rng.random(), i) for i in range(50)]
    out = scan.ranked(frame(data, "k string, x double, i int"), ["k"], [F.col("x"), F.col("i")], "place").collect()
    for key in {k for k, _, _ in data}:
        mine = sorted((r.x, r.i, r.place) for r in out if r.k == key)
        assert [m[2] for m in mine] == list(range(1, len(mine) + 1))


def test_overlaps_equals_nested_loop(frame):
    rng = random.Random(3)
    make = lambda n: [(rng.choice("pq"), i, s := rng.randrange(400), s + rng.randrange(150)) for i in range(n)]
    a, b = make(60), make(60)
    got = {(r.i, r.j) for r in intervals.overlaps(frame(a, "p string, i int, s int, e int"), frame(b, "p string, j int, s2 int, e2 int"),
                                                  ["p"], ("s", "e"), ("s2", "e2")).collect()}
    assert got == {(i, j) for p, i, s, e in a for q, j, s2, e2 in b if p == q and s <= e2 and s2 <= e}


def test_salted_join_is_the_plain_join(frame):
    left = frame([("hot", i) for i in range(300)] + [("a", 1000), ("none", 1001)], "k string, l int")
    right = frame([("hot", i) for i in range(3)] + [("a", 9)], "k string, r int")
    got = sorted(map(tuple, intervals.salted_join(left, right, ["k"], hot_rows=20).collect()))
    assert got == sorted(map(tuple, left.join(right, "k").collect()))
