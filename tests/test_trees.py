"""Trees in reading order against a recursive walk."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import trees
from millrace.operators.steps import StepError


def walk(rows, order, children=None, levels=None, more=False):
    """(id, depth, hidden) in reading order; notes of what is left out have no id."""
    own = {}
    for r in sorted(rows, key=order):
        own.setdefault(r[1], []).append(r)
    out, todo = [], [(r, 0) for r in reversed(own.get(None, []))]
    while todo:
        r, depth = todo.pop()
        if isinstance(r, int):
            out.append((None, depth, r))
            continue
        below = own.get(r[0], [])
        shown = [] if levels is not None and depth + 1 >= levels else below[:children]
        hidden = len(below) - len(shown)
        out.append((r[0], depth, hidden))
        if hidden and more:
            todo.append((hidden, depth + 1))
        todo += [(c, depth + 1) for c in reversed(shown)]
    return out


@pytest.mark.parametrize("seed", range(3))
def test_reading_order(spark, seed):
    rng = random.Random(seed)
    n = 60
    ids = rng.sample(range(1000), n)
    rows = [(i, None if k < 3 else rng.choice(ids[max(0, k - 9) : k] if seed else ids[:4]), rng.randrange(5), f"t{i}") for k, i in enumerate(ids)]
    rows += [(2000, 3000, 1, "lost"), (2001, 2000, 1, "on a lost one"), (None, ids[0], 1, "no id")]
    df = spark.createDataFrame(rows, "id long, parent long, score int, text string").repartition(4)
    good = [r for r in rows if r[0] is not None and r[0] < 2000]
    by = lambda r: (-r[2], r[0])
    got = trees.reading_order(df, [F.desc("score")]).orderBy("position").collect()
    assert [(r.id, r.depth) for r in got] == [x[:2] for x in walk(good, by)] and [r.position for r in got] == list(range(n))
    assert got[0].text == f"t{got[0].id}"
    got = trees.reading_order(df, [F.desc("score")], children=2, levels=3, more="note").orderBy("position").collect()
    want = walk(good, by, 2, 3, True)
    assert [(r.id, r.depth, r.hidden) for r in got] == want and [r.position for r in got] == list(range(len(want)))
    assert all(r.note == (f"[+{r.hidden} more]" if r.id is None else None) for r in got)
    got = trees.reading_order(df, [F.desc("score")], children=1).orderBy("position").collect()
    assert [(r.id, r.depth, r.hidden) for r in got] == walk(good, by, 1)


def test_reading_order_of_chosen_roots(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 2), (5, 1)], "id int, parent int")
    assert [(r.id, r.depth) for r in trees.reading_order(df, [], roots=F.col("id").isin(2, 5)).orderBy("position").collect()] == [(2, 0), (3, 1), (4, 1), (5, 0)]
    assert trees.reading_order(df.limit(0), []).count() == 0 and trees.reading_order(df.where("id > 2"), []).count() == 0


def test_cycles_and_equal_ids(spark):
    for rows, told in (([(1, None), (2, 3), (3, 4), (4, 2)], "ancestors"), ([(1, None), (2, 2)], "ancestors"), ([(1, None), (2, 1), (2, 1)], "id 2")):
        with pytest.raises(StepError, match=told):
            trees.reading_order(spark.createDataFrame(rows, "id int, parent int"), []).count()


def test_a_deep_chain(spark, monkeypatch):
    """A chain of 100,000 nodes takes at most 20 rounds."""
    rounds = []
    monkeypatch.setattr(trees, "materialized", lambda df, f=trees.materialized: rounds.append(1) or f(df))
    n = 100_000
    df = spark.range(n).select(((F.col("id") * 77_777) % n).alias("id"), F.when(F.col("id") > 0, ((F.col("id") - 1) * 77_777) % n).alias("parent"), F.col("id").alias("deep"))
    got = trees.reading_order(df, [])
    assert got.where("position <> deep OR depth <> deep").count() == 0 and got.count() == n
    assert len(rounds) <= 20 + 4


def test_a_bushy_tree(spark, monkeypatch):
    """A shallow tree takes as many rounds as the logarithm of its depth, twice, not of its nodes; also with a lost branch, and one of many children."""
    rounds = []
    monkeypatch.setattr(trees, "materialized", lambda df, f=trees.materialized: rounds.append(1) or f(df))
    rows = [(i, None if i < 3 else i // 7 if i < 6000 else 9 if i < 9000 else 10**6 if i == 9000 else 9000, i * 7919 % 31) for i in range(9100)]
    got = trees.reading_order(spark.createDataFrame(rows, "id long, parent long, score int").repartition(4), [F.desc("score")])
    assert len(rounds) <= 14
    want = walk([r for r in rows if r[0] < 9000], lambda r: (-r[2], r[0]))
    assert [(r.id, r.depth, r.position) for r in got.orderBy("position").collect()] == [(*x[:2], k) for k, x in enumerate(want)]
