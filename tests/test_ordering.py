"""Places in a total order against plain sorting."""

import random

from pyspark.sql import functions as F

from colloquy.operators.ordering import positions


def _plain(rows, group):
    out, seen = [], {}
    for r in sorted(rows, key=lambda r: tuple((v is not None, v) for v in r)):
        k = r[0] if group else None
        seen[k] = seen.get(k, -1) + 1
        out.append((*r, seen[k]))
    return sorted(((*r, seen[r[0] if group else None] + 1) for r in out), key=str)


def test_positions_by_group_and_of_all(spark):
    rng = random.Random(3)
    rows = [(None if i % 17 == 0 else "hot" if i % 3 == 0 else f"g{i % 5}", None if i % 29 == 0 else rng.randrange(400), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, v long, i long").repartition(7)
    for group in (["g"], []):
        order = ["v", "i"] if group else ["g", "v", "i"]
        found = positions(df, group, order, "at", "n").select("g", "v", "i", "at", "n").collect()
        assert sorted(map(tuple, found), key=str) == _plain(rows, group)


def test_positions_descending_with_ties_and_nothing(spark):
    df = spark.createDataFrame([(1, "a"), (3, "b"), (3, "b"), (2, "c")], "n long, name string")
    found = positions(df, [], [F.desc("n"), "name"]).orderBy("pos").collect()
    assert [(r["n"], r["name"], r["pos"]) for r in found] == [(3, "b", 0), (3, "b", 1), (2, "c", 2), (1, "a", 3)]
    assert positions(df.where("n > 9"), ["name"], ["n"]).count() == 0
