"""The range join against all pairs."""

import math
import random

import pytest

from aeroframe.operators import boxes
from aeroframe.plans.queries_io import kept

SCHEMA = "id long, min_x double, max_x double, min_y double, max_y double"


def made(rng, n, size, crowd=False):
    rows = []
    for k in range(n):
        x, y = (rng.gauss(0, 0.5), rng.gauss(0, 0.5)) if crowd and k % 2 else (rng.uniform(-50, 50), rng.uniform(-50, 50))
        x, y = (round(x), round(y)) if k % 3 == 0 else (x, y)  # ties and touching edges
        rows.append((k, float(x), float(x + rng.choice([0, 1, rng.random() * size])), float(y), float(y + rng.choice([0, 1, rng.random() * size]))))
    return [*rows, rows[0], (n, None, 1.0, 0.0, 1.0), (n + 1, float("nan"), 1.0, 0.0, 1.0), (n + 2, 5.0, -5.0, 0.0, 1.0), (n + 3, -1e300, 1e300, -1e300, 1e300)]


def brute(a, b):
    good = lambda r: all(v is not None and not math.isnan(v) for v in r[1:]) and r[1] <= r[2] and r[3] <= r[4]
    return sorted((p[0], q[0]) for p in filter(good, a) for q in filter(good, b) if p[1] <= q[2] and p[2] >= q[1] and p[3] <= q[4] and p[4] >= q[3])


@pytest.mark.parametrize(("fanout", "n"), [(2, 60), (4, 700), (64, 900)])
def test_box_join_equals_all_pairs(spark, fanout, n):
    rng = random.Random(fanout)
    a, b = made(rng, 300, 4), made(rng, n, 6, crowd=True)
    tree = boxes.pack(spark.createDataFrame(b, SCHEMA).withColumnRenamed("id", "entry").repartition(3), kept(spark), fanout)
    assert len(tree.levels) >= (3 if fanout < 64 else 1) and tree.levels[-1].count() <= fanout
    for level in tree.levels[:-1]:
        assert level.groupBy("parent").count().where(f"count > {fanout}").count() == 0
    got = boxes.box_join(spark.createDataFrame(a, SCHEMA), tree, ["id"], ["entry"])
    assert got.columns == ["id", "entry"] and sorted(map(tuple, got.collect())) == brute(a, b)


def test_empty_sides(spark):
    rows = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 1.0)], SCHEMA)
    none = boxes.pack(rows.limit(0).withColumnRenamed("id", "entry"), kept(spark))
    assert boxes.box_join(rows, none, ["id"], ["entry"]).count() == 0
    one = boxes.pack(rows.withColumnRenamed("id", "entry"), kept(spark))
    assert boxes.box_join(rows.limit(0), one, ["id"], ["entry"]).count() == 0
    assert boxes.box_join(rows.withColumnRenamed("id", "node"), one, ["node", "min_x"], ["entry", "max_y"]).collect()[0][:] == (1, 0.0, 1, 1.0)


def test_probes_do_not_travel_once_a_leaf(spark, tmp_path):
    """In a deep tree entries are joined by the node above their leaf, with the same pairs."""
    made = iter(range(100))

    def keep(df):
        at = str(tmp_path / f"t{next(made)}")
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    box = "cast(id % 37 as double) as min_x, cast(id % 37 + 3 as double) as max_x, cast(id % 23 as double) as min_y, cast(id % 23 + 2 as double) as max_y"
    areas, lines = spark.range(300).selectExpr("id as a", *box.split(", ")), spark.range(200).selectExpr("id as b", *box.split(", "))
    tree = boxes.pack(areas, keep, fanout=4)
    assert len(tree.levels) > 2
    found = boxes.box_join(lines, tree, ["b"], ["a"])
    assert "_above" in found._jdf.queryExecution().optimizedPlan().toString()
    plain = lines.alias("p").join(areas.alias("t"), boxes.meets("p", "t")).select("b", "a")
    assert sorted(found.collect()) == sorted(plain.collect())
