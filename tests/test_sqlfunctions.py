"""SQL functions give the rows of the operators."""

import numpy as np
import pytest

from aeroframe.functions import numeric, sqlfunctions
from aeroframe.operators import solvers


@pytest.fixture(scope="module")
def sql(spark):
    sqlfunctions.register(spark)
    return lambda text: spark.sql(text).collect()


def test_inverse(sql):
    got = sql("select id, g.distance as m, g.azimuth as a from (select id, geodesic_inverse(47e0 + id, 8e0, 48e0, if(id = 3, null, 9e0)) as g from range(5)) order by id")
    m, a = numeric.inverse(47.0 + np.arange(5), 8.0, 48.0, 9.0)
    assert got[3].m is None and got[3].a is None
    for k in (0, 1, 2, 4):
        assert got[k].m == pytest.approx(m[k], rel=1e-12) and got[k].a == pytest.approx(a[k], rel=1e-12)


def test_turn_points(sql, spark):
    got = sql("select id, seq, x, y from range(4), lateral turn_points(0e0, 0e0, 0e0, 400e0, 100e0 * id, 1e0, 30e0, 20e0) order by id, seq")
    radius = 900 / (9.80665 * np.tan(np.radians(20)))
    poses = spark.createDataFrame([(k, 0.0, 0.0, 0.0, 400.0, 100.0 * k, 1.0, float(radius)) for k in range(4)], "event_id long, x0 double, y0 double, h0 double, x1 double, y1 double, h1 double, radius double")
    want = solvers.turn_points(poses, 30.0, 20.0, 0.0).orderBy("event_id", "seq").where("seq > 0").collect()
    assert [tuple(r) for r in got] == [(r.event_id, r.seq - 1, r.x, r.y) for r in want]
    assert sql("select * from turn_points(null, 0e0, 0e0, 400e0, 1e0, 1e0, 30e0, 20e0)") == []


def test_corridor_points(sql):
    got = sql("select pass, wp, x, y from corridor_points(array(0e0, 100e0, 200e0), array(0e0, 0e0, 50e0), 40e0, 3, 10e0) order by pass, wp")
    line = np.array([[0.0, 0.0], [100.0, 0.0], [200.0, 50.0]])
    want = [(k, i, *p) for k, d in enumerate((-20.0, 0.0, 20.0)) for i, p in enumerate(solvers.resample(solvers.cut_loops(solvers.offset_polyline(line, d, 80.0)), 10.0).tolist())]
    assert [tuple(r) for r in got] == want
    for bad in ("array(0e0), array(0e0), 40e0, 3, 10e0", "array(0e0, 1e0), array(0e0, 1e0), 40e0, 2, 10e0", "array(0e0, 1e0), array(0e0, 1e0), -1e0, 3, 10e0", "array(0e0, 0e0), array(1e0, 1e0), 1e0, 3, 10e0"):
        assert sql(f"select * from corridor_points({bad})") == []


def test_corridor_arrays_have_the_rows_of_corridor_points(spark, sql):
    """Over lines of two vertices, longer ones and bad ones in one batch."""
    rows = []
    for k in range(40):
        line = [(0.0, 0.0), (100.0 + 37 * k, 13.0 * k), (250.0, 90.0 - k), (40.0, 300.0), (300.0, 20.0)][: 2 + (k % 4 if k % 3 == 0 else 0)]
        rows.append((k, [x for x, _ in line], [y for _, y in line], 30.0 + k, 1 + 2 * (k % 3), 25.0 + k))
    rows += [(90, None, [0.0, 1.0], 1.0, 1, 1.0), (91, [0.0, 1.0], [0.0, 1.0], 1.0, 2, 1.0), (92, [0.0, 0.0], [1.0, 1.0], 1.0, 3, 1.0), (93, [0.0], [1.0], 1.0, 3, 1.0), (94, [0.0, 9.0], [0.0, 9.0], None, 3, 1.0), (95, [0.0, 9.0], [0.0], 1.0, 3, 1.0), (96, [0.0, None], [0.0, 1.0], 1.0, 3, 1.0), (97, [0.0, 9.0], [0.0, 0.0], 1.0, 3, 0.0), (98, [0.0, 30.0], [0.0, 40.0], 2.0, 5, 10.0)]
    spark.createDataFrame(rows, "id int, xs array<double>, ys array<double>, width double, passes int, step double").coalesce(1).createOrReplaceTempView("corridor_rows")
    got = sql("select id, pass, wp, round(x, 9), round(y, 9) from corridor_rows lateral view inline(corridor_arrays(xs, ys, width, passes, step)) as pass, wp, x, y order by id, pass, wp")
    want = sql("select id, pass, wp, round(x, 9), round(y, 9) from corridor_rows, lateral corridor_points(xs, ys, width, passes, step) order by id, pass, wp")
    assert got == want and {r.id for r in got} == {*range(40), 98}


def test_corridors_over_a_table_are_no_call_a_row(spark):
    from aeroframe.plans.catalog import QUERIES

    plan = QUERIES["gen_05_06_09_sql_corridors"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "UDTF" not in plan
