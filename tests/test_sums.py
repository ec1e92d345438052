"""Exact sums against fsum."""

import math
import random

from aeroframe.operators import tracks


def test_sums_are_exact(spark):
    rng = random.Random(2)
    groups = {
        "cancel": [1e16, 1.0, -1e16, 3.5, 1e-3],
        "wide": [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randrange(-200, 200) for _ in range(300)],
        "tracks": [rng.uniform(0, 1000) for _ in range(2000)],
        "edges": [2.0**k for k in range(-200, 200)] + [-(2.0**k) * (1 - 2**-53) for k in range(-200, 200)],
        "huge": [1e297, -1e297, 1e290, 5e-324, 1e-300],
        "zeros": [0.0, -0.0],
        "nulls": [None, None],
        "some": [None, 2.5, -7.25],
        None: [1.5, 1e-9],
        "inf": [1.0, math.inf],
        "nan": [math.inf, -math.inf],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "track string, x double")
    for parts in (1, 7):
        got = {r.track: r.total for r in tracks.compensated_by(df.repartition(parts), ["track"], "x").collect()}
        assert got.keys() == groups.keys() and got["inf"] == math.inf and math.isnan(got["nan"])
        for k, vs in groups.items():
            if k not in ("inf", "nan"):
                want = math.fsum(v for v in vs if v is not None)
                assert math.isclose(got[k], want, rel_tol=2.3e-16, abs_tol=1e-317), (k, got[k], want)
    assert tracks.compensated_by(df.limit(0), ["track"], "x").count() == 0
