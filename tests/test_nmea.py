"""Sentences, epochs, and the stream against the batch."""

from functools import reduce

import pytest
from pyspark.sql import functions as F

from aeroframe.functions import nmea
from aeroframe.streaming import telemetry


def sentence(body: str, wrong: bool = False) -> str:
    code = reduce(lambda a, c: a ^ c, body.encode(), 0)
    return f"${body}*{(code + wrong) % 256:02X}"


GGA = "GPGGA,{t},4807.038096,N,01131.000098,E,4,08,0.9,545.4,M,46.9,M,,"
RMC = "GPRMC,{t},A,4807.038,N,01131.000,E,125.5,076.2,010124,,"
GGK = "PTNL,GGK,102939.00,051910,5000.97323841,N,00827.62010742,E,3,09,1.9,EHT150.790,M"
CASES = [
    (1, 1, sentence(GGA.format(t="100000"))),
    (1, 2, sentence(RMC.format(t="100000"))),
    (1, 3, sentence(GGA.format(t="100001"))),
    (1, 4, sentence(RMC.format(t="100002"))),
    (1, 5, sentence(GGK)),
    (2, 1, sentence(GGA.format(t="100000"))),
    (2, 2, sentence(RMC.format(t="100000").replace(",A,", ",V,"))),
    (2, 3, sentence(RMC.format(t="100000"))),
    (2, 4, sentence(GGA.format(t="100005"), wrong=True)),
    (2, 5, "no sentence"),
    (2, 6, ""),
    (2, 7, None),
]
SCHEMA = "receiver long, seq long, sentence string"


def test_epochs(spark):
    rows = {(r.receiver, r.seq): r for r in nmea.epochs(spark.createDataFrame(CASES, SCHEMA)).collect()}
    a = rows[1, 2]
    assert a.paired and a.lat == pytest.approx(48.1173016) and a.lon == pytest.approx(11.5166683) and a.alt == 545.4 and a.fix == 4
    assert a.ground_speed == pytest.approx(125.5 * 0.514444) and a.course == 76.2
    assert not rows[1, 4].paired and rows[1, 4].lat == a.lat  # the position carries on
    k = rows[1, 5]
    assert k.fix == 4 and k.alt == pytest.approx(150.79) and k.alt_datum == "WGS84_ELLIPSOIDAL" and k.lat == pytest.approx(50.01622064)
    assert rows[2, 3].paired  # a void RMC leaves the position waiting
    assert len(rows) == 4


@pytest.mark.parametrize(("value", "side", "ok"), [("4807.038", "N", True), ("4860.000", "N", False), ("4807.038", "X", False), ("", "N", False), ("abcd", "N", False)])
def test_coordinates(spark, value, side, ok):
    df = spark.createDataFrame([(value, side)], "v string, s string")
    assert (df.select(nmea.coordinate(df.v, df.s, 2).alias("x")).first().x is not None) == ok


def test_stream_equals_batch(spark, tmp_path):
    src = spark.createDataFrame(CASES, SCHEMA)
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    telemetry.run_available(telemetry.epochs(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    key = lambda r: (r.receiver, r.seq, r.lat, r.lon, r.alt, r.fix, r.paired)
    assert sorted(map(key, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(key, nmea.epochs(src).collect()))


def test_alert_comes_once_per_run():
    s = dict(zip(telemetry._NAMES, telemetry._START, strict=True))
    r = {"kind": "RMC", "rmc_ok": True, "utc": "1", "r_speed": 1.0, "r_course": 2.0, "seq": 0}
    alerts = [telemetry.step(s, r, 20)["alert"] for _ in range(50)]
    assert [i for i, a in enumerate(alerts) if a] == [19]


def test_replay_source(spark, tmp_path):
    log = tmp_path / "log.nmea"
    log.write_text("\n".join(x[2] for x in CASES if x[2]) + "\n")
    telemetry.register(spark)
    stream = spark.readStream.format("nmea_replay").option("path", str(log)).option("receiver", "5").load()
    q = stream.writeStream.format("memory").queryName("replayed").trigger(processingTime="0 seconds").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("replayed").count() == 10


def test_fields_are_computed_a_few_at_a_time(spark):
    """One projection of all fields is a method too long for the JVM to compile; numbers that cannot be read are not cast."""
    rows = nmea.fields(nmea.parsed(spark.createDataFrame([("$GPGGA,1,,N,,E,,,,,M,,M,,*00",)], "sentence string")))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") >= 8
    texts = ["1", "-1.5", "+.5", "2.", "1e3", "1E-2", "", ".", "E", "e5", "1e", "+-1", "1.2.3", "1 ", "1f", "NaN", None]
    got = [r.v for r in spark.createDataFrame([(x,) for x in texts], "x string").select(nmea.number(F.col("x")).alias("v")).collect()]
    assert got == [1.0, -1.5, 0.5, 2.0, 1000.0, 0.01] + [None] * 11
