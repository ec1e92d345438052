"""The processor of receivers: epochs, alerts, silences, reconnects; whatever way the stream is cut."""

import pytest

from aeroframe.functions import nmea
from aeroframe.streaming import links, telemetry


def sentence(body: str) -> str:
    x = 0
    for b in body.encode():
        x ^= b
    return f"${body}*{x:02X}"


def gga(utc, fix):
    return sentence(f"GPGGA,{utc},4700.5,N,00800.5,E,{fix},09,0.9,400.5,M,47.1,M,,")


def rmc(utc):
    return sentence(f"GNRMC,{utc},A,4700.5,N,00800.5,E,10.0,90.0,010124,,")


def log():
    """(receiver, seq, milliseconds, sentence): receiver 1 goes silent twice, 2 has a poor fix, 3 ends early and stays away."""
    rows, seq = [], 0
    for k in range(40):
        ms = k * 500 + (10_000 if k >= 20 else 0) + (100_000 if k >= 30 else 0)
        rows += [(1, ms, gga(f"{k:06d}", 4)), (1, ms + 1, rmc(f"{k:06d}"))]
        rows += [(2, k * 500, gga(f"{k:06d}", 1 if k != 5 else 4)), (2, k * 500 + 1, rmc(f"{k:06d}"))]
    rows += [(2, 25_000 + k * 500, x) for k in range(300) for x in (gga(f"{k:06d}", 1), rmc(f"{k:06d}"))]
    rows += [(3, 100, rmc("000000")), (3, 200, "garbage"), (3, 2_900, "garbage"), (4, 199_000, rmc("1"))]
    rows.sort(key=lambda r: r[1])
    return [(r, k, ms, s) for k, (r, ms, s) in enumerate(rows)]


def events(spark, tmp_path, name, cuts, **options):
    rows = log()
    at = tmp_path / name
    edges = [0, *cuts, len(rows)]
    for a, b in zip(edges, edges[1:]):
        df = spark.createDataFrame(rows[a:b], "receiver long, seq long, ms long, sentence string").selectExpr("receiver", "seq", "timestamp_millis(ms + 1000000) as at", "sentence")
        df.coalesce(1).write.mode("append").parquet(str(at / "in"))
    stream = spark.readStream.schema("receiver long, seq long, at timestamp, sentence string").option("maxFilesPerTrigger", 1).parquet(str(at / "in"))
    telemetry.run_available(links.link_events(stream, **options), str(at / "out"), str(at / "checkpoint"))
    return spark.read.parquet(str(at / "out")).selectExpr("*", "unix_millis(at) - 1000000 as ms").collect()


def test_events_do_not_depend_on_the_cut(spark, tmp_path):
    one = events(spark, tmp_path, "one", [])
    key = lambda rows: sorted((r.event, r.receiver, r.seq, r.ms, r.fix, r.lat, r.paired) for r in rows if r.ms < 190_000 or r.event == "EPOCH")
    assert key(events(spark, tmp_path, "three", [31, 200])) == key(one)
    of = lambda event, receiver: sorted((r.ms, r.seq) for r in one if r.event == event and r.receiver == receiver)
    starts = [19 * 500 + 1, 29 * 500 + 10_001]
    assert [ms for ms, _ in of("SILENT", 1)][:2] == [s + 3000 for s in starts]
    assert [ms for ms, _ in of("RECONNECTED", 1)] == [20 * 500 + 10_000, 30 * 500 + 110_000]
    # receiver 3: sentences that cannot be read still show that it is there
    assert [ms for ms, _ in of("SILENT", 3)] == [5_900] and not of("RECONNECTED", 3)
    # poor fixes: 5 in a row, a good one, then 20 in a row, a silence, 20 in a row again
    alerts = of("ALERT", 2)
    assert [ms for ms, _ in alerts] == [25 * 500 + 1, 25_000 + 19 * 500]
    # epochs are those of the batch form
    rows = spark.createDataFrame([(r, k, s) for r, k, _, s in log()], "receiver long, seq long, sentence string")
    want = sorted((r.receiver, r.seq, r.lat, r.fix, r.paired) for r in nmea.epochs(rows).collect())
    assert sorted((r.receiver, r.seq, r.lat, r.fix, r.paired) for r in one if r.event == "EPOCH") == want


def test_receivers_are_forgotten(spark, tmp_path):
    got = events(spark, tmp_path, "forget", [100], forget=50.0)
    forgotten = {(r.receiver, r.ms) for r in got if r.event == "FORGOTTEN"}
    assert (3, 52_900) in forgotten and (1, 29 * 500 + 10_001 + 50_000) in forgotten
    back = next(r for r in got if r.event == "EPOCH" and r.receiver == 1 and r.ms > 110_000)
    assert back.paired and back.lat is not None


def test_bad_settings(spark):
    with pytest.raises(ValueError):
        links.link_events(spark.readStream.format("rate").load(), silence=5, forget=5)


def test_batches_of_streams_are_many_files(spark, tmp_path, monkeypatch):
    """The tables of the stream queries are dealt to tasks, however they are read: a batch is no single file."""
    from aeroframe.plans import queries_io
    from aeroframe.plans.catalog import QUERIES

    monkeypatch.setattr(queries_io, "folder", lambda spark: f"file://{tmp_path}")
    monkeypatch.setattr(queries_io.telemetry, "run_available", lambda *a, **k: (_ for _ in ()).throw(InterruptedError))
    names = "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions"
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("false", "7"), strict=True):
        spark.conf.set(n, v)
    try:
        for name in ("stm_01_stream_epochs", "stm_02_09_src_14_link_events"):
            for old in (tmp_path / "in").glob("*"):
                old.unlink()
            (tmp_path / "in").exists() and (tmp_path / "in").rmdir()
            with pytest.raises(InterruptedError):
                QUERIES[name](spark, "/root/testdata/sf0.001")
            assert len(list((tmp_path / "in").glob("*.parquet"))) > 4, name
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
