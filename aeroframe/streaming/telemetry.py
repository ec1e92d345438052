"""Receiver streams: sentences to epochs with alerts, mock telemetry, progress, replay.

State is kept per receiver. Rows of a micro-batch are put in order of their ingest
number before they meet the state, since a shuffle does not keep order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import nmea
from ..sources import files

EPOCH = "receiver long, seq long, kind string, utc string, lat double, lon double, alt double, alt_datum string, fix int, ground_speed double, course double, paired boolean, alert boolean"
_STATE = "utc string, g_lat double, g_lon double, g_alt double, g_fix int, pending boolean, lat double, lon double, alt double, alt_datum string, fix int, ground_speed double, course double, last_utc string, below int"
_NAMES = [x.split()[0] for x in _STATE.split(", ")]
_START = (None, None, None, None, None, False, None, None, None, None, 0, 0.0, 0.0, None, 0)


def _value(x):
    return None if x is None or x != x else x


def step(s: dict, r: dict, after: int) -> dict | None:
    """Advance a receiver's state by one parsed sentence; the epoch it completes, if any."""
    kind = r["kind"]
    if kind == "GGA":
        s["pending"] = bool(r["gga_ok"])
        s["utc"], s["g_lat"], s["g_lon"], s["g_alt"], s["g_fix"] = r["utc"], _value(r["g_lat"]), _value(r["g_lon"]), _value(r["g_alt"]), _value(r["g_fix"])
        return None
    paired = False
    if kind == "GGK":
        s["pending"] = False
        if not r["ggk_ok"]:
            return None
        for name in ("lat", "lon", "alt", "fix"):
            if (v := _value(r[f"k_{name}"])) is not None:
                s[name] = v
                if name == "alt":
                    s["alt_datum"] = "WGS84_ELLIPSOIDAL"
    else:
        if not r["rmc_ok"]:
            return None
        for name, field in (("ground_speed", "r_speed"), ("course", "r_course")):
            if (v := _value(r[field])) is not None:
                s[name] = v
        if r["utc"]:
            s["last_utc"] = r["utc"]
        paired = bool(s["pending"] and r["utc"] and s["utc"] == r["utc"])
        s["pending"] = False
        if paired:
            s["lat"], s["lon"], s["alt"], s["fix"], s["alt_datum"] = s["g_lat"], s["g_lon"], s["g_alt"], s["g_fix"], "EGM96"
    s["below"] = s["below"] + 1 if s["fix"] < 4 else 0
    return {"seq": r["seq"], "kind": kind, "utc": s["last_utc"], "lat": s["lat"], "lon": s["lon"], "alt": s["alt"], "alt_datum": s["alt_datum"], "fix": int(s["fix"]), "ground_speed": s["ground_speed"], "course": s["course"], "paired": paired, "alert": s["below"] == after}


def epochs(sentences: DataFrame, after: int = 20) -> DataFrame:
    """Completed epochs of a stream of (receiver, seq, sentence), with an alert when the fix was poor ``after`` times running."""
    rows = nmea.fields(nmea.parsed(sentences)).where("kind is not null").withColumn("utc", nmea.field(1)).drop("f", "sentence")

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = dict(zip(_NAMES, state.get if state.exists else _START, strict=True))
        batch = pd.concat(list(frames)).sort_values("seq")
        out = [e for r in batch.to_dict("records") if (e := step(s, r, after))]
        clean = lambda v: v.item() if hasattr(v, "item") else v
        ints = {"g_fix", "fix", "below"}
        state.update(tuple(None if s[n] is None else int(s[n]) if n in ints else clean(s[n]) for n in _NAMES))
        frame = pd.DataFrame(out, columns=[x.split()[0] for x in EPOCH.split(", ")])
        frame["receiver"] = key[0]
        yield frame

    return rows.groupBy("receiver").applyInPandasWithState(run, EPOCH, _STATE, "append", GroupStateTimeout.NoTimeout)


def silent_receivers(epochs_seen: DataFrame, seconds: float = 3.0) -> DataFrame:
    """A row for every receiver that sent nothing for ``seconds`` of processing time; it reports again after it spoke."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"receiver": [key[0]], "last_seq": [last]})
            return
        state.update((int(max(f.seq.max() for f in frames)),))
        state.setTimeoutDuration(int(seconds * 1000))

    return epochs_seen.groupBy("receiver").applyInPandasWithState(run, "receiver long, last_seq long", "last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def mock_telemetry(ticks: DataFrame, waypoints: DataFrame, speed: float = 10.0) -> DataFrame:
    """A waypoint for each tick (a ``rate`` stream), over and over. ``waypoints`` has n (from 0), n_all and telemetry columns."""
    total = F.max("n_all")
    size = waypoints.agg(total.alias("_size"))
    placed = ticks.join(F.broadcast(size), F.lit(True)).withColumn("n", F.col("value") % F.col("_size"))  # one row
    return placed.join(waypoints.drop("n_all"), "n").withColumns({"ground_speed": F.lit(speed), "fix": F.lit(4), "hdop": F.lit(0.9), "sats": F.lit(12)}).drop("_size")


def line_progress(telemetry: DataFrame) -> DataFrame:
    """Per plan and line, the furthest share flown so far (update mode)."""
    pct = F.when(F.col("n_wp") <= 1, 100.0).otherwise(100.0 * F.col("wp_index") / (F.col("n_wp") - 1))
    return telemetry.groupBy("plan_id", "line_index").agg(F.max(pct).alias("completion_pct"))


#: Triggers after which the progress log is folded into a snapshot.
SNAPSHOT_EVERY = 12
_PROGRESS = "plan_id long, line_index int, completion_pct double, batch long"


class ProgressStore:
    """Progress of lines as a snapshot and the logs after it, in a folder that driver and executors share.

    A small file ``pointer-<batch>`` names the last batch that a whole snapshot holds; readers take the newest
    pointer, its snapshot, and later logs. Logs, snapshots and pointers that a newer pointer replaces are removed
    after it is in place, so there are never more than a few dozen folders, and a reader or a restart at any
    moment finds everything. A batch that runs again after a failure writes its own folder again.
    """

    def __init__(self, spark: SparkSession, folder: str, every: int = SNAPSHOT_EVERY) -> None:
        self.spark, self.every = spark, every
        self.fs, self.base = files.filesystem(folder)
        self.folder = folder.rstrip("/")

    def _found(self, kind: str) -> list[int]:
        """Batches for which there is a whole folder of this kind (or a pointer)."""
        from pyarrow import fs

        names = [i.base_name for i in self.fs.get_file_info(fs.FileSelector(self.base, allow_not_found=True))]
        batches = sorted(int(n.rpartition("-")[2]) for n in names if n.startswith(kind + "-"))
        if kind == "pointer":
            return batches
        whole = lambda k: self.fs.get_file_info(f"{self.base}/{kind}-{k:09d}/_SUCCESS").is_file
        return [k for k in batches if whole(k)]

    def _at(self, kind: str, batch: int) -> str:
        return f"{self.folder}/{kind}-{batch:09d}"

    def read(self) -> DataFrame:
        """plan_id, line_index and completion_pct as last saved; later batches win."""
        pointer = max(self._found("pointer"), default=-1)
        places = [self._at("log", k) for k in self._found("log") if k > pointer] + ([self._at("snapshot", pointer)] if pointer >= 0 else [])
        rows = self.spark.read.schema(_PROGRESS).parquet(*places) if places else self.spark.createDataFrame([], _PROGRESS)
        return rows.groupBy("plan_id", "line_index").agg(F.max_by("completion_pct", "batch").alias("completion_pct"), F.max("batch").alias("batch"))

    def save(self, changed: DataFrame, batch: int) -> None:
        if batch <= max(self._found("pointer"), default=-1):
            return  # it ran before, and its snapshot is in place
        changed.withColumn("batch", F.lit(batch).cast("long")).select("plan_id", "line_index", "completion_pct", "batch").write.mode("overwrite").parquet(self._at("log", batch))
        if batch % self.every == self.every - 1:
            self.read().write.mode("overwrite").parquet(self._at("snapshot", batch))
            with self.fs.open_output_stream(f"{self.base}/pointer-{batch:09d}") as out:
                out.write(b"whole")
            self._clear(batch)

    def _clear(self, pointer: int) -> None:
        from pyarrow import fs

        for i in self.fs.get_file_info(fs.FileSelector(self.base)):
            kind, _, number = i.base_name.rpartition("-")
            if kind in ("log", "snapshot", "pointer") and int(number) < pointer + (kind == "log"):
                (self.fs.delete_dir if i.type == fs.FileType.Directory else self.fs.delete_file)(i.path)


def saved_progress(spark: SparkSession, folder: str) -> DataFrame:
    """plan_id, line_index and completion_pct as last saved in ``folder``."""
    return ProgressStore(spark, folder).read().drop("batch")


def persist_progress(progress: DataFrame, folder: str, checkpoint: str, every: str | None = "5 seconds", snapshot_every: int = SNAPSHOT_EVERY):
    """Save each trigger's changed lines in ``folder`` (see ``ProgressStore``). ``every`` None: one run over what is there."""
    store = ProgressStore(progress.sparkSession, folder, snapshot_every)
    q = progress.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(store.save)
    return (q.trigger(processingTime=every) if every else q.trigger(availableNow=True)).start()


def messages(telemetry: DataFrame, kind: str = "TELEMETRY") -> DataFrame:
    """Tagged JSON messages of a stream or a table of payloads."""
    return telemetry.select(F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(*telemetry.columns).alias("payload"))).alias("value"))


def warnings(alerts: DataFrame) -> DataFrame:
    """Payloads of warnings: receivers whose fix was poor for too long."""
    return alerts.selectExpr("receiver", "seq", "'RTK_DEGRADATION' as code", "concat('fix quality ', cast(fix as string)) as detail")


def run_available(stream: DataFrame, out: str, checkpoint: str, settle: bool = True) -> None:
    """Run an append stream over what is there now, into Parquet. Without ``settle``, timers that are due wait for the next run's batch."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, str(settle and before == "true").lower())
    try:
        q = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", checkpoint).option("path", out).start()
        q.awaitTermination()
    finally:
        conf.set(name, before)


class _Replay(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.receiver, self.rows = options["path"], int(options.get("receiver", "0")), int(options.get("rowsPerBatch", "1000"))

    def initialOffset(self) -> dict:
        return {"line": 0, "byte": 0}

    def _read(self, start: dict, lines: int) -> tuple[list[tuple], dict]:
        """Whole lines from a place in the log (found by its byte, not by reading up to it) and the place after them."""
        out, at = [], start["byte"]
        with open(self.path, "rb") as f:
            f.seek(at)
            while len(out) < lines and (x := f.readline()):
                if not x.endswith(b"\n") and f.read(1):
                    break
                out.append((self.receiver, start["line"] + len(out), x.decode("ascii", "replace").rstrip("\r\n")))
                at += len(x)
        return out, {"line": start["line"] + len(out), "byte": at}

    def read(self, start: dict):
        rows, end = self._read(start, self.rows)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self._read(start, end["line"] - start["line"])[0])


class NmeaReplay(DataSource):
    """``spark.readStream.format("nmea_replay")``: a recorded log, line by line, as (receiver, seq, sentence)."""

    @classmethod
    def name(cls) -> str:
        return "nmea_replay"

    def schema(self) -> str:
        return "receiver long, seq long, sentence string"

    def simpleStreamReader(self, schema):
        return _Replay(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NmeaReplay)
