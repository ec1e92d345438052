"""Receivers over time: epochs, alerts, silences and reconnects, by one stateful processor with timers.

State is kept per receiver. After each sentence a timer of event time is set three
seconds ahead: if it fires first, the receiver went silent; the next sentence
reconnects it, arms the timer again and starts the debounce of alerts afresh. A
second, later timer forgets a receiver that stays away, so state does not grow with
receivers that ever were. Gaps inside a micro-batch are found from the rows
themselves, so where batches are cut changes no event.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import nmea
from .telemetry import _NAMES, _START, _STATE, EPOCH, step

#: A row is one event: EPOCH with the state after it, ALERT, SILENT (at the time the silence was noticed), RECONNECTED or FORGOTTEN.
EVENT = "event string, at timestamp, " + EPOCH.replace(", alert boolean", "")
_COLUMNS = [x.split()[0] for x in EVENT.split(", ")]
_TEXTS = [x.split()[0] for x in EVENT.split(", ") if x.endswith(" string")]
_INTS = {"g_fix", "fix", "below"}


def use_rocksdb(spark: SparkSession) -> None:
    """Timers and typed state need this state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Links(StatefulProcessor):
    def __init__(self, after: int, silence_ms: int, forget_ms: int) -> None:
        self.after, self.silence_ms, self.forget_ms = after, silence_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.link = handle.getValueState("link", "last_ms long, last_seq long, silent boolean")
        self.fix = handle.getValueState("fix", _STATE)

    def _arm(self, last_ms: int) -> None:
        """Only the timers that the newest sentence sets are kept."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(last_ms + self.silence_ms)
        self.handle.registerTimer(last_ms + self.forget_ms)

    @staticmethod
    def _frame(key: tuple, rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=_COLUMNS)
        out["receiver"] = key[0]
        out["at"] = pd.to_datetime(out["at"], unit="ms")
        return out.astype(dict.fromkeys(_TEXTS, object))  # the state runner takes plain strings only

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        batch = batch.sort_values(["at", "seq"], kind="stable")
        last, last_seq, silent = self.link.get() or (None, None, False)
        state = dict(zip(_NAMES, self.fix.get() or _START, strict=True))
        out = []
        for r, now in zip(batch.to_dict("records"), batch["at_ms"].tolist(), strict=True):
            if last is not None and now - last > self.silence_ms:
                if not silent:
                    out.append({"event": "SILENT", "at": last + self.silence_ms, "seq": last_seq})
                if now - last > self.forget_ms:
                    out.append({"event": "FORGOTTEN", "at": last + self.forget_ms, "seq": last_seq})
                    state = dict(zip(_NAMES, _START, strict=True))
                out.append({"event": "RECONNECTED", "at": now, "seq": r["seq"]})
                state["below"], silent = 0, False
            if r["kind"] and (epoch := step(state, r, self.after)):
                alert = epoch.pop("alert")
                out.append({"event": "EPOCH", "at": now, **epoch})
                if alert:
                    out.append({"event": "ALERT", "at": now, **epoch})
            last, last_seq = max(now, last or now), r["seq"]
        clean = lambda v: v.item() if hasattr(v, "item") else v
        self.fix.update(tuple(None if state[n] is None else int(state[n]) if n in _INTS else clean(state[n]) for n in _NAMES))
        self.link.update((int(last), int(last_seq), bool(silent)))
        self._arm(int(last))
        yield self._frame(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        last, last_seq, silent = self.link.get() or (None, None, True)
        if last is None:
            return
        if at == last + self.silence_ms and not silent:
            self.link.update((last, last_seq, True))
            yield self._frame(key, [{"event": "SILENT", "at": at, "seq": last_seq}])
        if at == last + self.forget_ms:
            self.fix.clear()
            self.link.clear()
            yield self._frame(key, [{"event": "FORGOTTEN", "at": at, "seq": last_seq}])

    def close(self) -> None:
        pass


def link_events(sentences: DataFrame, after: int = 20, silence: float = 3.0, forget: float = 86_400.0, late: str = "2 seconds") -> DataFrame:
    """Events (``EVENT``) of a stream of (receiver, seq, at timestamp, sentence).

    ``after``: poor fixes in a row that make an alert; ``silence``, ``forget``: seconds of event time without a
    sentence of any kind; ``late``: how far the watermark stays behind. A receiver that comes back after it was
    forgotten starts without a position. A reconnect is told only of receivers that are remembered.
    """
    if not 0 < silence < forget:
        raise ValueError("a receiver is forgotten after it went silent")
    use_rocksdb(sentences.sparkSession)
    rows = nmea.fields(nmea.parsed(sentences.withWatermark("at", late))).withColumn("utc", nmea.field(1)).drop("f", "sentence")
    rows = rows.withColumn("at_ms", F.unix_millis("at"))
    processor = Links(after, int(silence * 1000), int(forget * 1000))
    return rows.groupBy("receiver").transformWithStateInPandas(statefulProcessor=processor, outputStructType=EVENT, outputMode="Append", timeMode="EventTime")
