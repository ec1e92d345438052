"""NMEA 0183 sentences as columns: checksum, fields, coordinates, and epochs by window."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .constants import KNOT
from .program import fence


def xor(texts: pa.Array) -> pa.Array:
    """XOR of the bytes of each text of a batch, in one pass over its buffer; null for null."""
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    out = np.zeros(len(texts), np.int32)
    some = np.flatnonzero(at[1:] > at[:-1])
    if len(some):
        raw = np.frombuffer(data, np.uint8)[: at[-1]]
        out[some] = np.bitwise_xor.reduceat(raw, at[:-1][some])
    return pa.array(out, mask=pc.is_null(texts).to_numpy(zero_copy_only=False))


def checksum(body: Column) -> Column:
    """XOR of the bytes of a text, batch by batch (SQL has no loop over bytes that is compiled)."""
    return F.arrow_udf(xor, "int")(body)


def parsed(df: DataFrame, sentence: str = "sentence") -> DataFrame:
    """Adds valid, kind (GGA, RMC, GGK or null) and the field array ``f`` of every sentence."""
    parts = F.split(F.col(sentence), r"\*")
    body = F.substring(parts[0], F.lit(2), F.length(parts[0]))
    said = F.substring(F.rtrim(F.get(parts, F.lit(1))), 1, 2)
    good = F.col(sentence).startswith("$") & (F.size(parts) == 2) & said.rlike("^[0-9A-Fa-f]{2}$")
    df = df.withColumn("valid", F.coalesce(good & (checksum(body) == F.conv(said, 16, 10).cast("int")), F.lit(False)))
    df = df.withColumn("f", F.split(body, ","))
    head = F.col("f")[0]
    kind = F.when((head == "PTNL") & (F.get("f", F.lit(1)) == "GGK"), "GGK").when((F.length(head) >= 5) & F.substring(head, F.lit(3), F.length(head)).isin("GGA", "RMC"), F.substring(head, F.lit(3), F.length(head)))
    df = df.withColumn("kind", F.when(F.col("valid"), kind))
    # a generator between parsing and its many uses: projections are not merged across it, so a sentence is split once
    rest = [x for x in df.columns if x not in ("valid", "f", "kind")]
    return df.select(*rest, F.explode(F.array(F.struct("valid", "f", "kind"))).alias("_p")).select(*rest, "_p.valid", "_p.f", "_p.kind")


def field(i: int) -> Column:
    return F.get("f", F.lit(i))


#: What reads as a double in plain decimal notation.
_DECIMAL = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"


def number(x: Column, kind: str = "double") -> Column:
    """The text as a number, or null; only plain decimal notation counts (no names, suffixes or spaces).

    A double is cast only where it can be read: a failed cast is an exception inside, which takes longer than a sentence.
    """
    plain = x.rlike(_DECIMAL) if kind == "double" else F.translate(x, "0123456789+-.eE", "") == ""
    return F.when(plain, x.try_cast(kind))


def coordinate(value: Column, side: Column, degrees: int) -> Column:
    """ddmm.mmmm (or dddmm.mmmm) and a hemisphere letter as signed degrees, or null."""
    minutes = number(F.substring(value, F.lit(degrees + 1), F.length(value)))
    whole = number(F.substring(value, 1, degrees))
    ok = side.isin("N", "S", "E", "W") & (F.length(value) >= degrees + 2) & (minutes >= 0) & (minutes < 60)
    return F.when(ok, F.when(side.isin("S", "W"), -1.0).otherwise(1.0) * (whole + minutes / 60))


def gga() -> dict[str, Column]:
    """Fields of a GGA epoch; ``gga_ok`` (over the others) says whether it can be paired."""
    lat, lon = coordinate(field(2), field(3), 2), coordinate(field(4), field(5), 3)
    fix, alt, sep = number(field(6), "int"), number(field(9)), number(field(11))
    known = F.col("g_lat").isNotNull() & F.col("g_lon").isNotNull() & F.col("g_fix").between(0, 255) & F.col("g_alt").isNotNull() & F.col("g_sep").isNotNull()
    ok = (F.col("kind") == "GGA") & (F.size("f") >= 12) & (field(1) != "") & known
    return {"gga_ok": F.coalesce(ok, F.lit(False)), "g_lat": lat, "g_lon": lon, "g_fix": fix, "g_sats": F.coalesce(number(field(7), "int"), F.lit(0)), "g_hdop": F.coalesce(number(field(8)), F.lit(99.9)), "g_alt": alt, "g_sep": sep}


def rmc() -> dict[str, Column]:
    ok = (F.col("kind") == "RMC") & (F.size("f") >= 9) & (field(2) == "A")
    return {"rmc_ok": F.coalesce(ok, F.lit(False)), "r_speed": number(field(7)) * KNOT, "r_course": number(field(8)), "r_date": field(9)}


def ggk() -> dict[str, Column]:
    """Fields of a PTNL,GGK sentence; quality 3 reads as 4 and 2 as 5. Bad fields are null (the status column names them)."""
    q = number(field(8), "int")
    ok = (F.col("kind") == "GGK") & (F.size("f") >= 12)
    return {
        "ggk_ok": F.coalesce(ok, F.lit(False)),
        "k_lat": coordinate(field(4), field(5), 2),
        "k_lon": coordinate(field(6), field(7), 3),
        "k_fix": F.when(q == 3, 4).when(q == 2, 5).otherwise(q),
        "k_alt": number(F.regexp_replace(field(11), "^(EHT)+", "")),
    }


def fields(df: DataFrame) -> DataFrame:
    """All typed fields of parsed sentences.

    Few at a time, fenced off from each other: together they make one generated method that the JVM never compiles.
    """
    every = gga() | rmc() | ggk()
    values = [n for n in every if not n.endswith("_ok")]
    for k in range(0, len(values), 2):
        some = values[k : k + 2]
        df = fence(df.withColumns({n: every[n] for n in some}), some)
    return df.withColumns({n: v for n, v in every.items() if n.endswith("_ok")})


def epochs(df: DataFrame, receiver: str = "receiver", seq: str = "seq") -> DataFrame:
    """Completed epochs, in batch form: one row per accepted RMC or GGK, with the state after it.

    A GGA waits for the next accepted RMC; if their times agree it gives the
    position, else it is discarded. A refused RMC leaves it waiting, a GGK discards
    it. Position and motion carry on from earlier epochs of the receiver.
    """
    # dealt before parsing: plain sentences are the smallest rows there are, and the windows need no further shuffle
    rows = fields(parsed(df.repartition(receiver))).where("kind is not null")
    now = Window.partitionBy(receiver).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(receiver).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    names = ["g_lat", "g_lon", "g_alt", "g_fix", "g_sats", "g_hdop"]
    held = F.struct(F.col(seq).alias("s"), F.col("gga_ok").alias("ok"), field(1).alias("utc"), *names)
    rows = rows.withColumns(
        {
            "_gga": F.last(F.when(F.col("kind") == "GGA", held), ignorenulls=True).over(now),
            "_taken": F.max(F.when(F.col("rmc_ok") | (F.col("kind") == "GGK"), F.col(seq))).over(ahead),
        }
    )
    met = F.col("rmc_ok") & F.col("_gga.ok") & (F.col("_gga.s") > F.coalesce("_taken", F.lit(-1))) & (field(1) != "") & (F.col("_gga.utc") == field(1))
    rows = rows.withColumn("paired", F.coalesce(met, F.lit(False)))
    last = lambda x: F.last(x, ignorenulls=True).over(now)
    pick = lambda g, k: last(F.when(F.col("paired"), F.col(f"_gga.{g}")).when(F.col("ggk_ok"), F.col(k)) if k else F.when(F.col("paired"), F.col(f"_gga.{g}")))
    rows = rows.withColumns(
        {
            "lat": pick("g_lat", "k_lat"),
            "lon": pick("g_lon", "k_lon"),
            "alt": pick("g_alt", "k_alt"),
            "fix": pick("g_fix", "k_fix"),
            "hdop": F.coalesce(pick("g_hdop", None), F.lit(99.9)),
            "sats": F.coalesce(pick("g_sats", None), F.lit(0)),
            "alt_datum": last(F.when(F.col("paired"), F.lit("EGM96")).when(F.col("ggk_ok") & F.col("k_alt").isNotNull(), F.lit("WGS84_ELLIPSOIDAL"))),
            "ground_speed": F.coalesce(last(F.when(F.col("rmc_ok"), F.col("r_speed"))), F.lit(0.0)),
            "course": F.coalesce(last(F.when(F.col("rmc_ok"), F.col("r_course"))), F.lit(0.0)),
            "utc": last(F.when(F.col("rmc_ok") & (field(1) != ""), field(1))),
        }
    )
    return rows.where("rmc_ok or ggk_ok").select(receiver, seq, "kind", "utc", "lat", "lon", "alt", "alt_datum", F.coalesce("fix", F.lit(0)).alias("fix"), "sats", "hdop", "ground_speed", "course", "paired")
