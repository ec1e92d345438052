"""Solvers that are sequential within a plan, line or profile.

Each runs in numpy inside one group; groups run in parallel. A group is one plan,
corridor or profile, never a data-sized set. Coordinates are projected and
unprojected by Catalyst before and after, so the groups work in the plane.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geodesy as g
from ..functions import numeric
from ..functions.constants import PLATFORM_LIMITS
from . import terrain

TWO_PI = 2 * math.pi
GAIN = 1e-3
PASSES = 1000
FAR = 1e300

#: Rows that go out of a task in one batch, about.
_OUT_ROWS = 1 << 15


def whole_groups(df: DataFrame, by: str, order: str, run, schema: str) -> DataFrame:
    """Rows of ``run(batch, starts)`` over many whole groups at a time: group k is rows starts[k] to starts[k + 1], in order.

    A task streams its sorted rows; it holds a batch and the group that the batch ends in. What ``run`` yields is joined to larger batches.
    """

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = held[-1].column(by)[-1] if held else None
            ends = np.asarray(pc.run_end_encode(batch.column(by)).run_ends)
            cut = int(ends[-2]) if len(ends) > 1 else 0  # the last group may go on
            if held and not cut and batch.column(by)[0] != last:
                yield _joined(held)
                held = []
            if cut:
                yield _joined([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield _joined(held)

    def _joined(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        return rows, np.concatenate([[0], np.asarray(pc.run_end_encode(rows.column(by)).run_ends)]).astype(np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = [], 0
        for rows, starts in groups(batches):
            for made in run(rows, starts):
                out.append(made)
                n += made.num_rows
                if n >= _OUT_ROWS:
                    yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                    out, n = [], 0
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    return df.repartition(by).sortWithinPartitions(by, order).mapInArrow(work, schema)


# ---------------------------------------------------------------- routes


def _ends(p: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Entry and exit points of lines: row 2 i is line i forward, row 2 i + 1 reversed."""
    a, b = p[["start_lat", "start_lon"]].to_numpy(float), p[["end_lat", "end_lon"]].to_numpy(float)
    entry, leave = np.empty((2 * len(p), 2)), np.empty((2 * len(p), 2))
    entry[::2], entry[1::2], leave[::2], leave[1::2] = a, b, b, a
    return entry, leave


#: States (two a line) up to which all leg costs are held as a matrix of at most 128 MB; more are priced when asked for.
MATRIX_STATES = 4000
#: Nearest states that a move may join to, in plans without a matrix.
NEAR = 20


class Legs:
    """Costs of legs from the exit of one state to the entry of another.

    ``costs(metres, azimuths)`` prices legs (None: metres); ``least`` is the least price of a metre, so that
    least times the chord never exceeds a price. Small plans hold a matrix; in larger ones chords bound the
    prices, and only legs that may matter are solved.
    """

    def __init__(self, entry: np.ndarray, leave: np.ndarray, costs=None, least: float = 1.0, matrix: bool | None = None) -> None:
        self.entry, self.leave, self.costs, self.least = entry, leave, costs, least
        self.e, self.l = numeric.surface(*entry.T), numeric.surface(*leave.T)
        self.matrix = None
        if len(entry) <= MATRIX_STATES if matrix is None else matrix:
            self.matrix = np.empty((len(entry), len(entry)))
            for k in range(0, len(entry), 64):
                self.matrix[k : k + 64] = self._price(leave[k : k + 64, None], entry[None])
        self.near = None if self.matrix is not None else self._nearest()

    def _price(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        m, az = numeric.inverse(a[..., 0], a[..., 1], b[..., 0], b[..., 1])
        return m if self.costs is None else np.where(m < 1e-6, 0.0, self.costs(m, az))

    def _nearest(self) -> np.ndarray:
        """For each state the states whose entries are nearest to its exit, its own line aside."""
        n, k = len(self.entry), min(NEAR, len(self.entry) - 2)
        out = np.empty((n, k), np.int64)
        for at in range(0, n, 256):
            d = ((self.l[at : at + 256, None] - self.e[None]) ** 2).sum(axis=2)
            rows = np.arange(len(d))
            for own in (0, 1):
                d[rows, (at + rows) ^ own] = np.inf
            out[at : at + 256] = np.argpartition(d, k - 1, axis=1)[:, :k]
        return out

    def bound(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """At most the price of legs between states."""
        return self.matrix[a, b] if self.matrix is not None else self.least * np.sqrt(((self.l[a] - self.e[b]) ** 2).sum(axis=-1))

    def price(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.matrix[a, b] if self.matrix is not None else self._price(self.leave[a], self.entry[b])

    def cheapest(self, a: int | np.ndarray, left: np.ndarray, own: np.ndarray) -> int:
        """Of the states ``left`` (in order) the first of those that cost least with their lines, from state ``a`` or a point."""
        if np.ndim(a) == 0 and self.matrix is not None:
            return int(left[np.argmin(self.matrix[a, left] + own[left])])
        start = self.leave[a] if np.ndim(a) == 0 else a
        chord = numeric.surface(*start)
        low = self.least * np.sqrt(((chord - self.e[left]) ** 2).sum(axis=1)) + own[left]
        some = np.argpartition(low, min(16, len(low) - 1))[:17]
        best = (self._price(start[None], self.entry[left[some]]) + own[left[some]]).min()
        may = left[low <= best * (1 + 1e-9) + 1e-6]  # chords of short legs equal them but for rounding
        return int(may[np.argmin(self._price(start[None], self.entry[may]) + own[may])])


def nearest_order(home: np.ndarray, legs: Legs, own: np.ndarray) -> list[int]:
    """Greedy tour over states (2 i or 2 i + 1 for line i); the first of equals wins, forward before reversed."""
    left = np.arange(len(own))
    tour: list[int] = []
    at: int | np.ndarray = home
    while len(left):
        at = legs.cheapest(at, left, own)
        tour.append(at)
        left = left[left >> 1 != at >> 1]
    return tour


def tour_cost(tour: list[int], first: float, legs: np.ndarray, own: np.ndarray) -> float:
    """Launch leg, legs and lines, summed exactly."""
    return math.fsum([first, *legs.tolist(), *own[np.array(tour)].tolist()]) if len(tour) else 0.0


class _Sums:
    """Costs of a tour before each place, flown forward and backward, so that any stretch costs one difference.

    Legs that the wind forbids are counted beside the sums, since a cost of FAR would swallow all others.
    """

    def __init__(self, t: np.ndarray, legs: Legs, own: np.ndarray) -> None:
        self.legs, self.own = legs, own
        self.edge = legs.price(t[:-1], t[1:]) if len(t) > 1 else np.zeros(0)
        self.back = legs.price(t[1:] ^ 1, t[:-1] ^ 1) if len(t) > 1 else np.zeros(0)
        self.line, self.line_back = own[t], own[t ^ 1]
        self._add()

    def _add(self) -> None:
        sums = lambda x: (np.concatenate([[0.0], np.cumsum(np.where(x >= FAR, 0.0, x))]), np.concatenate([[0], np.cumsum(x >= FAR)]))
        self.sums = [sums(x) for x in (self.edge, self.back, self.line, self.line_back)]

    def stretch(self, i: int, j: np.ndarray, backward: bool) -> tuple[np.ndarray, np.ndarray]:
        """Finite cost and forbidden legs of places i to j."""
        (e, ef), (o, of) = self.sums[backward], self.sums[2 + backward]
        return e[j] - e[i] + o[j + 1] - o[i], ef[j] - ef[i] + of[j + 1] - of[i]

    def turn(self, i: int, j: int, t: np.ndarray) -> None:
        """After places i to j of the tour ``t`` have been turned."""
        self.edge[i:j], self.back[i:j] = self.back[i:j][::-1].copy(), self.edge[i:j][::-1].copy()
        self.line[i : j + 1], self.line_back[i : j + 1] = self.line_back[i : j + 1][::-1].copy(), self.line[i : j + 1][::-1].copy()
        for k in (i - 1, j):
            if 0 <= k < len(t) - 1:
                self.edge[k : k + 1], self.back[k : k + 1] = self.legs.price(t[k : k + 1], t[k + 1 : k + 2]), self.legs.price(t[k + 1 : k + 2] ^ 1, t[k : k + 1] ^ 1)
        self._add()


def two_opt(tour: list[int], legs: Legs, own: np.ndarray) -> list[int]:
    """Turn stretches after the first line (with each line in them) while that gains; the first leg stays.

    A move costs the same whatever its length (differences of running sums). Places are looked at again only
    when a move ended at them. With a matrix all moves are tried, so the end is a local optimum; without, those
    that join a state to one of its nearest, or turn the rest of the tour.
    """
    t = np.array(tour, np.int64)
    n = len(t)
    if n < 3:
        return t.tolist()
    sums = _Sums(t, legs, own)
    place = np.empty(n, np.int64)
    place[t >> 1] = np.arange(n)
    waiting = dict.fromkeys(range(n))  # a queue of places

    def moves(p: int) -> tuple[np.ndarray, np.ndarray]:
        """(i, j): stretches i + 1 to j that may be turned, one end of which is at place p."""
        if legs.matrix is not None:
            j, i = np.arange(p + 2, n), np.arange(0, p - 1)
            return np.concatenate([np.full(len(j), p), i]), np.concatenate([j, np.full(len(i), p)])
        a = legs.near[t[p]]  # t[p] would be followed by one of these
        b = legs.near[t[(p + 1) % n] ^ 1] ^ 1  # t[p + 1] would come after one of these
        j, i = place[a[t[place[a >> 1]] == a ^ 1] >> 1], place[b[t[place[b >> 1]] == b ^ 1] >> 1] - 1
        i, j = np.concatenate([np.full(len(j) + 1, p), i, [p - 2]]), np.concatenate([j, [n - 1], np.full(len(i), p), [p]])
        ok = (j >= i + 2) & (i >= 0)
        return i[ok], j[ok]

    def gains(i: np.ndarray, j: np.ndarray, cost) -> np.ndarray:
        last = np.minimum(j + 1, n - 1)
        inner = j + 1 < n
        join, after = cost(t[i], t[j] ^ 1), np.where(inner, cost(t[i + 1] ^ 1, t[last]), 0.0)
        leave, leave_after = sums.edge[i], np.where(inner, sums.edge[np.minimum(j, n - 2)], 0.0)
        (fwd, fwd_far), (rev, rev_far) = sums.stretch(i + 1, j, False), sums.stretch(i + 1, j, True)
        finite = lambda x: np.where(x >= FAR, 0.0, x)
        far = fwd_far - rev_far + (leave >= FAR).astype(int) + (leave_after >= FAR) - (join >= FAR) - (after >= FAR)
        return finite(leave) + finite(leave_after) + fwd - finite(join) - finite(after) - rev + 1e18 * far

    for _ in range(PASSES * n):
        if not waiting:
            break
        p = next(iter(waiting))
        i, j = moves(p)
        if legs.matrix is None and len(i):
            may = gains(i, j, legs.bound) > GAIN
            i, j = i[may], j[may]
        gain = gains(i, j, legs.price) if len(i) else np.zeros(0)
        if not len(gain) or gain.max() <= GAIN:
            del waiting[p]
            continue
        k = int(np.argmax(gain))
        a, b = int(i[k]) + 1, int(j[k])
        t[a : b + 1] = t[a : b + 1][::-1] ^ 1
        place[t[a : b + 1] >> 1] = np.arange(a, b + 1)
        sums.turn(a, b, t)
        for q in range(a - 1, b + 2) if legs.matrix is not None else (a - 1, a, b, b + 1):
            if 0 <= q < n:
                waiting.setdefault(q)
    return t.tolist()


_ROUTE = "plan_id long, visit_seq int, line_index int, reversed boolean, total_m double, in_order_m double, total_j double"


def _route(p: pd.DataFrame, costs, least: float = 1.0) -> pd.DataFrame:
    p = p.sort_values("line_index").reset_index(drop=True)
    entry, leave = _ends(p)
    home = np.array([p.get("launch_lat", p.start_lat).min(), p.get("launch_lon", p.start_lon).min()])
    line_m, line_a = numeric.inverse(entry[:, 0], entry[:, 1], leave[:, 0], leave[:, 1])
    none = np.zeros(len(entry))
    own = none if costs is None else np.where(line_m < 1e-6, 0.0, costs(line_m, line_a))
    legs = Legs(entry, leave, costs, least)
    tour = two_opt(nearest_order(home, legs, own), legs, own)

    def flown(order: list[int]) -> tuple[float, np.ndarray, float, np.ndarray]:
        """Metres and azimuths of the launch leg and the others."""
        s = np.array(order)
        m, az = numeric.inverse(leave[s[:-1], 0], leave[s[:-1], 1], entry[s[1:], 0], entry[s[1:], 1])
        (m0, az0) = numeric.inverse(home[0], home[1], entry[s[0], 0], entry[s[0], 1])
        return m0, m, az0, az

    m0, m, az0, az = flown(tour)
    straight = list(range(0, 2 * len(p), 2))
    s0, sm, _, _ = flown(straight)
    price = lambda m, a: np.where(m < 1e-6, 0.0, costs(m, a))
    return pd.DataFrame(
        {
            "plan_id": p.plan_id.iloc[0],
            "visit_seq": np.arange(len(tour)),
            "line_index": p.line_index.to_numpy()[np.array(tour) // 2],
            "reversed": np.array(tour) % 2 == 1,
            "total_m": tour_cost(tour, float(m0), m, none),
            "in_order_m": tour_cost(straight, float(s0), sm, none),
            "total_j": np.nan if costs is None else tour_cost(tour, float(price(m0, az0)), price(m, az), own),
        }
    )


def _with_launch(lines: DataFrame, launch: str) -> DataFrame:
    if launch != "min" and launch != "columns":
        raise ValueError("launch is 'min' (south-west of the line starts) or 'columns' (launch_lat, launch_lon)")
    return lines


def distance_route(lines: DataFrame, launch: str = "min") -> DataFrame:
    """Order and directions of each plan's lines: nearest neighbour, then 2-opt. The total holds the launch leg, for one line too."""
    return _with_launch(lines, launch).groupBy("plan_id").applyInPandas(lambda p: _route(p, None), _ROUTE).drop("total_j")


def energy_route(lines: DataFrame, tas: float, wind_speed: float, wind_dir: float, k1: float, k2: float, launch: str = "min") -> DataFrame:
    """The same by energy: power at airspeed times distance over ground speed, for legs and lines; what the wind forbids costs FAR."""
    power = k1 * tas**3 + k2 / tas

    def costs(metres: np.ndarray, azimuth: np.ndarray) -> np.ndarray:
        gs = numeric.ground_speed(azimuth, tas, wind_speed, wind_dir)
        return np.where(np.isnan(gs), FAR, power * metres / np.where(np.isnan(gs), 1.0, gs))

    least = power / (tas + abs(wind_speed))  # with all of the wind behind
    return _with_launch(lines, launch).groupBy("plan_id").applyInPandas(lambda p: _route(p, costs, least), _ROUTE)


def reorder(waypoints: DataFrame, route: DataFrame) -> DataFrame:
    """Waypoints in the order of a route; reversed lines run backwards and keep their other columns."""
    last = F.max("wp_index").over(Window.partitionBy("plan_id", "line_index"))
    return waypoints.join(route.select("plan_id", "line_index", "visit_seq", "reversed"), ["plan_id", "line_index"]).withColumn("new_wp", F.when(F.col("reversed"), last - F.col("wp_index")).otherwise(F.col("wp_index")))


# ---------------------------------------------------------------- turns

_WORDS = ("LSL", "RSR", "LSR", "RSL", "LRL", "RLR")


def dubins(x0, y0, h0, x1, y1, h1, r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shortest path words between poses (angles counter-clockwise from east): word number, sweeps or lengths (n, 3), total length.

    Middle value: metres of the straight for CSC words, radians of the middle arc
    for CCC. Infeasible words have infinite length; the first of equals wins.
    """
    x0, y0, h0, x1, y1, h1, r = np.broadcast_arrays(*(np.asarray(v, float) for v in (x0, y0, h0, x1, y1, h1, r)))
    mod = lambda a: np.where((m := np.mod(a, TWO_PI)) > TWO_PI - 1e-10, 0.0, m)
    centre = lambda x, y, h, a: (x - a * r * np.sin(h), y + a * r * np.cos(h))
    parts, totals = [], []
    for a, b in ((1, 1), (-1, -1), (1, -1), (-1, 1)):
        (cx, cy), (ex, ey) = centre(x0, y0, h0, a), centre(x1, y1, h1, b)
        d, phi = np.hypot(ex - cx, ey - cy), np.arctan2(ey - cy, ex - cx)
        if a == b:
            straight, heading, ok = d, np.where(d < 1e-9, h0, phi), np.ones(d.shape, bool)
        else:
            ok = d >= 2 * r
            straight = np.sqrt(np.maximum(d * d - 4 * r * r, 0))
            heading = phi + a * np.arcsin(np.minimum(2 * r / np.maximum(d, 1e-12), 1))
        p, q = mod(a * (heading - h0)), mod(b * (h1 - heading))
        parts.append(np.stack([p, straight, q], axis=-1))
        totals.append(np.where(ok, (p + q) * r + straight, np.inf))
    for a in (1, -1):
        (cx, cy), (ex, ey) = centre(x0, y0, h0, a), centre(x1, y1, h1, a)
        d, phi = np.hypot(ex - cx, ey - cy), np.arctan2(ey - cy, ex - cx)
        ok = d <= 4 * r
        found = []
        for side in (-1, 1):  # the middle circle may lie on either side of the line between the others
            ca = phi + side * a * np.arccos(np.minimum(d / (4 * r), 1))
            mx, my = cx + 2 * r * np.cos(ca), cy + 2 * r * np.sin(ca)
            t2 = np.arctan2(ey - my, ex - mx)
            ha, hb = ca + a * np.pi / 2, t2 - a * np.pi / 2
            found.append(np.stack([mod(a * (ha - h0)), mod(-a * (hb - ha)), mod(a * (h1 - hb))], axis=-1))
        turns = np.where((found[0].sum(axis=-1) <= found[1].sum(axis=-1))[..., None], *found)
        parts.append(turns)
        totals.append(np.where(ok, turns.sum(axis=-1) * r, np.inf))
    total = np.stack(totals, axis=-1)
    best = np.argmin(total, axis=-1)
    pick = np.take_along_axis(np.stack(parts, axis=-2), best[..., None, None], axis=-2)[..., 0, :]
    return best, pick, np.take_along_axis(total, best[..., None], axis=-1)[..., 0]


def dubins_paths(poses: DataFrame) -> DataFrame:
    """Adds word, its three parts and the length to rows of two poses and a radius."""
    kinds = {"word": "string", "part1": "double", "part2": "double", "part3": "double", "length_m": "double"}

    def run(frames):
        for p in frames:
            best, parts, total = dubins(p.x0, p.y0, p.h0, p.x1, p.y1, p.h1, p.radius)
            yield p.assign(word=np.array(_WORDS)[best], part1=parts[:, 0], part2=parts[:, 1], part3=parts[:, 2], length_m=total)

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in poses.schema), *(f"{n} {t}" for n, t in kinds.items())])
    return poses.mapInPandas(run, schema)


def discretise(x0: float, y0: float, h0: float, r: float, word: int, parts, clothoid: float = 0.0, step_deg: float = 5.0) -> np.ndarray:
    """Points along a path. With ``clothoid`` > 0, arcs next to a straight begin or end with curvature that grows evenly.

    Such a ramp is at most 40 % of its arc and keeps the total turn, so the arc gets
    longer by half of it; the end moves by what ``closure`` of the callers reports.
    """
    name, step = _WORDS[word], math.radians(step_deg)
    pieces: list[tuple[float, float, float, int]] = []  # length, curvature at both ends, steps
    for k, (kind, value) in enumerate(zip(name, parts, strict=True)):
        if value < 1e-12:
            continue
        if kind == "S":
            pieces.append((float(value), 0.0, 0.0, max(1, math.ceil(value / (step * r)))))
            continue
        sign, arc = (1.0 if kind == "L" else -1.0) / r, value * r
        ramp = min(clothoid, 0.4 * arc) if clothoid > 0 and name[1] == "S" and parts[1] > 1e-9 else 0.0
        full = (arc - ramp / 2, sign, sign, max(1, math.ceil((arc - ramp / 2) / (step * r))))
        slope = (ramp, 0.0, sign, max(4, math.ceil(ramp / (step * r)))) if k else (ramp, sign, 0.0, max(4, math.ceil(ramp / (step * r))))
        pieces += [full] if not ramp else [slope, full] if k else [full, slope]
    xs, ys, h = [x0], [y0], h0
    for length, c0, c1, n in pieces:
        ds = length / n
        for i in range(n):
            c = c0 + (c1 - c0) * (i + 0.5) / n
            turn = c * ds
            chord = ds if abs(turn) < 1e-12 else 2 / abs(c) * abs(math.sin(turn / 2))
            xs.append(xs[-1] + chord * math.cos(h + turn / 2))
            ys.append(ys[-1] + chord * math.sin(h + turn / 2))
            h += turn
    return np.array([xs, ys]).T


def path_length(points: np.ndarray) -> float:
    return float(np.hypot(*np.diff(points, axis=0).T).sum())


def turn_points(poses: DataFrame, speed: float, bank_deg: float, roll_rate: float) -> DataFrame:
    """Points of the turn of every pose pair; the last is set on the target, and the miss before that is reported."""
    ramp = speed * bank_deg / roll_rate if abs(roll_rate) > 1e-9 else 0.0

    def run(frames):
        for p in frames:
            out = []
            best, parts, _ = dubins(p.x0, p.y0, p.h0, p.x1, p.y1, p.h1, p.radius)
            for k, row in enumerate(p.itertuples(index=False)):
                pts = discretise(row.x0, row.y0, row.h0, row.radius, int(best[k]), parts[k], ramp)
                miss = math.hypot(pts[-1, 0] - row.x1, pts[-1, 1] - row.y1)
                pts[-1] = (row.x1, row.y1)
                out += [(row.event_id, i, x, y, miss) for i, (x, y) in enumerate(pts.tolist())]
            yield pd.DataFrame(out, columns=["event_id", "seq", "x", "y", "closure_error_m"])

    return poses.mapInPandas(run, "event_id long, seq int, x double, y double, closure_error_m double")


def _planar(df: DataFrame, by: str) -> DataFrame:
    """Adds x, y in the UTM zone of each group's mean point, zone and hemisphere; groups across the equator have none."""
    box = df.groupBy(by).agg(F.avg("lat").alias("_lat"), F.avg("lon").alias("_lon"), F.min("lat").alias("_s"), F.max("lat").alias("_n"), (F.max("lon") - F.min("lon")).alias("_span"))
    box = box.selectExpr(by, f"{g.utm_zone('_lon')} as zone0", "case when _lat < 0e0 then 'S' else 'N' end as hemi0", "not (_s < 0e0 and _n >= 0e0) and _span <= 180e0 as planar")
    placed = g.utm_forward(zone="zone0", hemisphere="hemi0").apply(df.join(box, by))
    return placed.withColumnsRenamed({"easting": "x", "northing": "y"}).drop("zone0", "hemi0", "utm_status")


def connect_lines(waypoints: DataFrame, speed: float, bank_deg: float, roll_rate: float) -> DataFrame:
    """Lines of each plan joined by turns; the next line is flown the way that makes the turn shorter.

    Rows: plan_id, leg_index, wp, lat, lon, alt, transit, line_index (of turns: the line that follows),
    closure_error_m. A plan that cannot be put in one UTM zone keeps its lines
    without turns, with status NO_TURNS.
    """
    radius = speed * speed / (9.80665 * math.tan(math.radians(bank_deg)))
    ramp = speed * bank_deg / roll_rate if abs(roll_rate) > 1e-9 else 0.0
    names = ["plan_id", "leg_index", "wp", "x", "y", "alt", "transit", "line_index", "closure_error_m", "zone", "hemisphere", "status", "lat0", "lon0"]

    def run(p: pd.DataFrame) -> pd.DataFrame:
        plan, zone, hemi, ok = p.plan_id.iloc[0], int(p.zone.iloc[0]), p.hemisphere.iloc[0], bool(p.planar.iloc[0])
        legs = [(k, q.sort_values("wp_index")) for k, q in p.groupby("line_index")]
        rows, leg = [], 0
        last = None

        def put(pts, alts, transit, line, miss, lat=None, lon=None):
            nonlocal leg
            for i, (x, y) in enumerate(pts):
                rows.append((plan, leg, i, x, y, alts[i], transit, line, miss, zone, hemi, "OK" if ok else "NO_TURNS", None if lat is None else lat[i], None if lon is None else lon[i]))
            leg += 1

        for line, q in legs:
            xy, alt, lat, lon = q[["x", "y"]].to_numpy(float), q.alt.to_numpy(float), q.lat.to_numpy(float), q.lon.to_numpy(float)
            if ok and last is not None and len(xy) >= 2:
                (px, py, ph, palt), found = last, None
                for back in (False, True):
                    pts = xy[::-1] if back else xy
                    h = math.atan2(pts[1, 1] - pts[0, 1], pts[1, 0] - pts[0, 0])
                    best, parts, _ = dubins(px, py, ph, pts[0, 0], pts[0, 1], h, radius)
                    turn = discretise(px, py, ph, radius, int(best), np.asarray(parts).reshape(3), ramp)
                    if found is None or path_length(turn) < found[0]:
                        found = (path_length(turn), back, turn, pts[0])
                _, back, turn, entry = found
                miss = math.hypot(turn[-1, 0] - entry[0], turn[-1, 1] - entry[1])
                turn[-1] = entry
                put(turn[1:].tolist(), [max(palt, float(alt[-1] if back else alt[0]))] * (len(turn) - 1), True, int(line), miss)
                if back:
                    xy, alt, lat, lon = xy[::-1], alt[::-1], lat[::-1], lon[::-1]
            put(xy.tolist(), alt.tolist(), False, int(line), 0.0, lat.tolist(), lon.tolist())
            if len(xy) >= 2:
                last = (xy[-1, 0], xy[-1, 1], math.atan2(xy[-1, 1] - xy[-2, 1], xy[-1, 0] - xy[-2, 0]), float(alt[-1]))
        return pd.DataFrame(rows, columns=names)

    schema = "plan_id long, leg_index int, wp int, x double, y double, alt double, transit boolean, line_index int, closure_error_m double, zone int, hemisphere string, status string, lat0 double, lon0 double"
    joined = _planar(waypoints, "plan_id").groupBy("plan_id").applyInPandas(run, schema)
    back = g.utm_inverse("x", "y", "zone", "hemisphere").apply(joined)
    return back.select("plan_id", "leg_index", "wp", F.coalesce("lat0", "inv_lat").alias("lat"), F.coalesce("lon0", "inv_lon").alias("lon"), "alt", "transit", "line_index", "closure_error_m", "status")


# ---------------------------------------------------------------- corridors


def offset_polyline(p: np.ndarray, d: float, limit: float) -> np.ndarray:
    """Parallel of a polyline at ``d`` to its left: mitred, or bevelled where a mitre would be longer than ``limit``."""
    if len(p) < 2 or abs(d) < 1e-10:
        return p.copy()
    step = np.diff(p, axis=0)
    size = np.hypot(step[:, 0], step[:, 1])
    normal = np.where(size[:, None] < 1e-12, 0.0, np.stack([-step[:, 1], step[:, 0]], axis=1) / np.maximum(size, 1e-12)[:, None])
    out = [p[0] + d * normal[0]]
    for v, a, b in zip(p[1:-1], normal[:-1], normal[1:], strict=True):
        both = a + b
        size2 = math.hypot(*both)
        cosine = float(both @ a) / size2 if size2 >= 1e-10 else 0.0
        if size2 < 1e-10 or (abs(cosine) >= 1e-10 and abs(d / cosine) > limit):
            out += [v + d * a, v + d * b]
        elif abs(cosine) < 1e-10:
            out.append(v + d * a)
        else:
            out.append(v + both / size2 * (d / cosine))
    return np.array([*out, p[-1] + d * normal[-1]])


class _Segments:
    """Segments of a polyline in order, on a grid of cells about as wide as they are long.

    Splicing shortens two segments and drops those between, so cells never need new entries.
    """

    def __init__(self, p: np.ndarray) -> None:
        self.n = len(p) - 1
        self.a, self.b = [tuple(x) for x in p[:-1].tolist()], [tuple(x) for x in p[1:].tolist()]
        self.after, self.before, self.alive = list(range(1, self.n + 1)), list(range(-1, self.n - 1)), bytearray(b"\1") * self.n
        size = np.hypot(*np.diff(p, axis=0).T)
        self.cell = max(float(size.mean()), float(np.abs(p).max()) * 1e-12, 1e-12)
        self.grid: dict[tuple[int, int], list[int]] = {}
        self.passed = [self.cells(k) for k in range(self.n)]
        for k, passed in enumerate(self.passed):
            for c in passed:
                self.grid.setdefault(c, []).append(k)

    def cells(self, k: int) -> list[tuple[int, int]]:
        """Cells that a segment passes, column by column, with a rim against rounding."""
        (x0, y0), (x1, y1) = sorted((self.a[k], self.b[k]))
        w, rim = self.cell, 1e-6 * self.cell
        out = []
        for cx in range(math.floor((x0 - rim) / w), math.floor((x1 + rim) / w) + 1):
            if x1 - x0 > 2 * rim:
                t0, t1 = (max(0.0, min(1.0, (x - x0) / (x1 - x0))) for x in (cx * w - rim, (cx + 1) * w + rim))
            else:
                t0, t1 = 0.0, 1.0
            ya, yb = y0 + t0 * (y1 - y0), y0 + t1 * (y1 - y0)
            out += [(cx, cy) for cy in range(math.floor((min(ya, yb) - rim) / w), math.floor((max(ya, yb) + rim) / w) + 1)]
        return out

    def crossing(self, i: int, j: int) -> float | None:
        """Where on segment i it crosses segment j, both strictly inside; None if it does not."""
        (ax, ay), (bx, by), (cx, cy), (dx, dy) = self.a[i], self.b[i], self.a[j], self.b[j]
        ux, uy, ex, ey = bx - ax, by - ay, dx - cx, dy - cy
        den = ux * ey - uy * ex
        if abs(den) < 1e-10:
            return None
        wx, wy = cx - ax, cy - ay
        t, s = (wx * ey - wy * ex) / den, (wx * uy - wy * ux) / den
        return t if 1e-9 < t < 1 - 1e-9 and 1e-9 < s < 1 - 1e-9 else None

    def near(self, k: int) -> set[int]:
        return {j for c in self.passed[k] for j in self.grid[c] if self.alive[j]}

    def first(self, i: int) -> tuple[int, float] | None:
        """The first later segment, not the next one, that segment i crosses."""
        for j in sorted(j for j in self.near(i) if j > i and j != self.after[i]):
            if (t := self.crossing(i, j)) is not None:
                return j, t
        return None

    def splice(self, i: int, j: int, t: float) -> None:
        (ax, ay), (bx, by) = self.a[i], self.b[i]
        k = self.after[i]
        while k != j:
            self.alive[k] = 0
            k = self.after[k]
        self.b[i] = self.a[j] = (ax + t * (bx - ax), ay + t * (by - ay))
        self.after[i], self.before[j] = j, i

    def earliest(self, i: int, j: int) -> int | None:
        """The first segment before i that now crosses i or j."""
        for k in sorted(k for k in self.near(i) | self.near(j) if k < i):
            if (k != self.before[i] and self.crossing(k, i) is not None) or self.crossing(k, j) is not None:
                return k
        return None


def cut_loops(p: np.ndarray) -> np.ndarray:
    """A polyline without its loops: the first crossing pair of segments is spliced, until none is left.

    One walk along the line: each segment meets only those in its cells, and after a splice the walk goes on
    from it (or from an earlier segment that crosses what is new).
    """
    if len(p) < 4:
        return np.array(p, float)
    s = _Segments(np.asarray(p, float))
    i = 0
    while i < s.n:
        hit = s.first(i)
        if hit is None:
            i = s.after[i]
            continue
        s.splice(i, *hit)
        back = s.earliest(i, hit[0])
        i = i if back is None else back
    out, i = [s.a[0]], 0
    while i < s.n:
        out.append(s.b[i])
        i = s.after[i]
    return np.array(out)


def resample(p: np.ndarray, interval: float) -> np.ndarray:
    """Points every ``interval`` along a polyline, and its last vertex (which may so come twice)."""
    if len(p) < 2:
        return p
    along = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))])
    at = np.arange(0, math.floor(along[-1] / interval + 1e-9) + 1) * interval
    return np.concatenate([np.stack([np.interp(at, along, p[:, 0]), np.interp(at, along, p[:, 1])], axis=1), p[-1:]])


def corridors(centre: DataFrame, interval: float) -> DataFrame:
    """Waypoints of corridor passes from centre lines (corridor_id, vertex, lat, lon, passes, width)."""

    def run(p: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        xy = np.stack([p.column(n).to_numpy(zero_copy_only=False).astype(float) for n in ("x", "y")], axis=1)
        head = p.take(pa.array(starts[:-1]))
        for g, (passes, width, planar) in enumerate(zip(*(head.column(n).to_pylist() for n in ("passes", "width", "planar")), strict=True)):
            line = xy[starts[g] : starts[g + 1]]
            line = line[np.concatenate([[True], np.hypot(*np.diff(line, axis=0).T) >= 1e-6])]
            if len(line) < 2 or passes not in (1, 3, 5) or not planar or width is None or not width > 0:
                continue
            for k in range(passes):
                d = 0.0 if passes == 1 else -width / 2 + k * width / (passes - 1)
                pts = resample(cut_loops(offset_polyline(line, d, 2 * width)), interval)
                same = [head.column(n).take(pa.array(np.full(len(pts), g))) for n in ("corridor_id", "zone", "hemisphere")]
                yield pa.record_batch({"corridor_id": same[0], "pass": pa.array(np.full(len(pts), k, np.int32)), "wp": pa.array(np.arange(len(pts), dtype=np.int32)), "x": pa.array(pts[:, 0]), "y": pa.array(pts[:, 1]), "zone": same[1], "hemisphere": same[2]})

    rows = _planar(centre.withColumn("corridor_id", F.col("corridor_id").cast("long")), "corridor_id")
    flown = whole_groups(rows.withColumn("zone", F.col("zone").cast("int")), "corridor_id", "vertex", run, "corridor_id long, pass int, wp int, x double, y double, zone int, hemisphere string")
    return g.utm_inverse("x", "y", "zone", "hemisphere").apply(flown).select("corridor_id", "pass", "wp", F.col("inv_lat").alias("lat"), F.col("inv_lon").alias("lon"))


# ---------------------------------------------------------------- trajectories

# Spring constants (tension, torsion, repulsion, repulsion decay, gravity).
SPRINGS = (0.1, 0.05, 5.0, 5.0, 0.5)
KINDS = ("flat", "sinusoid", "step", "sawtooth")


# Step rate, largest move in metres at which a band stands still, and steps at most; of a plan, and of the synthetic suites.
PLAN_RELAXATION, SUITE_RELAXATION = (0.3, 0.01, 500), (0.15, 0.5, 5000)


def elastic_band(terrain_m: np.ndarray, dx: float, floor: np.ndarray, rate: float = PLAN_RELAXATION[0], threshold: float = PLAN_RELAXATION[1], most: int = PLAN_RELAXATION[2]) -> tuple[np.ndarray, int, bool]:
    """Heights of a band over a floor: tension, bending, repulsion near the floor and gravity, relaxed all points at once."""
    alt, it, ok = relax(np.array([dx], float), floor, np.array([0, len(floor)]), rate, threshold, most)
    return alt, int(it[0]), bool(ok[0])


def relax(dx: np.ndarray, floor: np.ndarray, starts: np.ndarray, rate: float = PLAN_RELAXATION[0], threshold: float = PLAN_RELAXATION[1], most: int = PLAN_RELAXATION[2]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bands over many floors at once, each as it would be alone: heights, and steps and whether it stands still for each.

    Band g lies over floor[starts[g] : starts[g + 1]], its points ``dx[g]`` apart. Bands of fewer than three points
    stay where they are, without a step. Bands that stand still keep their heights and are dropped as they add up.
    """
    tension, torsion, push, decay, gravity = SPRINGS
    size = np.diff(starts)
    out, steps, still = floor.copy(), np.zeros(len(size), np.int32), np.zeros(len(size), bool)
    live = np.flatnonzero(size >= 3)
    steps[live] = most
    at = np.repeat(starts[live] - np.cumsum(size[live]) + size[live], size[live]) + np.arange(size[live].sum())
    alt = floor[at]
    done = np.zeros(len(live), bool)
    low = own = first = last = apart = None
    for it in range(1, most + 1):
        if low is None:  # at first, and after bands were dropped
            if not len(live):
                break
            low, own = floor[at], size[live]
            last = np.cumsum(own) - 1
            first, apart = last - own + 1, np.repeat(dx[live] * dx[live], own)[1:-1]
        pull = np.empty_like(alt)
        curve = alt[2:] - 2 * alt[1:-1] + alt[:-2]
        pull[1:-1] = tension * curve + 4 * torsion * curve / apart
        pull[first], pull[last] = -tension * (alt[first] - alt[first + 1]), -tension * (alt[last] - alt[last - 1])
        gap = alt - low
        near = gap < 5 * decay
        move = rate * (pull + np.where(near, push / decay * np.exp(-np.where(near, gap, 0) / decay), 0.0) - gravity)
        alt = np.maximum(alt + move, low)
        new = ~done & (np.maximum.reduceat(np.abs(move), first) < threshold)
        if new.any():
            steps[live[new]], still[live[new]] = it, True
            rows = np.repeat(new, own)
            out[at[rows]] = alt[rows]
            done |= new
            if 8 * done.sum() >= len(done):
                rows = np.repeat(~done, own)
                at, alt, live, low = at[rows], alt[rows], live[~done], None
                done = np.zeros(len(live), bool)
    rows = np.repeat(~done, size[live])
    out[at[rows]] = alt[rows]
    return out, steps, still


def profiles(spark: SparkSession, length: float = 5000.0, spacing: float = 10.0, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The synthetic terrain profiles: profile, k, x, terrain."""
    n = math.ceil(length / spacing) + 1
    rows = spark.range(n).select(F.col("id").cast("int").alias("k"), (F.col("id") * spacing).alias("x"), F.explode(F.array(*map(F.lit, kinds))).alias("profile"))
    return rows.withColumn("terrain", F.expr(terrain.synthetic_profile("profile")))


def _doubles(p: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [p.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names]


def _relaxed(p: pa.RecordBatch, starts: np.ndarray, clearance: float, rate: float, threshold: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``relax`` over the whole profiles of a batch."""
    x, h = _doubles(p, "x", "terrain")
    dx = x[np.minimum(starts[:-1] + 1, len(x) - 1)] - x[starts[:-1]]
    return relax(dx, h + clearance, starts, rate, threshold, most)


def elastic_bands(rows: DataFrame, clearance: float, rate: float = PLAN_RELAXATION[0], threshold: float = PLAN_RELAXATION[1], most: int = PLAN_RELAXATION[2]) -> DataFrame:
    """Adds alt, iterations and converged to profiles (at least three evenly spaced points each)."""

    def run(p: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        alt, steps, still = _relaxed(p, starts, clearance, rate, threshold, most)
        own = np.diff(starts)
        yield pa.record_batch({**{n: p.column(n) for n in ("k", "x", "profile", "terrain")}, "alt": pa.array(alt), "iterations": pa.array(np.repeat(steps, own)), "converged": pa.array(np.repeat(still, own))})

    return whole_groups(_profile_rows(rows), "profile", "k", run, "k int, x double, profile string, terrain double, alt double, iterations int, converged boolean")


def _profile_rows(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(F.col("profile").cast("string"), F.col("k").cast("int"), *(F.col(n).cast("double") for n in ("x", "terrain", *more)))


def basis(knots: np.ndarray, u: np.ndarray, degree: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The degree + 1 B-spline values that are not zero at each parameter, and the number of the first (Cox-de Boor)."""
    u = np.clip(u, knots[degree], knots[-degree - 1])
    n = len(knots) - degree - 1
    span = np.clip(np.searchsorted(knots, u, side="right") - 1, degree, n - 1)
    values = np.ones((len(u), 1))
    for p in range(1, degree + 1):
        new = np.zeros((len(u), p + 1))
        for j in range(p):
            left, right = knots[span + j + 1 - p], knots[span + j + 1]
            part = values[:, j] / (right - left)
            new[:, j] += (right - u) * part
            new[:, j + 1] += (u - left) * part
        values = new
    return values, span - degree


def solve_banded(values: np.ndarray, first: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solve the square system whose row i has ``values[i]`` from column ``first[i]`` on.

    Gauss without pivots, which collocation matrices of B-splines do not need; work and memory grow with the rows.
    """
    n, width = values.shape
    below, above = int(max(0, (np.arange(n) - first).max())), int(max(0, (first + width - 1 - np.arange(n)).max()))
    m = [[0.0] * (below + above + 1) for _ in range(n)]
    for i, (f, row) in enumerate(zip(first.tolist(), values.tolist(), strict=True)):
        for k, v in enumerate(row):
            if 0 <= f + k < n:
                m[i][f + k - i + below] = v
    x = right.tolist()
    dims = range(right.shape[1])
    for i in range(n):
        pivot = m[i]
        for k in range(i + 1, min(n, i + below + 1)):
            q = m[k][i - k + below] / pivot[below]
            if q:
                row, shift = m[k], i - k
                for c in range(below + 1, below + above + 1):
                    row[c + shift] -= q * pivot[c]
                for d in dims:
                    x[k][d] -= q * x[i][d]
    for i in range(n - 1, -1, -1):
        row = m[i]
        for d in dims:
            v = x[i][d]
            for c in range(1, min(above, n - 1 - i) + 1):
                v -= row[below + c] * x[i + c][d]
            x[i][d] = v / row[below]
    return np.array(x)


def lumped(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with three values around the diagonal; what lies beyond is added to the diagonal."""
    n = len(values)
    out = np.zeros((n, 3))
    column = first[:, None] + np.arange(values.shape[1]) - np.arange(n)[:, None]
    for k in range(values.shape[1]):
        inside = np.abs(column[:, k]) <= 1
        np.add.at(out, (np.arange(n), np.where(inside, column[:, k] + 1, 1)), values[:, k])
    return out, np.arange(n) - 1


class Spline:
    """A cubic B-spline curve through points: chord-length parameters, averaged knots, exact interpolation.

    With ``lump`` the system is cut to three diagonals, as quick fits do; the curve then only comes near inner points.
    """

    def __init__(self, points: np.ndarray, lump: bool = False) -> None:
        if len(points) < 4:
            raise ValueError("a cubic spline needs four points")
        chord = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(points, axis=0).T))])
        u = chord / chord[-1]
        inner = (u[1:-3] + u[2:-2] + u[3:-1]) / 3
        self.knots = np.concatenate([[0.0] * 4, inner, [1.0] * 4])
        rows = basis(self.knots, u)
        self.params = u
        self.control = solve_banded(*(lumped(*rows) if lump else rows), points)

    @classmethod
    def adaptive(cls, points: np.ndarray, threshold: float) -> Spline:
        """Through the ends and the points whose second difference is over the threshold; evenly thinned if those are too few."""
        bend = np.abs(points[2:, 1] - 2 * points[1:-1, 1] + points[:-2, 1])
        keep = np.concatenate([[True], bend > threshold, [True]])
        if keep.sum() < 4:
            pick = np.unique(np.linspace(0, len(points) - 1, max(4, len(points) // 10)).round().astype(int))
            return cls(points[pick])
        return cls(points[keep])

    def at(self, u: np.ndarray) -> np.ndarray:
        values, first = basis(self.knots, np.asarray(u, float))
        return np.einsum("ij,ijk->ik", values, self.control[first[:, None] + np.arange(values.shape[1])])

    def derivative(self, u: np.ndarray, order: int = 1, eps: float = 1e-6) -> np.ndarray:
        u = np.clip(np.asarray(u, float), eps, 1 - eps)
        if order == 1:
            return (self.at(u + eps) - self.at(u - eps)) / (2 * eps)
        e = 1e-4
        u = np.clip(u, e, 1 - e)
        return (self.at(u + e) - 2 * self.at(u) + self.at(u - e)) / (e * e)

    def curvature(self, u: np.ndarray) -> np.ndarray:
        a, b = self.derivative(u), self.derivative(u, 2)
        return np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]) / np.maximum(np.hypot(a[:, 0], a[:, 1]) ** 3, 1e-12)

    def lift(self, floor) -> int:
        """Raise control points that lie below ``floor(x)``; returns how many."""
        low = floor(self.control[:, 0])
        under = self.control[:, 1] < low
        self.control[under, 1] = low[under]
        return int(under.sum())

    def uniform(self, spacing: float, dense: int = 10_000) -> np.ndarray:
        """Points at even steps of arc length, and the end."""
        pts = self.at(np.linspace(0, 1, dense + 1))
        arc = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(pts, axis=0).T))])
        s = np.append(np.arange(0, arc[-1] - 1e-6, spacing), arc[-1])
        return np.stack([np.interp(s, arc, pts[:, 0]), np.interp(s, arc, pts[:, 1])], axis=1)


def _smoothed(p: pa.RecordBatch, starts: np.ndarray, alt: np.ndarray, spacing: float, clearance: float) -> Iterator[pa.RecordBatch]:
    """Waypoints along a lifted spline through each profile's heights ``alt``; ``below``: its control points that stay too low."""
    x, h = _doubles(p, "x", "terrain")
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        own, ground = x[a:b], h[a:b]
        floor = lambda q: np.interp(q, own, ground) + clearance  # noqa: B023, E731
        s = Spline(np.stack([own, alt[a:b]], axis=1))
        s.lift(floor)
        below = int((s.control[:, 1] < floor(s.control[:, 0]) - 1e-9).sum())
        w = s.uniform(spacing)
        names = p.column("profile").take(pa.array(np.full(len(w), a)))
        yield pa.record_batch({"profile": names, "wp": pa.array(np.arange(len(w), dtype=np.int32)), "x": pa.array(w[:, 0]), "alt": pa.array(w[:, 1]), "terrain": pa.array(np.interp(w[:, 0], own, ground)), "below": pa.array(np.full(len(w), below, np.int32))})


_WAYPOINTS = "profile string, wp int, x double, alt double, terrain double, below int"


def smooth_waypoints(bands: DataFrame, spacing: float, clearance: float) -> DataFrame:
    """Evenly spaced waypoints (profile, wp, x, alt, terrain) along a spline through each band, lifted clear of the terrain."""
    return whole_groups(_profile_rows(bands, "alt"), "profile", "k", lambda p, starts: _smoothed(p, starts, _doubles(p, "alt")[0], spacing, clearance), _WAYPOINTS).drop("below")


def band_waypoints(rows: DataFrame, spacing: float, clearance: float, rate: float = PLAN_RELAXATION[0], threshold: float = PLAN_RELAXATION[1], most: int = PLAN_RELAXATION[2]) -> DataFrame:
    """``elastic_bands`` and ``smooth_waypoints`` of profiles (profile, k, x, terrain) in one pass over whole groups.

    Profiles of fewer than four points, which have no spline, are left out. ``below``: control points of the lifted spline that are still too low.
    """

    def run(p: pa.RecordBatch, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = np.diff(starts)
        if (own < 4).any():
            p = p.filter(pa.array(np.repeat(own >= 4, own)))
            starts = np.concatenate([[0], np.cumsum(own[own >= 4])])
        if p.num_rows:
            yield from _smoothed(p, starts, _relaxed(p, starts, clearance, rate, threshold, most)[0], spacing, clearance)

    return whole_groups(_profile_rows(rows), "profile", "k", run, _WAYPOINTS)


def spline_heights(rows: DataFrame, lump: bool = False) -> DataFrame:
    """``alt`` of each point (profile, k, x, alt) on the spline through its profile; profiles of fewer than four points are left out."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("k")
        if len(p) < 4:
            return p.iloc[:0]
        s = Spline(p[["x", "alt"]].to_numpy(float), lump)
        return p.assign(alt=s.at(s.params)[:, 1])

    return rows.select("profile", "k", "x", "alt").groupBy("profile").applyInPandas(run, "profile string, k int, x double, alt double")


def spline_reports(bands: DataFrame, clearance: float, threshold: float = 0.05) -> DataFrame:
    """Per profile: control points of the full and of the adaptive fit, largest curvature, control points lifted, and how many stay too low."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("k")
        x, h = p.x.to_numpy(float), p.terrain.to_numpy(float)
        points = np.stack([x, p.alt.to_numpy(float)], axis=1)
        full, thin = Spline(points), Spline.adaptive(points, threshold)
        floor = lambda q: np.interp(q, x, h) + clearance
        lifted = full.lift(floor)
        low = int((full.control[:, 1] < floor(full.control[:, 0]) - 1e-9).sum())
        return pd.DataFrame({"profile": [p.profile.iloc[0]], "control_points": len(full.control), "adaptive_points": len(thin.control), "max_curvature": [float(full.curvature(np.linspace(0, 1, 1001)).max())], "lifted": lifted, "too_low": low})

    return bands.groupBy("profile").applyInPandas(run, "profile string, control_points int, adaptive_points int, max_curvature double, lifted int, too_low int")


# Amplitudes and wavelengths of the sinusoid sweep.
SWEEP = ((10.0, 5000.0), (20.0, 2000.0), (30.0, 1000.0), (50.0, 500.0), (80.0, 300.0), (120.0, 200.0))


def sweep_metrics(spark: SparkSession, clearance: float, platform: str = "fixed_wing") -> DataFrame:
    """Metrics and verdicts of the synthetic suite and the sinusoid sweep, profile by profile."""
    speed, pitch, accel = PLATFORM_LIMITS[platform][:3]
    slope, curve = math.tan(math.radians(pitch)), accel * 9.81 / speed**2
    waves = spark.createDataFrame([(f"sweep_{int(a)}_{int(w)}", a, w) for a, w in SWEEP], "profile string, amplitude double, wavelength double")
    x = spark.range(501).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10.0).alias("x"))
    swept = x.crossJoin(F.broadcast(waves)).select("k", "x", "profile", (500 + F.col("amplitude") * F.sin(2 * math.pi * F.col("x") / F.col("wavelength"))).alias("terrain"))
    flown = smooth_waypoints(elastic_bands(profiles(spark).unionByName(swept), clearance, *SUITE_RELAXATION), 20.0, clearance)
    m = terrain.profile_metrics(flown, ["profile"], clearance)
    verdict = F.when(F.col("min_clearance_margin") < -3, "CLEARANCE").when(F.col("max_slope") > 3 * slope, "SLOPE").when(F.col("max_curvature") > 5 * curve, "CURVATURE").otherwise("PASSED")
    return m.withColumn("verdict", verdict)
