"""Repair of conversation structure by weighted finite-state composition.

Three machines are composed:

* the input acceptor: a conversation's rows in order, each a symbol of its role and fault;
* the edit transducer: Keep, Rerole (1), Delete (2), Insert (5), where blank and duplicate
  rows can only be deleted and truncated rows that stay cost 5 more;
* the grammar acceptor of role initials, ``(s?(ua)+)?``.

Transducer and grammar are composed lazily: the arcs of a (symbol, grammar state) pair are
made when the pair is first met. The composition with the input is acyclic, so its best
path needs one pass in reverse topological order over weights (cost, label string), which
are compared lexicographically. All arcs that leave a state have different labels, none of
which begins another, so comparing (cost to the end, label) at each state is comparing
whole strings, and no string is carried along.

All conversations of a batch step through their composition at once, as arrays. Long ones
are cut into segments of SEGMENT rows which step in parallel too: a segment's (min, +)
matrix from entry to exit states is combined with those after it.

Order within a conversation: by turn (nulls first), then role, then a digest of the row;
rows equal in all three are interchangeable. A null role or text is one space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
ROLES = {"u": "user", "a": "assistant"}

#: Grammar states: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
GRAMMAR = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
FINAL = (START, ASSISTANT)

#: A row's symbol is 4 times the place of its initial here (3: any other) and its fault.
INITIALS = "sua"
CLEAN, BLANK, DUPLICATE, TRUNCATED = range(4)

#: Rows of a segment.
SEGMENT = 4096
_FAR = 1 << 40


# ---------------------------------------------------------------- the machines


def edits(symbol: int) -> Iterator[tuple[str, str, int]]:
    """The edit transducer's arcs that read a symbol: (label, initial written or empty, cost)."""
    initial, fault = (*INITIALS, "")[symbol >> 2], symbol & 3
    yield DELETE, "", COSTS[DELETE]
    if fault in (BLANK, DUPLICATE):
        return
    more = TRUNCATED_COST if fault == TRUNCATED else 0
    if initial:
        yield KEEP, initial, COSTS[KEEP] + more
    for written in ROLES:
        yield REROLE, written, COSTS[REROLE] + more


def inserted(state: int) -> Iterator[tuple[str, int, int]]:
    """(labels, cost, state) of inserting rows from a grammar state on. More than two in a row come back to a state they passed, at a cost."""
    ways = [("", 0, state)]
    for _ in range(3):
        yield from ways
        ways = [(labels + INSERT, cost + COSTS[INSERT], to) for labels, cost, at in ways for written, to in GRAMMAR[at].items() if written in ROLES]


@cache
def arcs(symbol: int, state: int) -> dict[str, tuple[int, int]]:
    """Composed arcs that read a symbol in a grammar state: label (inserts first) to (cost, next state). One next state a label."""
    out: dict[str, tuple[int, int]] = {}
    for before, spent, at in inserted(state):
        for label, written, cost in edits(symbol):
            to = at if not written else GRAMMAR[at].get(written)
            if to is not None:
                assert before + label not in out or out[before + label][1] == to
                best = min(spent + cost, out.get(before + label, (_FAR, to))[0])
                out[before + label] = (best, to)
    return out


@cache
def endings(state: int) -> tuple[int, str]:
    """The cheapest way to end: (cost, labels)."""
    return min((cost, labels) for labels, cost, to in inserted(state) if to in FINAL)


LABELS = sorted(k * INSERT + x for k in range(3) for x in (KEEP, REROLE, DELETE))


class _Lazy:
    """Composed arcs as arrays by (symbol, state, label place), filled when a symbol is first met."""

    def __init__(self) -> None:
        self.cost = np.full((16, 4, len(LABELS)), _FAR, np.int64)
        self.to = np.zeros((16, 4, len(LABELS)), np.int64)
        self.known: set[int] = set()

    def meet(self, symbols: np.ndarray) -> None:
        for symbol in set(np.unique(symbols).tolist()) - self.known:
            for state in range(4):
                for label, (cost, to) in arcs(symbol, state).items():
                    self.cost[symbol, state, LABELS.index(label)], self.to[symbol, state, LABELS.index(label)] = cost, to
            self.known.add(symbol)


_lazy = _Lazy()


# ---------------------------------------------------------------- shortest paths of many conversations at once


def _stack(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol sequences, longest first, as one padded array; their order and lengths."""
    lengths = np.array([len(p) for p in parts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    grid = np.zeros((len(parts), int(lengths.max(initial=0))), np.uint8)
    for row, k in enumerate(order):
        grid[row, : lengths[k]] = parts[k]
    return grid, order, lengths[order]


def _matrices(grid: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per row of the grid the least cost from each entry state to each exit state."""
    best = np.full((len(grid), 4, 4), _FAR, np.int64)
    best[:, range(4), range(4)] = 0
    for t in range(grid.shape[1] - 1, -1, -1):
        n = int(np.searchsorted(-lengths, -t, side="left"))  # rows longer than t
        s = grid[:n, t]
        onward = best[np.arange(n)[:, None, None], _lazy.to[s]]  # n, state, label, exit
        best[:n] = np.minimum((_lazy.cost[s][..., None] + onward).min(axis=2), _FAR)
    return best


def _choices(grid: np.ndarray, lengths: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best label of each row and state, given the costs from each exit state on; and the costs from each entry state."""
    best = ahead.copy()
    chosen = np.zeros((*grid.shape, 4), np.uint8)
    place = np.arange(len(LABELS))
    for t in range(grid.shape[1] - 1, -1, -1):
        n = int(np.searchsorted(-lengths, -t, side="left"))
        s = grid[:n, t]
        weight = (_lazy.cost[s] + best[np.arange(n)[:, None, None], _lazy.to[s]]) * 16 + place  # the label decides between equal costs
        least = weight.min(axis=2)
        chosen[:n, t], best[:n] = least & 15, least >> 4
    return chosen, best


def _paths(grid: np.ndarray, lengths: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label places from each entry state, and the exit state of each."""
    at = np.tile(np.arange(4), (len(grid), 1))
    taken = np.zeros((*grid.shape, 4), np.uint8)
    for t in range(grid.shape[1]):
        n = int(np.searchsorted(-lengths, -t, side="left"))
        taken[:n, t] = np.take_along_axis(chosen[:n, t], at[:n], axis=1)
        at[:n] = _lazy.to[grid[:n, t][:, None], at[:n], taken[:n, t]]
    return taken, at


def shortest_edits(conversations: list[np.ndarray], segment: int = SEGMENT) -> list[tuple[int, np.ndarray, str]]:
    """Per sequence of symbols: cost, the place in LABELS of each row's label, and the labels that end it."""
    parts, first = [], [0]
    for symbols in conversations:
        parts += [symbols[k : k + segment] for k in range(0, len(symbols), segment)]
        first.append(len(parts))
    finish = np.array([endings(g)[0] for g in range(4)], np.int64)
    grid, order, lengths = _stack(parts)
    _lazy.meet(grid)
    ahead = np.tile(finish, (len(parts), 1))
    row = np.empty(len(parts), np.int64)
    row[order] = np.arange(len(parts))
    if len(split := np.flatnonzero(np.diff(first) > 1)):
        mine = np.concatenate([np.arange(first[k] + 1, first[k + 1]) for k in split])  # costs from here on serve the segment before
        rows = np.sort(row[mine])
        matrix = np.empty((len(parts), 4, 4), np.int64)
        matrix[rows] = _matrices(grid[rows], lengths[rows])
        for k in split:
            for j in range(first[k + 1] - 1, first[k], -1):
                ahead[row[j - 1]] = (matrix[row[j]] + ahead[row[j]]).min(axis=1)
    chosen, best = _choices(grid, lengths, ahead)
    taken, exits = _paths(grid, lengths, chosen)
    out = []
    for k, symbols in enumerate(conversations):
        state, cost, labels = START, 0, []
        for j in range(first[k], first[k + 1]):
            if j == first[k]:
                cost = int(best[row[j], START])
            labels.append(taken[row[j], : lengths[row[j]], state])
            state = int(exits[row[j], state])
        spent, end = endings(state)
        out.append((cost if len(symbols) else spent, np.concatenate(labels) if labels else np.zeros(0, np.uint8), end))
    return out


# ---------------------------------------------------------------- rows in, repaired rows out


def _typed(conversations: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    role = F.coalesce(F.col("role").cast("string"), F.lit(" "))
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"))


def _merged(conversations: DataFrame, every: DataFrame | None) -> DataFrame:
    """All that a task needs of a conversation, in one shuffle: first a short row for each row, then the rows with their texts.

    ``late`` marks rows whose role and text stand at an earlier turn; that is found by a least
    turn for each digest, aggregated before it is shuffled.
    """
    rows = _typed(conversations).withColumns({"known": F.col("turn").isNotNull(), "digest": F.md5(F.concat_ws(":", F.length("role"), "role", "text"))})
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    short = rows.select(
        "conv_id", "known", "turn", "role", "digest",
        F.when(last == "", BLANK).when(last.isin(".", "!", "?"), CLEAN).otherwise(TRUNCATED).alias("fault"),
    )
    early = short.groupBy("conv_id", "digest").agg(F.min(F.struct("known", "turn")).alias("early"))
    early = early.select(F.col("conv_id").alias("in_conv"), F.col("digest").alias("of"), "early")
    same = short.conv_id.eqNullSafe(early.in_conv) & (short.digest == early.of)
    short = short.join(early, same).withColumn("late", ~F.struct("known", "turn").eqNullSafe(F.col("early")))
    columns = ["conv_id", "kind", "known", "turn", "role", "digest", "fault", "late", "text"]
    everything = short.withColumns({"kind": F.lit(1), "text": F.lit(None).cast("string")}).select(*columns)
    everything = everything.union(rows.withColumns({"kind": F.lit(2), "fault": F.lit(0), "late": F.lit(False)}).select(*columns))
    if every is not None:
        ids = every.select(F.col("conv_id").cast("long")).distinct()
        none = {"kind": F.lit(0), "known": F.lit(False), "turn": F.lit(None).cast("long"), "role": F.lit(""), "digest": F.lit(""), "fault": F.lit(0), "late": F.lit(False), "text": F.lit(None).cast("string")}
        everything = everything.union(ids.withColumns(none).select(*columns))
    dealt = everything.repartition(c.parallelism(conversations.sparkSession), "conv_id")
    return dealt.sortWithinPartitions("conv_id", "kind", "known", "turn", "role", "digest").drop("known")


class _Symbols:
    """What the short rows of one conversation add up to, however many batches they come in."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []
        self.turns = self.low = self.high = 0
        self.last = None

    def add(self, turn: np.ndarray, null: np.ndarray, role: list[str], digest: list[str], fault: np.ndarray, late: np.ndarray) -> None:
        places = np.array([INITIALS.find(r[:1]) if r else -1 for r in role], np.int64)
        again = np.zeros(len(role), bool)
        for k in range(len(role)):
            key = (None if null[k] else int(turn[k]), digest[k])
            again[k] = key == self.last
            if key[0] is not None and (not self.turns or key[0] != self.high):
                self.low = key[0] if not self.turns else self.low
                self.high, self.turns = key[0], self.turns + 1
            self.last = key
        fault = np.where((fault != BLANK) & (late | again), DUPLICATE, fault)
        self.parts.append((np.where(places < 0, 3, places) * 4 + fault).astype(np.uint8))

    def facts(self) -> tuple[np.ndarray, dict]:
        symbols = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint8)
        counts = np.bincount(symbols & 3, minlength=4)
        a, b = symbols[:-1] >> 2, symbols[1:] >> 2
        legal = ((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return symbols, {"gaps": gaps, "blank": int(counts[BLANK]), "duplicate": int(counts[DUPLICATE]), "truncated": int(counts[TRUNCATED]), "illegal": int((~legal).sum())}


class _Audit:
    """A conversation's edits, met by its rows as they stream by."""

    def __init__(self, conv_id: int | None, facts: dict, cost: int, labels: np.ndarray, end: str) -> None:
        self.conv_id, self.facts, self.cost, self.labels, self.end = conv_id, facts, cost, labels, end
        self.at, self.state, self.out = 0, START, 0

    def text(self) -> str:
        return "".join([LABELS[k] for k in self.labels.tolist()]) + self.end

    def _insert(self, turn) -> tuple:
        written = next(x for x in GRAMMAR[self.state] if x in ROLES)
        self.state = GRAMMAR[self.state][written]
        return turn, INSERT, ROLES[written], ""

    def meet(self, turn, role: str, text: str) -> Iterator[tuple]:
        """(turn, edit, role, text) of the rows that the next row becomes."""
        label = LABELS[self.labels[self.at]]
        self.at += 1
        for _ in label[:-1]:
            yield self._insert(None)
        if label[-1] == DELETE:
            return
        if label[-1] == REROLE:
            role = ROLES[next(x for x in GRAMMAR[self.state] if x in ROLES)]
        self.state = GRAMMAR[self.state][role[:1]]
        yield turn, label[-1], role, text

    def finish(self) -> Iterator[tuple]:
        for _ in self.end:
            yield self._insert(None)


def _runs(batch: pa.RecordBatch) -> list[tuple[int | None, int, int, int]]:
    """(conv_id, kind, from, to) of rows of one conversation and kind."""
    ids, kind = batch.column("conv_id").to_pylist(), batch.column("kind").to_pylist()
    out, at = [], 0
    for key, rows in groupby(zip(ids, kind, strict=True)):
        n = sum(1 for _ in rows)
        out.append((*key, at, at + n))
        at += n
    return out


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[_Audit, list[tuple], bool]]]:
    """Per batch: (audit, repaired rows that the batch completes, whether the conversation ends with them).

    A conversation may span any number of batches: what is kept between them is a byte for each of
    its rows (the audit that is its result), never its texts.
    """
    open_id, symbols, audit = object(), None, None
    for batch in batches:
        runs, found = _runs(batch), []
        done: list[tuple[_Audit, list[tuple], bool]] = []
        # the short rows first, so that all conversations that the batch completes are solved together
        columns = {n: batch.column(n) for n in ("turn", "role", "digest", "fault", "late", "text")}
        waiting: list[tuple] = []
        steps: list[tuple] = []
        for conv_id, kind, a, b in runs:
            if conv_id != open_id or symbols is None and audit is None:
                if symbols is not None:
                    waiting.append((open_id, symbols))
                    steps.append(("solve", len(waiting) - 1))
                steps.append(("close",))
                open_id, symbols = conv_id, _Symbols()
            if kind == 1:
                turn = columns["turn"].slice(a, b - a)
                symbols.add(turn.fill_null(0).to_numpy(), turn.is_null().to_numpy(zero_copy_only=False), columns["role"].slice(a, b - a).to_pylist(), columns["digest"].slice(a, b - a).to_pylist(), columns["fault"].slice(a, b - a).to_numpy(), columns["late"].slice(a, b - a).to_numpy(zero_copy_only=False))
            elif kind == 2:
                if symbols is not None:
                    waiting.append((open_id, symbols))
                    steps.append(("solve", len(waiting) - 1))
                    symbols = None
                steps.append(("rows", a, b))
        facts = [s.facts() for _, s in waiting]
        solved = shortest_edits([f[0] for f in facts])
        for step in steps:
            if step[0] == "close":
                if audit is not None:
                    done.append((audit, list(audit.finish()), True))
                audit = None
            elif step[0] == "solve":
                (cost, labels, end), (conv_id, _), (_, seen) = solved[step[1]], waiting[step[1]], facts[step[1]]
                audit = _Audit(conv_id, seen, cost, labels, end)
            else:
                a, b = step[1:]
                made: list[tuple] = []
                for turn, role, text in zip(*(columns[n].slice(a, b - a).to_pylist() for n in ("turn", "role", "text")), strict=True):
                    made += audit.meet(turn, role, text)
                done.append((audit, made, False))
        yield done
    if symbols is not None:
        _, seen = symbols.facts()
        ((cost, labels, end),) = shortest_edits([symbols.facts()[0]])
        audit = _Audit(open_id, seen, cost, labels, end)
    if audit is not None:
        yield [(audit, list(audit.finish()), True)]


def repair(conversations: DataFrame) -> DataFrame:
    """Repaired conversations: conv_id, place (from 0), turn (null for inserted rows), edit (K, R or I), role, text.

    ``conversations``: (conv_id, turn, role, text); other columns are ignored. A null conv_id is a
    conversation like any other. A conversation of which every row goes gives no row; an empty
    table gives none. Texts of any length pass one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done in _audited(c.tidy(batches)):
            rows = []
            for audit, made, _ in done:
                for turn, edit, role, text in made:
                    rows.append({"conv_id": audit.conv_id, "place": audit.out, "turn": turn, "edit": edit, "role": role, "text": text})
                    audit.out += 1
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("turn", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))

    return _merged(conversations, None).mapInArrow(run, "conv_id long, place long, turn long, edit string, role string, text string")


FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


def audit(conversations: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    The digest is that of the repaired rows, ``role:text`` joined by newlines, taken as they stream by.
    ``every``: ids to report even without a row: zeros, an empty audit, the digest of the empty string.
    Odd rows are treated as in ``repair``. One conversation's digest is a chain, so one task
    streams its texts, holding a batch of them and a byte a row (its audit) at once.
    """
    schema = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in FACTS), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = hashlib.sha256()
        for done in _audited(c.tidy(batches)):
            rows = []
            for one, made, ended in done:
                for _, _, role, text in made:
                    state.update((b"\n" if one.out else b"") + f"{role}:{text}".encode())
                    one.out += 1
                if ended:
                    rows.append({"conv_id": one.conv_id, **one.facts, "cost": one.cost, "audit": one.text(), "repaired_sha256": state.hexdigest()})
                    state = hashlib.sha256()
            yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = ", ".join(f"{n} long" for n in ["conv_id", *FACTS, "cost"])
    return _merged(conversations, every).mapInArrow(run, kinds + ", audit string, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with the five kinds of damage, dealt by crc32(``conv_id:turn``) modulo 20, nulls as one space."""
    name = F.concat_ws(":", *(F.coalesce(F.col(n).cast("long").cast("string"), F.lit(" ")) for n in ("conv_id", "turn")))
    rows = _typed(conversations).withColumn("hit", F.crc32(name) % 20)
    rows = rows.where("hit <> 0").withColumns({
        "role": F.when(F.col("hit") == 4, "user").otherwise(F.col("role")),
        "text": F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
    })
    twice = F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", "role", "text", twice.alias("copy")).drop("copy")
