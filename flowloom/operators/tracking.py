"""Losses and declarations by observation domain, in order of arrival.

Sequence numbers are 32-bit and wrap. The trackers below follow one session each, exactly, as folds
over rows sorted by arrival (see sequential.py). `missed_packets` is the same in window functions,
exact while a session neither wraps nor restarts.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sequential import fold, fold_slices

WRAP = 1 << 32
FORWARD = 1 << 30  # a greater step is a restart
LATE = 1024  # numbers this far behind are late, not a restart
LATE_RUN = 4
PART = 1 << 20  # rows of a part that one task reduces


def missed_packets(rows: DataFrame, session: list[str], order: str, seq: str) -> DataFrame:
    """session, missed: gaps against the greatest number so far, so late packets change nothing."""
    before = F.max(seq).over(Window.partitionBy(*session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    gap = F.greatest(F.col(seq) - before - 1, F.lit(0))
    return rows.withColumn("_gap", F.coalesce(gap, F.lit(0))).groupBy(*session).agg(F.sum("_gap").cast("long").alias("missed"))


class PacketLoss:
    """Sessions that number datagrams: forward steps count what they skip, late ones nothing, other jumps begin anew."""

    measures = ("missed",)

    def __init__(self):
        self.last: int | None = None
        self.missed = 0

    def see(self, number: int) -> None:
        ahead = 0 if self.last is None else (number - self.last) % WRAP
        if self.last is not None and ahead > WRAP - 1 - LATE:
            return
        if 0 < ahead < FORWARD:
            self.missed += ahead - 1
        self.last = number

    @classmethod
    def settled(cls):
        """Takes rows in order from anywhere in a session; gives a tracker that has counted nothing once the state no longer depends on what came before them."""
        low = width = None

        def after(number: int):
            nonlocal low, width  # the last number is one of low to low + width
            ahead = 0 if low is None else (number - low) % WRAP
            if low is not None and width <= ahead < WRAP - LATE:
                out = cls()
                out.last = number
                return out
            low, width = (number, width - ahead) if low is not None and ahead < width else (number, LATE)
            return None

        return after

    def see_all(self, numbers: np.ndarray) -> None:
        """`see` of each in order. Stretches of forward steps are added up at once."""
        at, alone = 0, 1
        while at < len(numbers):
            for n in numbers[at : at + alone].tolist():
                self.see(n)
            at += alone
            rest = numbers[at:]
            if not len(rest):
                return
            ahead = np.diff(rest, prepend=self.last) % WRAP
            odd = ahead >= FORWARD
            clean = int(odd.argmax()) if odd.any() else len(rest)
            if clean:
                self.missed += int(np.maximum(ahead[:clean] - 1, 0).sum())
                self.last = int(rest[clean - 1])
            at, alone = at + clean, alone * 2


class _Runs:
    """Trackers that take at most LATE_RUN late rows in a row: of five neighbouring rows one is taken as it is."""

    @classmethod
    def settled(cls):
        """As that of PacketLoss: one tracker begins at each of the first rows, until all have come to one state."""
        begun: list = []

        def after(*row):
            if len(begun) <= LATE_RUN:
                begun.append(cls())
            for t in begun:
                t.see(*row)
            if len(begun) <= LATE_RUN or any(state(t) != state(begun[0]) for t in begun):
                return None
            out = cls()
            vars(out).update(state(begun[0]))
            return out

        return after


class RecordLoss(_Runs):
    """Sessions that number records: a message says how many came before it. An unfinished message, or another engine, begins anew."""

    measures = ("missed",)

    def __init__(self):
        self.expected: int | None = None
        self.engine: int | None = None
        self.missed = self.late = 0

    def see(self, number: int, records: int, engine: int = 0, complete: bool = True) -> None:
        if self.expected is not None and engine == self.engine:
            ahead = (number - self.expected) % WRAP
            if ahead > WRAP - 1 - LATE and self.late < LATE_RUN:
                self.late += 1
                return
            if ahead < FORWARD:
                self.missed += ahead
        self.late, self.engine = 0, engine
        self.expected = (number + records) % WRAP if complete else None

    def see_all(self, numbers: np.ndarray, records: np.ndarray, engines: np.ndarray | None = None, complete: np.ndarray | None = None) -> None:
        """`see` of each in order. Stretches without late ones are added up at once."""
        whole = np.ones(len(numbers), bool) if complete is None else complete
        engines = np.zeros(len(numbers), np.int64) if engines is None else engines
        at, alone = 0, 1
        while at < len(numbers):
            for x in zip(*(c[at : at + alone].tolist() for c in (numbers, records, engines, whole)), strict=True):
                self.see(*x)
            at += alone
            if self.late or at >= len(numbers):
                continue
            before = slice(at - 1, len(numbers) - 1)
            counts = whole[before] & (engines[at:] == engines[before])
            ahead = (numbers[at:] - numbers[before] - records[before]) % WRAP
            odd = counts & (ahead > WRAP - 1 - LATE)
            clean = int(odd.argmax()) if odd.any() else len(ahead)
            if clean:
                self.missed += int(ahead[:clean][counts[:clean] & (ahead[:clean] < FORWARD)].sum())
                last = at + clean - 1
                self.engine = int(engines[last])
                self.expected = int(numbers[last] + records[last]) % WRAP if whole[last] else None
            at, alone = at + clean, alone * 2


class SamplePool(_Runs):
    """Growth of a sampler's pool and drops between neighbouring samples of one rate."""

    measures = ("pool", "drops")

    def __init__(self):
        self.last: tuple[int, int, int, int] | None = None
        self.pool = self.drops = self.late = 0

    def see(self, number: int, rate: int, pool: int, drops: int) -> None:
        if self.last is not None:
            ahead = (number - self.last[0]) % WRAP
            if ahead > WRAP - 1 - LATE and pool <= self.last[2] and self.late < LATE_RUN:
                self.late += 1
                return
            if ahead < FORWARD and rate == self.last[1]:
                more, lost = (pool - self.last[2]) % WRAP, (drops - self.last[3]) % WRAP
                self.pool += more if more < FORWARD else 0
                self.drops += lost if lost < FORWARD else 0
        self.late, self.last = 0, (number, rate, pool, drops)


def state(tracker) -> dict:
    """What a tracker goes by, without what it has counted."""
    return {k: v for k, v in vars(tracker).items() if k not in tracker.measures}


class _Part:
    """A part of a session: its first rows, up to where the state is known whatever came before, and what a tracker makes of all that follow them."""

    def __init__(self, key: tuple, names: list[str], tracker, fields: list[str], types: pa.Schema):
        self.key, self.fields, self.types = dict(zip(names, key, strict=True)), fields, types
        self.settled, self.place, self.rest = tracker.settled(), 0, None

    def step(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = 0
        if self.rest is None:
            for x in zip(*(rows.column(f).to_pylist() for f in self.fields), strict=True):
                at += 1
                self.rest = self.settled(*x)
                if self.rest is not None:
                    break
            first = {n: pa.repeat(pa.scalar(v, self.types.field(n).type), at) for n, v in self.key.items()} | {f: rows.column(f).slice(0, at).cast(pa.int64()) for f in self.fields}
            first |= {"_place": pa.array(range(self.place, self.place + at), pa.int64()), "_rest": pa.nulls(at, pa.string())}
            self.place += at
            yield pa.RecordBatch.from_arrays([first[n] for n in self.types.names], schema=self.types)
        if at == len(rows):
            return
        columns = [rows.column(f).slice(at) for f in self.fields]
        if hasattr(self.rest, "see_all"):
            self.rest.see_all(*(c.to_numpy(zero_copy_only=False).astype(np.int64) for c in columns))
        else:
            for x in zip(*(c.to_pylist() for c in columns), strict=True):
                self.rest.see(*x)

    def end(self) -> list[dict]:
        return [] if self.rest is None else [self.key | dict.fromkeys(self.fields) | {"_place": self.place, "_rest": json.dumps(vars(self.rest))}]


class _Counted:
    def __init__(self, key: tuple, names: list[str], tracker, fields: list[str]):
        self.row, self.tracker, self.fields = dict(zip(names, key, strict=True)), tracker, fields

    def step(self, row: dict) -> list[dict]:
        if row["_rest"] is None:
            self.tracker.see(*(row[f] for f in self.fields))
            return []
        for k, v in json.loads(row["_rest"]).items():
            setattr(self.tracker, k, getattr(self.tracker, k) + v if k in self.tracker.measures else tuple(v) if isinstance(v, list) else v)
        return []

    def end(self) -> list[dict]:
        return [self.row | {m: getattr(self.tracker, m) for m in self.tracker.measures}]


def missed(rows: DataFrame, session: dict[str, str], order: str, fields: list[str], tracker, among: DataFrame | None = None, part: int = PART) -> DataFrame:
    """What a tracker counts of each session. session: column -> 'string' or 'long'; fields: what the tracker sees.

    Sessions are cut by `order` into parts of about `part` rows of all sessions, which are reduced side by side
    and put together in order. `among` has the numbers of `rows` in its column `order`, others perhaps as well, and is cheaper to read."""
    kinds = {"string": pa.string(), "long": pa.int64()}
    names = list(session)
    span = (rows if among is None else among).agg(F.struct(F.min(order).alias("low"), F.max(order).alias("high"), F.count("*").alias("n")).alias("s")).scalar()
    parts = F.greatest(F.lit(1), F.ceil(span["n"] / part))
    width = F.greatest(F.lit(1), F.ceil((span["high"] - span["low"] + 1) / parts))
    cut = rows.select(*names, F.floor((F.col(order) - span["low"]) / width).cast("long").alias("_part"), order, *fields)
    kept = pa.schema([(n, kinds[t]) for n, t in session.items()] + [("_part", pa.int64())] + [(f, pa.int64()) for f in fields] + [("_place", pa.int64()), ("_rest", pa.string())])
    ddl = lambda types: ", ".join(f"`{f.name}` {'string' if f.type == pa.string() else 'long'}" for f in types)
    by = [*names, "_part"]
    reduced = fold_slices(cut, by, [order], lambda key: _Part(key, by, tracker, fields, kept), ddl(kept), kept)
    types = pa.schema([(n, kinds[t]) for n, t in session.items()] + [(m, pa.int64()) for m in tracker.measures])
    return fold(reduced, names, ["_part", "_place"], lambda key: _Counted(key, names, tracker(), fields), ddl(types), types)


def resolved_rates(records: DataFrame, declarations: DataFrame) -> DataFrame:
    """records with `rate` and `owed`: the sampling rate in force where the record carries none.

    records: exporter, odid, arrival_seq, sampling_rate, sampler_id (NULL: names none);
    declarations: exporter, odid, sampler_id (NULL: the domain's own), rate, declared_seq.

    A named sampler takes its own domain's declaration, else the device's if all domains agree. A
    sampler 0 that nobody declared is unsampled. Otherwise the domain's own rate holds, else the one
    that all declarations of the device agree on; else the rate is 0 and owed. Declarations count
    from their arrival on; the latest of a key replaces the ones before it. One pass over the merged
    rows of a device in order of arrival."""
    d = declarations.select("exporter", "odid", F.col("declared_seq").alias("arrival_seq"), F.lit(0).alias("kind"), "sampler_id", "rate")
    r = records.select("exporter", "odid", "arrival_seq", F.lit(1).alias("kind"), "sampler_id", F.col("sampling_rate").alias("rate"))
    types = pa.schema([("exporter", pa.string()), ("odid", pa.int64()), ("arrival_seq", pa.int64()), ("rate", pa.int64()), ("owed", pa.bool_())])
    return fold(d.unionByName(r), ["exporter"], ["arrival_seq", "kind"], lambda key: _Resolver(), "exporter string, odid long, arrival_seq long, rate long, owed boolean", types)


class _Resolver:
    def __init__(self):
        self.state = Declarations()

    def step(self, x: dict) -> list[dict]:
        if x["kind"] == 0:
            self.state.declare(x["odid"], x["sampler_id"], x["rate"])
            return []
        rate, owed = (x["rate"], False) if x["rate"] else self.state.resolve(x["odid"], x["sampler_id"])
        return [{"exporter": x["exporter"], "odid": x["odid"], "arrival_seq": x["arrival_seq"], "rate": rate, "owed": owed}]

    def end(self) -> list[dict]:
        return []


class Declarations:
    """Sampling declarations of one device."""

    def __init__(self, most: int = 256):
        self.named: dict[tuple[int, int], int] = {}
        self.own: dict[int, int] = {}
        self.scoped: dict[tuple, int] = {}  # ('template', odid, port, id), ('interface', odid, index) or ('domain', odid)
        self.most, self.refused, self.changes = most, 0, 0

    def _put(self, table: dict, key, rate: int) -> None:
        """A declaration; new ones are refused where there are `most`, and another rate for a known one is counted."""
        if rate <= 0:
            return
        if key not in table and len(self.named) + len(self.own) + len(self.scoped) >= self.most:
            self.refused += 1
            return
        self.changes += table.get(key, rate) != rate
        table[key] = rate

    def declare(self, odid: int, sampler: int | None, rate: int) -> None:
        self._put(self.own if sampler is None else self.named, odid if sampler is None else (odid, sampler), rate)

    def declare_scope(self, scope: tuple, rate: int) -> None:
        self._put(self.scoped, scope, rate)

    @staticmethod
    def _agreed(rates: Iterable[int]) -> int:
        """The one rate that all agree on, else 0."""
        seen = set(rates)
        return seen.pop() if len(seen) == 1 else 0

    def _of_domain(self, odid: int) -> int:
        return self.own.get(odid) or self.scoped.get(("domain", odid)) or self._agreed([*self.named.values(), *self.own.values()])

    def resolve(self, odid: int, sampler: int | None = None, selector: int | None = None, scopes: Iterable[tuple] = ()) -> tuple[int, bool]:
        """(rate, owed): a rate of 0 is owed if the record should have had one, and not owed if its sampler 0 says that it was not sampled."""
        named = sampler if sampler is not None else selector
        if named is not None and (odid, named) in self.named:
            return self.named[odid, named], False
        if sampler is not None:
            elsewhere = {r for (_, s), r in self.named.items() if s == sampler}
            if elsewhere:
                rate = self._agreed(elsewhere)
                return rate, rate == 0
            if sampler == 0:
                return 0, False
        elif selector is None:
            rate = next((self.scoped[s] for s in scopes if s in self.scoped), 0)
            if rate:
                return rate, False
        rate = self._of_domain(odid)
        return rate, rate == 0
