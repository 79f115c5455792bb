"""Bulk decoding of a device's datagrams against one by one."""

import random
from struct import pack

import numpy as np
import pyarrow as pa
import pytest

from flowloom.decode import batch
from flowloom.decode import bulk as bulk_module
from flowloom.decode.bulk import Bulk
from flowloom.decode.templated import Device, Limits
from flowloom.operators.tracking import PacketLoss, RecordLoss

from . import wire

ROWS = pa.schema([("arrival_seq", pa.int64()), ("src_addr", pa.string()), ("src_port", pa.int32()), ("payload", pa.binary()), ("now", pa.float64())])
NUMBERS = [(1, 8), (2, 3), (3, 4), (23, 8), (24, 4), (4, 1), (5, 1), (7, 2), (7, 9), (11, 2), (9, 1), (10, 2), (10, 5), (14, 4), (16, 4), (48, 1), (302, 4), (22, 4), (21, 4), (6, 1), (6, 3), (61, 1), (195, 1), (95, 4), (8, 4), (12, 4), (27, 16), (28, 16), (150, 4), (151, 4), (152, 8), (153, 8), (160, 8), (999, 5), (34, 4)]


def row(*x):
    """Instants beyond 63 bits, as damaged datagrams have, are left out: no column holds them, whichever way they are read."""
    return {k: None if k in ("start_us", "end_us") and abs(v or 0) >= 1 << 62 else v for k, v in batch._row(*x).items()}


def stream(seed: int, n: int) -> pa.RecordBatch:
    """Layouts that come, change and lapse, options, applications, two versions, ports and domains, gaps, late and damaged datagrams."""
    r = random.Random(seed)
    layouts, out, at, seq = {}, [], 0.0, {}
    raw = lambda k: bytes(r.choice((0, 0, 1, r.randrange(256))) for _ in range(k))
    value = lambda k, size: pack(">Q", r.choice((0, *[1756000000000 + r.randrange(9999)] * 9))) if size == 8 and k >= 150 else b"\0" * 10 + b"\xff\xff" + raw(4) if size == 16 and r.random() < 0.2 else raw(size)
    kinds = [r.sample(NUMBERS, r.randint(1, 14)) for _ in range(3)] + [wire.V9_FIELDS]
    for i in range(n):
        at += r.choice((0, 0, 0.1, 0.5)) if r.random() < 0.99 else 70
        version, port, odid = r.choice((9, 9, 10)), r.choice((2055, 2055, 2055, 7)), r.choice((1, 1, 1, 2)) if r.random() < 0.99 else r.randrange(9)
        sets, key, x = [], (version, port, odid), r.random()
        if x < 0.1 or (key not in layouts and x < 0.6):
            layouts[key] = layouts[key] if key in layouts and r.random() < 0.8 else r.choice(kinds)
            sets.append(wire.flowset(0 if version == 9 else 2, pack(">HH", 300, len(layouts[key])) + b"".join(pack(">HH", *f) for f in layouts[key])))
        elif x < 0.11:
            options = pack(">HHH", 301, 4, 8) + pack(">HH", 1, 4) if version == 9 else pack(">HHH", 301, 3, 1) + pack(">HH", 149, 4)
            sets += [wire.flowset(1 if version == 9 else 3, options + pack(">HHHH", 48, 1, 34, 4)), wire.flowset(301, pack(">IBI", odid, r.randrange(2), r.choice((10, 20))))]
        elif x < 0.12:
            options = pack(">HHH", 302, 4, 8) + pack(">HH", 1, 4) if version == 9 else pack(">HHH", 302, 3, 1) + pack(">HH", 149, 4)
            sets += [wire.flowset(1 if version == 9 else 3, options + pack(">HHHH", 95, 4, 96, 4)), wire.flowset(302, pack(">I", 0) + raw(4) + b"ab\0\0")]
        for _ in range(r.choice((1, 1, 1, 2))):
            fields = layouts.get(key, wire.V9_FIELDS)
            sets.append(wire.flowset(300, b"".join(value(*f) for _ in range(r.choice((1, 1, 3))) for f in fields) + bytes(r.choice((0, 0, 2)))))
        if r.random() < 0.02:
            r.shuffle(sets)
        seq[key] = seq.get(key, 0) + r.choice((1, 1, 1, 2, 9)) - (r.random() < 0.05) * 3
        payload = bytearray((wire.v9 if version == 9 else wire.ipfix)(*sets, seq=seq[key] % (1 << 32), odid=odid))
        if r.random() < 0.01:
            payload[r.randrange(2, len(payload))] = r.randrange(256)
        if r.random() < 0.01:
            payload = payload[: r.randrange(4, len(payload))]
        out.append((i, "192.0.2.1", port, bytes(payload), at))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ROWS)], schema=ROWS)


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("limits", [Limits(ttl=60.0), Limits(ttl=60.0, domains=2, layouts=1, samplers=1)])
@pytest.mark.parametrize("least", [1, 8])
def test_same_as_one_by_one(seed, limits, least, monkeypatch):
    monkeypatch.setattr(bulk_module, "LEAST", least)
    rows, calls = stream(seed, 900), []
    device, want = Device(limits), []
    for x in rows.to_pylist():
        records, errors = device.decode(x["payload"], x["src_port"], x["now"])
        about = (x["arrival_seq"], "192.0.2.1", {9: "netflow_v9", 10: "ipfix"}[x["payload"][1]])
        want += [row(*about, y, None) for y in records] + [row(*about, None, e) for e in errors]
    bulk, state = Bulk(limits, "192.0.2.1", batch.TYPES, row), Bulk(limits, "192.0.2.1", batch.TYPES, row, rows=False)
    decode = bulk.device.decode
    monkeypatch.setattr(bulk.device, "decode", lambda *x: calls.append(x) or decode(*x))
    got = [x for a in range(0, 900, 350) for b in bulk.step(rows.slice(a, 350)) for x in b.to_pylist()]
    as_read = lambda x: x | {c: None if x[c] is None else int(x[c]) for c in ("bytes", "packets", "flows")}
    assert sorted(repr(as_read(x)) for x in got) == sorted(repr(as_read(x)) for x in want)
    assert not [b for a in range(0, 900, 350) for b in state.step(rows.slice(a, 350))]
    assert bulk.device.notes() == device.notes() == state.device.notes()
    trackers = lambda held: {k: t.__dict__ for k, t in held.items()}
    held = lambda d: {k: (x.layouts, x.unresolved, x.inversions, x.seen, trackers(x.packets), trackers(x.records)) for k, x in d.domains.items()}
    assert held(bulk.device) == held(device) == held(state.device)
    assert len(calls) < len(rows)  # some were read as columns


V9 = lambda i: wire.v9(wire.v9_template(), wire.flowset(300, wire.V9_RECORD), seq=i)
IPFIX = lambda i: wire.ipfix(wire.IPFIX_TEMPLATE, wire.flowset(400, wire.IPFIX_RECORD), seq=i)


@pytest.mark.parametrize("made", [V9, IPFIX])
def test_plain_datagrams_are_not_read_one_by_one(made, monkeypatch):
    rows = [(i, "192.0.2.1", 2055, made(i), 0.0) for i in range(1000)]
    calls = []
    bulk = Bulk(Limits(), "192.0.2.1", batch.TYPES, batch._row)
    decode = bulk.device.decode
    monkeypatch.setattr(bulk.device, "decode", lambda *x: calls.append(x) or decode(*x))
    out = list(bulk.step(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ROWS)], schema=ROWS)))
    assert sum(map(len, out)) == 1000 and len(calls) == 1


@pytest.mark.parametrize("seed", range(6))
def test_trackers_see_all(seed):
    r = np.random.default_rng(seed)
    n = (np.cumsum(r.integers(0, 4, 3000)) - np.where(r.random(3000) < r.choice((0, 0.01, 0.3)), r.integers(0, 2000, 3000), 0) + r.choice((0, (1 << 32) - 1500)) + np.where(r.random(3000) < 0.002, 1 << 31, 0)) % (1 << 32)
    records, engines, whole = r.integers(0, 4, 3000), (np.arange(3000) // 700) % 2, r.random(3000) < 0.99
    one, all_ = PacketLoss(), PacketLoss()
    for x in n.tolist():
        one.see(x)
    for part in np.array_split(n, 4):
        all_.see_all(part)
    assert one.__dict__ == all_.__dict__
    one, all_ = RecordLoss(), RecordLoss()
    for x in zip(n.tolist(), records.tolist(), engines.tolist(), whole.tolist(), strict=True):
        one.see(*x)
    for part in zip(*(np.array_split(c, 4) for c in (n, records, engines, whole)), strict=True):
        all_.see_all(*part)
    assert one.__dict__ == all_.__dict__


def test_health_makes_no_records(spark, monkeypatch):
    from pyspark.sql import functions as F

    from flowloom.decode import health

    rows = [(i, None, "192.0.2.1", 2055, bytearray(V9(i + i // 50)), "udp") for i in range(200)]
    data = spark.createDataFrame(rows, "arrival_seq long, recv_ts timestamp, src_addr string, src_port int, payload binary, listener string")
    assert health.templated_health(data).count() == batch.templated(data.withColumn("kind", batch.version(F.col("payload"))), records=False).count()
    got = {r.metric: r.value for r in health.templated_health(data).where("odid is not null").collect()}
    assert got == {"sequence_missed": 3, "templates": 1, "sampling_unresolved": 200, "clock_inversions": 0}


def test_template_expiry_makes_its_rows_once(spark):
    from flowloom.plans import registered

    from . import oracle

    plan = registered.QUERIES["template_expiry"](spark, str(oracle.SF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lineitem.parquet") <= 1 and plan.count("Join ") == 1


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("part", [7, 400, 1 << 20])
def test_missed_in_parts(spark, seed, part):
    """Sessions cut into parts count as whole ones, with late numbers, restarts and repeated ones where the parts meet."""
    from flowloom.operators.tracking import SamplePool, missed

    r, rows = random.Random(seed), []
    last = {}
    for i in range(2500):
        k = r.choice((1, 1, 1, 2))
        last[k] = (last.get(k, (1 << 32) - 800) + r.choice((0, 1, 1, 1, 2, 5, 40))) % (1 << 32) if r.random() < 0.995 else r.randrange(1 << 32)
        late = r.choice((1, 3, 500, 1024, 1025, 3000)) if r.random() < r.choice((0.02, 0.6)) else 0
        rows.append((k, i * i, (last[k] - late) % (1 << 32), r.choice((0, 1, 30)), i // 900, i * 10 - late))
    df = spark.createDataFrame(rows, "k long, at long, n long, records long, engine long, pool long")
    for tracker, fields in ((PacketLoss, ["n"]), (RecordLoss, ["n", "records", "engine"]), (SamplePool, ["n", "engine", "pool", "records"])):
        want = {}
        for x in rows:
            about = dict(zip(df.columns, x, strict=True))
            want.setdefault(x[0], tracker()).see(*(about[f] for f in fields))
        got = {x.k: [x[m] for m in tracker.measures] for x in missed(df, {"k": "long"}, "at", fields, tracker, part=part).collect()}
        assert got == {k: [getattr(t, m) for m in tracker.measures] for k, t in want.items()}
