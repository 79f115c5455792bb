from flowloom.sources import files
from flowloom.sources.collector import Collector
from flowloom.streaming import jobs
from flowloom.streaming.tables import Tables
from flowloom.streaming.totals import Totals

from . import wire
from .test_decode import datagrams


def test_landed_datagrams_are_published(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), []
    data = [wire.v9(wire.v9_template()), wire.v5(), wire.sflow(wire.sample(wire.sampled_ipv4()))]
    datagrams(spark, *data).coalesce(1).write.parquet(folder)
    put = jobs.publisher(["exporters", "hosts"], lambda out, epoch: seen.extend(out.collect()))

    def run():
        q = jobs.flows(jobs.datagrams(spark, folder)).writeStream.foreachBatch(put).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None

    run()
    assert {r.labels["version"] for r in seen if "exporter_bytes" in r.metric} == {"netflow_v5", "sflow_v5"}
    seen.clear()
    datagrams(spark, wire.v9(wire.flowset(300, wire.V9_RECORD), seq=2)).coalesce(1).write.mode("append").parquet(folder)
    run()  # the layout came in an earlier batch
    assert [r.value for r in seen if r.metric == "flowloom_exporter_bytes_total"] == [512000.0]


def flow_rows(spark, rows):
    from decimal import Decimal

    made = [(a, e, "ipfix", 0, "ingress", False, 0, bytearray([10, 0, 0, h]), bytearray([10, 0, 1, 1]), 1, 2, None if b is None else Decimal(b), Decimal(1), Decimal(1), t) for a, e, h, b, t in rows]
    return spark.createDataFrame(made, "arrival_seq long, exporter string, version string, odid long, direction string, flows_reported boolean, sampling_rate long, src_addr binary, dst_addr binary, input_if long, output_if long, bytes decimal(20,0), packets decimal(20,0), flows decimal(20,0), recv_ts timestamp")


def test_running_totals(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2026, 1, 1)
    at = lambda m: start + timedelta(minutes=m)
    seen = {}
    totals = Totals(spark, str(tmp_path / "totals"), max_entries=2)
    put = jobs.publisher(["hosts"], lambda out, epoch: seen.update({epoch: {(r.metric.split("_")[-2], r.labels["src_ip"]): r.value for r in out.collect()}}), totals=totals)
    put(flow_rows(spark, [(1, "192.0.2.1", 1, 100, at(0)), (2, "192.0.2.1", 2, 10, at(0)), (3, "192.0.2.1", 3, 7, at(0))]), 0)
    assert seen[0]["bytes", "10.0.0.1"] == 100 and seen[0]["bytes", "other"] == 7 and ("bytes", "10.0.0.3") not in seen[0]
    second = flow_rows(spark, [(4, "192.0.2.1", 1, 11, at(10)), (5, "192.0.2.1", 3, 5, at(10)), (6, "192.0.2.1", 2, None, at(10))])
    put(second, 1)
    assert seen[1]["bytes", "10.0.0.1"] == 111 and seen[1]["bytes", "other"] == 12
    assert ("bytes", "10.0.0.2") not in seen[1] and seen[1]["flows", "10.0.0.2"] == 2  # a record without the count withholds the family
    before = seen.pop(1)
    put(second, 1)  # replayed
    assert seen[1] == before
    put(flow_rows(spark, [(7, "192.0.2.1", 1, 1, at(20))]), 2)
    put(flow_rows(spark, [(8, "192.0.2.1", 3, 50, at(27))]), 3)  # the second key is idle, its place is free
    assert seen[3]["bytes", "10.0.0.1"] == 112 and seen[3]["bytes", "10.0.0.3"] == 50 and seen[3]["bytes", "other"] == 12 and ("flows", "10.0.0.2") not in seen[3]
    put(flow_rows(spark, [(9, "192.0.2.1", 3, 1, at(60)), (10, "192.0.2.1", 2, 4, at(60))]), 4)  # a key that comes back begins at zero
    assert seen[4]["bytes", "10.0.0.2"] == 4 and ("bytes", "10.0.0.1") not in seen[4] and seen[4]["bytes", "10.0.0.3"] == 1
    assert totals._epochs("hosts") == [3, 4]


def test_totals_stop_at_the_end_of_their_range(spark, tmp_path):
    seen = {}
    put = jobs.publisher(["hosts"], lambda out, epoch: seen.update({epoch: [r.value for r in out.collect() if "bytes" in r.metric and r.labels["src_ip"] != "other"]}), totals=Totals(spark, str(tmp_path)))
    for epoch in range(3):
        put(flow_rows(spark, [(epoch, "192.0.2.1", 1, 2**63, None)]), epoch)
    assert seen[0] == [2.0**63] and seen[2] == [float(2**64 - 1)]


def test_a_failing_breakdown_loses_its_own_samples(spark):
    seen, failures = [], []
    put = jobs.publisher(["threats", "hosts"], lambda out, epoch: seen.extend(out.collect()), failed=lambda name, e: failures.append(name))
    put(flow_rows(spark, [(1, "192.0.2.1", 1, 100, None)]), 0)  # no lookup has flagged any side
    assert failures == ["threats"] and {r.metric.split("_")[1] for r in seen} == {"host"}


def test_a_failing_reload_keeps_the_old_table(spark):
    good = {"fail": False}

    def load():
        if good["fail"]:
            return spark.read.parquet("/nowhere/at/all")
        return spark.range(3)

    t = Tables({"a": load, "b": lambda: spark.range(2)})
    assert {k: v.count() for k, v in t.reload().items()} == {"a": 3, "b": 2}
    good["fail"] = True
    assert {k: v.count() for k, v in t.reload().items()} == {"a": 3, "b": 2} and t.failures == {"a": 1, "b": 0} and "a" in t.errors
    good["fail"] = False
    t.reload()
    assert not t.errors


def test_collector_lands_datagrams(spark, tmp_path):
    import socket
    import time

    c = Collector(str(tmp_path), [("127.0.0.1", 0)], most_bytes=1000, seconds=0.2).start()
    address = c.sockets[0].getsockname()
    s = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    for x in (wire.v5(), b"x" * 2000, wire.v9(wire.v9_template())):
        s.sendto(x, address)
    name = c.name(c.sockets[0])
    for _ in range(100):
        if c.counts[name]["packets"] == 3 and c.queue.empty():
            break
        time.sleep(0.05)
    c.stop()
    assert c.counts[name] == {"packets": 3, "bytes": len(wire.v5()) + 1001 + len(wire.v9(wire.v9_template())), "queue_full": 0, "truncated": 1}
    got = files.datagrams(spark, str(tmp_path)).orderBy("arrival_seq").collect()
    assert [bytes(r.payload) for r in got] == [wire.v5(), wire.v9(wire.v9_template())] and got[0].src_addr == "127.0.0.1" and got[0].listener == name


def test_collector_counts_what_its_queue_cannot_hold(tmp_path):
    c = Collector(str(tmp_path), [("127.0.0.1", 0)], most_queued=1)
    import threading

    threading.Thread(target=c._listen, args=(c.sockets[0],), daemon=True).start()  # nobody writes
    import socket
    import time

    s = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    for _ in range(3):
        s.sendto(b"abcd", c.sockets[0].getsockname())
    counts = c.counts[c.name(c.sockets[0])]
    for _ in range(100):
        if counts["packets"] == 3:
            break
        time.sleep(0.05)
    c.stopped.set()
    assert counts["queue_full"] == 2 and counts["packets"] == 3
