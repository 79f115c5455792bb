"""A UDP collector that lands datagrams as Parquet, for batch and streaming jobs to read.

UDP cannot be read again, so nothing is decoded here: a socket thread puts datagrams into a bounded
queue, a writer thread lands them in files, each written under a hidden name and renamed when whole.
What does not fit is counted and dropped: `queue_full` if the writer lags behind, `truncated` if a
datagram is longer than the receive buffer. Counts of packets and bytes include what is dropped.
"""

from __future__ import annotations

import os
import queue
import socket
import threading
import time
import uuid
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.parquet as pq

MOST_BYTES, QUEUE = 9216, 8192
SCHEMA = pa.schema([("arrival_seq", pa.int64()), ("recv_ts", pa.timestamp("us", "UTC")), ("src_addr", pa.string()), ("src_port", pa.int32()), ("listener", pa.string()), ("payload", pa.binary())])


class Collector:
    """Listens on (host, port) pairs until `stop`; all protocols share a socket."""

    def __init__(self, folder: str, addresses: list[tuple[str, int]] = (("0.0.0.0", 4739),), most_bytes: int = MOST_BYTES, most_queued: int = QUEUE, rows: int = 10_000, seconds: float = 1.0):
        self.folder, self.most, self.rows, self.seconds = folder, most_bytes, rows, seconds
        self.queue: queue.Queue = queue.Queue(most_queued)
        self.counts: dict[str, dict[str, int]] = {}
        self.stopped = threading.Event()
        self.lock = threading.Lock()
        self.seq = time.time_ns() // 1000  # later runs number on
        self.sockets = []
        for host, port in addresses:
            s = socket.socket(socket.AF_INET6 if ":" in host else socket.AF_INET, socket.SOCK_DGRAM)
            s.bind((host, port))
            s.settimeout(0.2)
            self.sockets.append(s)
            self.counts[self.name(s)] = {"packets": 0, "bytes": 0, "queue_full": 0, "truncated": 0}
        os.makedirs(folder, exist_ok=True)
        self.threads = [threading.Thread(target=self._listen, args=(s,), daemon=True) for s in self.sockets] + [threading.Thread(target=self._write, daemon=True)]

    @staticmethod
    def name(s: socket.socket) -> str:
        host, port = s.getsockname()[:2]
        return f"udp://{host}:{port}"

    def start(self) -> Collector:
        for t in self.threads:
            t.start()
        return self

    def _listen(self, s: socket.socket) -> None:
        name = self.name(s)
        counts = self.counts[name]
        while not self.stopped.is_set():
            try:
                payload, peer = s.recvfrom(self.most + 1)
            except TimeoutError:
                continue
            except OSError:
                return
            counts["packets"] += 1
            counts["bytes"] += len(payload)
            if len(payload) > self.most:
                counts["truncated"] += 1
                continue
            with self.lock:  # numbers rise in the order of the queue
                try:
                    self.queue.put_nowait((self.seq, datetime.now(UTC), peer[0].removeprefix("::ffff:"), peer[1], name, payload))
                    self.seq += 1
                except queue.Full:
                    counts["queue_full"] += 1

    def _write(self) -> None:
        held: list[tuple] = []
        began = time.monotonic()
        while not (self.stopped.is_set() and self.queue.empty()):
            try:
                held.append(self.queue.get(timeout=0.1))
            except queue.Empty:
                pass
            if held and (len(held) >= self.rows or time.monotonic() - began >= self.seconds):
                self._land(held)
                held, began = [], time.monotonic()
        if held:
            self._land(held)

    def _land(self, rows: list[tuple]) -> None:
        table = pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)
        name = f"{rows[0][0]}-{uuid.uuid4().hex}.parquet"
        pq.write_table(table, f"{self.folder}/.{name}")
        os.replace(f"{self.folder}/.{name}", f"{self.folder}/{name}")

    def stop(self) -> None:
        self.stopped.set()
        for t in self.threads:
            t.join(10)
        for s in self.sockets:
            s.close()
