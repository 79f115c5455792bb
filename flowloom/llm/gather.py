"""Corpus-wide counts of hashed keys (words, n-grams, shingles), brought back to the texts.

No table of all keys is ever in one place. Texts are dealt to blocks of about `BLOCK_BYTES` by a
hash. A block sends each of its distinct keys once, with its count in the block, to a bucket that
the key's leading bits name; keys of a block and bucket travel as one sorted binary. A bucket sums
the counts and answers each block with the totals alone, in the order of the keys that it sent. The
block finds its keys again from its texts and so has the total of every key in them:

    texts --by block--> distinct keys --by bucket--> totals --by block--> texts with totals

A frequent key costs one entry for each block, whatever its share of the corpus. So that its bucket
does not grow with the corpus, blocks come in groups of `GROUP_BLOCKS`: each (bucket, group) is summed
up first, a bucket then sums its groups' totals and answers the groups, and these answer their blocks.
A corpus of one group needs no first sum, which changes no count.

Keys are whole 64-bit hashes, sent as the differences of sorted ones (about six bytes each). Two of n
distinct keys share a value with a probability of about n * n / 2**65: one in 37 for 10**9 keys; their
counts would add up.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbytes import release

BLOCK_BYTES = 2 << 20
BUCKET_KEYS = 1 << 20
GROUP_BLOCKS = 4096
TASKS = 32_768
SENT = "bucket int, block int, kind int, keys binary, counts binary"
ANSWER = "block int, kind int, bucket int, totals binary"


class Layout:
    """Blocks and buckets for a corpus of so many bytes and rows; `kinds` keys for every word."""

    def __init__(self, size: int, rows: int, kinds: int):
        size += 8 * rows
        self.blocks = max(1, -(-size // BLOCK_BYTES))
        expected = max(1, size * kinds // 5)
        self.bucket_bits = max(0, math.ceil(math.log2(expected / BUCKET_KEYS)))
        self.groups = -(-self.blocks // GROUP_BLOCKS)

    @classmethod
    def of(cls, docs: DataFrame, text: str, kinds: int) -> Layout:
        r = docs.agg(F.sum(F.octet_length(text)).alias("b"), F.count("*").alias("n")).first()
        return cls(r.b or 0, r.n, kinds)

    def block(self, *columns: Column) -> Column:
        return F.pmod(F.xxhash64(*columns, F.lit(1)), F.lit(self.blocks)).cast("int")


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences."""
    return pack_counts(np.diff(keys, prepend=np.uint64(0)))


def unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack_counts(raw).view(np.uint64), dtype=np.uint64)


def pack_counts(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_counts(raw: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


def blocked(docs: DataFrame, layout: Layout, *by: Column) -> DataFrame:
    """docs dealt by their block. The exchange is spelt out, so that all users of the result share it."""
    return by_block(docs.withColumn("block", layout.block(*by)), layout)


def by_block(rows: DataFrame, layout: Layout) -> DataFrame:
    return rows.repartition(min(-(-layout.blocks // 4), TASKS), "block")  # a task takes its blocks one after the other


def sent(texts: DataFrame, layout: Layout, distinct: Callable[[pa.Table], list[tuple[int, np.ndarray, np.ndarray]]]) -> DataFrame:
    """What blocks send. `distinct` gives (kind, sorted distinct keys, their counts) for a block's table."""
    shift = np.uint64(64 - layout.bucket_bits)

    def send(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        rows: dict[str, list] = {"bucket": [], "kind": [], "keys": [], "counts": []}
        for kind, keys, counts in distinct(table):
            bucket = (keys >> shift).astype(np.int64) if layout.bucket_bits else np.zeros(len(keys), np.int64)
            edges = [*np.flatnonzero(np.diff(bucket, prepend=-1)), len(keys)]
            for a, b in zip(edges, edges[1:], strict=False):
                for name, x in (("bucket", int(bucket[a])), ("kind", kind), ("keys", pack(keys[a:b])), ("counts", pack_counts(counts[a:b]))):
                    rows[name].append(x)
        release()
        return pa.table({"bucket": pa.array(rows["bucket"], pa.int32()), "block": pa.array([block] * len(rows["kind"]), pa.int32()), "kind": pa.array(rows["kind"], pa.int32()), "keys": pa.array(rows["keys"], pa.binary()), "counts": pa.array(rows["counts"], pa.binary())})

    return texts.groupBy("block").applyInArrow(send, SENT)


def _sum_bucket(table: pa.Table, only: int | None = None):
    """(kind, rows, their keys' edges, inverse, distinct keys, totals) for each kind in a bucket."""
    kinds = table.column("kind").to_numpy()
    for kind in np.unique(kinds) if only is None else [only][: int((kinds == only).any())]:
        at = np.flatnonzero(kinds == kind)
        keys = [unpack(table.column("keys")[int(i)].as_py()) for i in at]
        counts = np.concatenate([unpack_counts(table.column("counts")[int(i)].as_py()) for i in at])
        unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.zeros(len(unique), np.int64)
        np.add.at(totals, inverse, counts)
        yield int(kind), at, np.cumsum([0, *map(len, keys)]), inverse, unique, totals


def _answer(table: pa.Table, to: str, totals_by_kind: dict[int, np.ndarray] | None = None) -> pa.Table:
    """The totals of the keys of each row of a bucket, for the block or group that sent it; the bucket's own sums if none are given."""
    sender, bucket = table.column(to).to_numpy(), table.column("bucket")[0].as_py()
    out: dict[str, list] = {to: [], "kind": [], "totals": []}
    for kind, at, edges, inverse, _, totals in _sum_bucket(table):
        found = totals if totals_by_kind is None else totals_by_kind[kind]
        for i, a, b in zip(at, edges, edges[1:], strict=False):
            for name, x in ((to, int(sender[i])), ("kind", kind), ("totals", pack_counts(found[inverse[a:b]]))):
                out[name].append(x)
    release()
    return pa.table({to: pa.array(out[to], pa.int32()), "kind": pa.array(out["kind"], pa.int32()), "bucket": pa.array([bucket] * len(out["kind"]), pa.int32()), "totals": pa.array(out["totals"], pa.binary())})


def _group(layout: Layout) -> Column:
    return F.pmod(F.col("block"), F.lit(layout.groups)).cast("int")


def _group_sums(sent_rows: DataFrame, layout: Layout) -> DataFrame:
    """What groups of blocks send in the place of their blocks: one sum for each distinct key."""

    def add(table: pa.Table) -> pa.Table:
        bucket, group = table.column("bucket")[0].as_py(), table.column("group")[0].as_py()
        rows = [(kind, pack(unique), pack_counts(totals)) for kind, _, _, _, unique, totals in _sum_bucket(table)]
        release()
        kinds, keys, counts = zip(*rows, strict=True)
        n = len(rows)
        return pa.table({"bucket": pa.array([bucket] * n, pa.int32()), "group": pa.array([group] * n, pa.int32()), "kind": pa.array(kinds, pa.int32()), "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary())})

    return sent_rows.withColumn("group", _group(layout)).groupBy("bucket", "group").applyInArrow(add, SENT.replace("block", "group"))


def answers(sent_rows: DataFrame, layout: Layout) -> DataFrame:
    if layout.groups == 1:
        return by_block(sent_rows.groupBy("bucket").applyInArrow(lambda t: _answer(t, "block"), ANSWER), layout)
    of_groups = _group_sums(sent_rows, layout).groupBy("bucket").applyInArrow(lambda t: _answer(t, "group"), ANSWER.replace("block", "group"))

    def pass_on(left: pa.Table, right: pa.Table) -> pa.Table:
        found = {int(k): unpack_counts(x) for k, x in zip(right.column("kind").to_pylist(), right.column("totals").to_pylist(), strict=True)}
        return _answer(left, "block", found)

    by = ["bucket", "group"]
    both = sent_rows.withColumn("group", _group(layout)).groupBy(*by).cogroup(of_groups.groupBy(*by))
    return by_block(both.applyInArrow(pass_on, ANSWER), layout)


def summary(sent_rows: DataFrame, layout: Layout, kind: int) -> DataFrame:
    """One row over all keys of a kind: total (sum of counts), distinct (keys with a count), once, twice."""

    def part(table: pa.Table) -> pa.Table:
        row = [0, 0, 0, 0]
        for _, _, _, _, _, totals in _sum_bucket(table, kind):
            row = [int(totals.sum()), int((totals > 0).sum()), int((totals == 1).sum()), int((totals == 2).sum())]
        return pa.table({n: pa.array([v], pa.int64()) for n, v in zip(("total", "distinct", "once", "twice"), row, strict=True)})

    summed = sent_rows if layout.groups == 1 else _group_sums(sent_rows, layout)
    parts = summed.groupBy("bucket").applyInArrow(part, "total long, distinct long, once long, twice long")
    return parts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "distinct", "once", "twice")))


def totals_of(answer: pa.Table, kind: int, n: int) -> np.ndarray:
    """A block's totals of a kind in the order of its sorted distinct keys."""
    rows = np.flatnonzero(answer.column("kind").to_numpy() == kind)
    rows = rows[np.argsort(answer.column("bucket").to_numpy()[rows], kind="stable")]
    parts = [unpack_counts(answer.column("totals")[int(i)].as_py()) for i in rows]
    out = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    if len(out) != n:
        raise ValueError(f"{len(out)} totals for {n} keys")
    return out
