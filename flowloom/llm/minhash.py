"""Near-duplicate texts by improved consistent weighted sampling of TF-IDF shingles.

Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. A
shingle is `WORDS` consecutive words (all of them, if a text has fewer). Its weight in a text is its
number of occurrences times an inverse document frequency between 1 and 1 + `IDF`, in 250 steps.
Two texts are linked if the weighted Jaccard similarity, the sum of lesser weights by the sum of
greater weights, is `LEAST` or more; equal texts always are. A class is what links connect.

1. Equal texts are one: a task keeps a text once, a block once in all. Blocks are dealt by the
   text's hash, so what is left of a large group of copies is one row for each task that read some.
2. Document frequencies of all shingles of all distinct texts come from gather.py.
3. Each text gets `BANDS` * `ROWS` consistent weighted samples; the samples of a band make its key.
4. Texts with equal band keys are candidates. A text's support is the number of texts that it meets
   in its buckets; the lead of a bucket is its text of most support (in a group of edited copies, the
   one that most agree with), found part by part in large buckets. Every text goes with each of its leads to one task, or, in groups of
   more than `CHUNK_BYTES`, to one of several, to each of which the lead goes too.
5. There the exact weighted Jaccard similarity is computed, of each text with the lead and of those
   that are not similar to it with all others in the chunk. Only found links leave the task: one to
   the lead, or those of the others.
6. Groups in several chunks: texts that these links, of all groups, do not connect with the lead are
   dealt to blocks of about `BLOCK_BYTES`, as are those connected with it, and every such block is
   compared with itself and each other block of the group. So no two similar texts of a bucket stay
   uncompared, unless other links connect them already.

Defined results: null texts are classes of their own; texts without words are linked with equal
texts only; repeated rows are in one class; rows without id belong to the class of their text and
never name it. A class is named by its least id. A text is known by a 64-bit hash; where two texts
share it, by a second one that does not depend on the first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, hash_pair, small_batches, small_enough
from .components import components
from .gather import Layout, answers, blocked, sent, totals_of
from .textbytes import WORDLIKE, column_bytes, mix, release, word_ngrams, words

WORDS = 5
LEAST = 0.8
IDF = 0.25
BANDS, ROWS = 8, 3
CHUNK_BYTES = 1 << 20
BLOCK_BYTES = 4 << 20
PART_ROWS = 1024
#: rows of a side that is broadcast; they are one or two numbers wide, so 8 MB in an executor's table
BROADCAST_ROWS = 125_000
STEPS = 250
_TABLE = 1 << 12


def shingles(column) -> tuple[np.ndarray, np.ndarray, int]:
    """(64-bit shingle hashes, text index) of all occurrences, and the number of texts."""
    data, offsets = column_bytes(column)
    _, _, h, first = words(data, offsets, WORDLIKE)
    full, text = word_ngrams(h, first, WORDS)
    count = np.diff(first)
    for k in range(1, WORDS):  # texts of fewer words are one shingle, of all of them
        short = np.flatnonzero(count == k)
        if len(short):
            row = h[first[:-1][short][:, None] + np.arange(k)]
            one = row[:, 0] + np.uint64(k)
            for j in range(1, k):
                one = one * np.uint64(0x9E3779B97F4A7C15) + row[:, j]
            full, text = np.concatenate([full, mix(one)]), np.concatenate([text, short])
    return full, text, len(count)


def sets(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Distinct (text, key) with occurrences, ordered by text and key."""
    h, text, n = shingles(column)
    order = np.lexsort((h, text))
    keys, text = h[order], text[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return keys[at], text[at], np.diff(np.append(at, len(keys))), n


def idf_step(df: np.ndarray, texts: int) -> np.ndarray:
    """Inverse document frequency on a scale of 0 (in every text) to STEPS (in one)."""
    top = np.log((1 + texts) / 2) or 1.0
    return np.clip(np.rint(STEPS * np.log((1 + texts) / (1 + np.maximum(df, 1))) / max(top, 1e-9)), 0, STEPS).astype(np.uint8)


def weights(tf: np.ndarray, step: np.ndarray) -> np.ndarray:
    return tf * (1 + IDF * step / STEPS)


def _tables(rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    gamma = lambda: np.quantile(rng.gamma(2, 1, 1 << 20), (np.arange(_TABLE) + 0.5) / _TABLE)
    return gamma().astype(np.float32), np.log(gamma()).astype(np.float32)


_GAMMA, _LOG_GAMMA = _tables(np.random.default_rng(5))
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def signatures(keys: np.ndarray, text: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """BANDS keys for each text that has shingles: rows in text order, of those texts only.

    A sample draws r, c from Gamma(2, 1) and b from [0, 1) by hash of shingle and sample; the shingle
    with least ln c - r (floor(ln w / r + b) - b + 1) is chosen, with the floor's value.
    """
    starts = np.flatnonzero(np.diff(text, prepend=-1))
    log_w = np.log(weight).astype(np.float32)
    mixed = mix(keys.copy())
    out = np.zeros((len(starts), BANDS), np.uint64)
    lengths = np.diff(np.append(starts, len(text)))
    owner = np.repeat(np.arange(len(starts)), lengths)
    for k in range(BANDS * ROWS):
        u = mixed * (_SEEDS[k] | np.uint64(1))
        u ^= u >> np.uint64(31)
        u *= np.uint64(0xD6E8FEB86659FD93)
        r = _GAMMA[(u >> np.uint64(52)).astype(np.int64)]
        c = _LOG_GAMMA[(u >> np.uint64(40) & np.uint64(_TABLE - 1)).astype(np.int64)]
        b = (u >> np.uint64(16) & np.uint64(0xFFFFFF)).astype(np.float32) / np.float32(1 << 24)
        t = np.floor(log_w / r + b)
        a = c - r * (t - b + 1)
        least = np.minimum.reduceat(a, starts) if len(starts) else a
        hit = np.flatnonzero(a == least[owner])
        first = hit[np.unique(owner[hit], return_index=True)[1]]
        chosen = mix(mixed[first] + t[first].astype(np.int64).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        out[:, k // ROWS] = mix(out[:, k // ROWS] * np.uint64(0x9E3779B97F4A7C15) + chosen)
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted keys, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both)) if len(a[0]) and len(b[0]) else 0.0


def _reads(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _once(batches):
    """A text's first row in this task as it is; its other rows not at all."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        keep = []
        for i, key in enumerate(zip(batch.column("t1").to_pylist(), batch.column("t2").to_pylist(), strict=True)):
            if key not in seen:
                seen.add(key)
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64()))


class _Weighted:
    """Shingles and weights of the texts of a task's table."""

    def __init__(self, table: pa.Table):
        self.keys, text, tf, self.n = sets(table.column("text"))
        self.edges = np.searchsorted(text, np.arange(self.n + 1))
        step = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8) for x in table.column("steps").to_pylist()] or [np.zeros(0, np.uint8)])
        self.w = weights(tf, step)
        self.total = self._sums(self.w, 0, self.n)

    def _sums(self, x: np.ndarray, first: int, last: int) -> np.ndarray:
        edges = self.edges[first : last + 1] - self.edges[first]
        return np.add.reduceat(np.append(x, 0), np.minimum(edges[:-1], len(x))) * (np.diff(edges) > 0) if last > first else np.zeros(0)

    def against(self, i: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Similarity of texts first to last - 1 (all) with text i."""
        last = self.n if last is None else last
        k, v = (x[self.edges[i] : self.edges[i + 1]] for x in (self.keys, self.w))
        if not len(k):
            return np.zeros(last - first)
        keys, w = (x[self.edges[first] : self.edges[last]] for x in (self.keys, self.w))
        at = np.minimum(np.searchsorted(k, keys), len(k) - 1)
        common = self._sums(np.where(k[at] == keys, np.minimum(w, v[at]), 0), first, last)
        return common / np.maximum(self.total[first:last] + self.total[i] - common, 1e-12)


def _chunk_links(table: pa.Table) -> pa.Table:
    """Links found in one chunk of a group: of texts with the lead, and of the others with any."""
    node, lead = table.column("node").to_numpy(), table.column("lead").to_numpy()
    texts = _Weighted(table)
    top = int(np.flatnonzero(node == lead)[0])
    linked = texts.against(top) >= LEAST
    linked[top] = True
    a, b = [node[linked]], [np.full(linked.sum(), node[top])]
    for i in np.flatnonzero(~linked):
        found = np.flatnonzero(texts.against(int(i)) >= LEAST)
        a.append(node[found])
        b.append(np.full(len(found), node[i]))
    a, b = np.concatenate(a), np.concatenate(b)
    other = a != b
    release()
    return pa.table({"a": pa.array(a[other], pa.int64()), "b": pa.array(b[other], pa.int64())})


def _block_links(table: pa.Table) -> pa.Table:
    """Links between the texts of two blocks, or within one, that are not connected yet; of a text one to each class (root) that it is similar to."""
    table = table.sort_by([("block", "ascending"), ("node", "ascending")])
    node, root, block = (table.column(c).to_numpy() for c in ("node", "root", "block"))
    texts = _Weighted(table)
    cut = int(np.searchsorted(block, block[0], side="right"))
    within = table.column("lo")[0].as_py() == table.column("hi")[0].as_py()
    a, b = [], []
    for i in range(cut if block[0] == table.column("lo")[0].as_py() else 0):
        first = i + 1 if within else cut
        total = texts.total[first:]
        # the similarity is at most the lesser total by the greater
        near = (root[first:] != root[i]) & (np.minimum(total, texts.total[i]) >= (LEAST - 1e-9) * np.maximum(total, texts.total[i]))
        at = np.flatnonzero(near)
        if len(at):
            start, stop = first + int(at[0]), first + int(at[-1]) + 1
            found = start + np.flatnonzero((texts.against(i, start, stop) >= LEAST) & near[start - first : stop - first])
            one = found[np.unique(root[found], return_index=True)[1]]
            a.append(node[one])
            b.append(np.full(len(one), node[i]))
    a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b))
    release()
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _leads(live: DataFrame) -> DataFrame:
    """(lead, node, size): each text with the leads of its buckets, from (bucket, n, node, size).

    A bucket of n texts is dealt to one part for each `PART_ROWS` of them: its parts find their best text before the bucket does, and each part is joined with a copy of the lead."""
    support = live.groupBy("node").agg(F.sum("n").alias("support"))
    parts = F.ceil(F.col("n") / PART_ROWS).cast("int")
    ranked = live.join(support, "node").withColumns({"parts": parts, "part": F.pmod(F.xxhash64("node", F.lit(5)), parts).cast("int"), "best": F.struct("support", -F.col("node"))})
    of_parts = ranked.groupBy("bucket", "part", "parts").agg(F.max("best").alias("best"))
    leads = of_parts.groupBy("bucket", "parts").agg(F.max("best").alias("best"))
    copies = leads.select("bucket", (-F.col("best")["col2"]).alias("lead"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return ranked.select("bucket", "part", "node", "size").join(copies, ["bucket", "part"]).select("lead", "node", "size").distinct()


def _links(buckets: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links that connect all similar texts that share a bucket (bucket, its number of texts n, node, size)."""
    pairs = durable(_leads(buckets))
    spread = pairs.groupBy("lead").agg(F.ceil(F.sum("size") / CHUNK_BYTES).cast("int").alias("chunks"))
    placed = pairs.join(spread, "lead").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    to_all = spread.select("lead", F.col("lead").alias("node"), "chunks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    placed = placed.where("lead != node").select("lead", "node", "chunks", "chunk").unionByName(to_all)
    full = placed.join(texts, "node").select("lead", "chunk", "node", "text", "steps")
    found = durable(full.groupBy("lead", "chunk").applyInArrow(_chunk_links, "a long, b long"))
    # only groups in several chunks have texts that were not compared with all others
    wide = durable(spread.where("chunks > 1").select("lead"))
    if not wide.limit(1).count():
        return found
    roots = components(found)
    group = pairs.join(small_enough(wide, BROADCAST_ROWS), "lead").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    group = durable(group)
    top = group.where("node = lead").select("lead", F.col("root").alias("top"))
    apart = F.col("root") != F.col("top")
    group = group.join(top, "lead").withColumn("apart", apart)
    blocks = lambda x: F.ceil(F.coalesce(F.sum(F.when(x, F.col("size"))), F.lit(0)) / BLOCK_BYTES).cast("int")
    split = group.groupBy("lead").agg(blocks(F.col("apart")).alias("apart_blocks"), blocks(~F.col("apart")).alias("own_blocks")).where("apart_blocks > 0")
    group = group.join(split, "lead").withColumn("h", F.xxhash64("node", F.lit(3)))
    group = group.withColumn("block", F.when(F.col("apart"), F.pmod("h", F.col("apart_blocks"))).otherwise(F.col("apart_blocks") + F.pmod("h", F.col("own_blocks"))).cast("int"))
    # pairs of blocks of which one at least is apart: within the lead's class all are connected
    meets = F.when(F.col("apart"), F.col("apart_blocks") + F.col("own_blocks")).otherwise(F.col("apart_blocks"))
    dealt = group.withColumn("x", F.explode(F.sequence(F.lit(0), meets - 1))).select("lead", "node", "root", "block", F.least("block", "x").alias("lo"), F.greatest("block", "x").alias("hi"))
    full = dealt.join(texts, "node").select("lead", "lo", "hi", "block", "node", "root", "text", "steps")
    more = durable(full.groupBy("lead", "lo", "hi").applyInArrow(_block_links, "a long, b long"))
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, component_id, kept."""
    small_batches(docs.sparkSession)
    ids = F.col(key).alias("doc_id")
    base = docs.select(ids, F.col(text).alias("text"), *(h.alias(n) for h, n in zip(hash_pair(F.col(text)), ("t1", "t2"), strict=True)))
    per_hash = base.where("text is not null").select("t1", "t2").distinct().groupBy("t1").agg(F.count("*").alias("n"))
    facts = per_hash.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("texts"), F.count_if(F.col("n") > 1).alias("shared")).first()
    distinct = facts.texts
    if facts.shared:  # some 27 hashes in 10**10 texts; theirs go by the other hash
        several = F.broadcast(per_hash.where("n > 1").select(F.col("t1").alias("_shared")))
        base = base.join(several, F.col("t1") == F.col("_shared"), "left").withColumn("t1", F.when(F.col("_shared").isNull(), F.col("t1")).otherwise(F.col("t2"))).drop("_shared")
    once = base.where("text is not null").select("text", "t1", "t2").mapInArrow(_once, "text string, t1 long, t2 long")
    layout = Layout.of(docs, text, 1)
    blocks = blocked(once, layout, F.col("t1"))

    def block_sets(table: pa.Table):
        t1, t2 = table.column("t1").to_numpy(), table.column("t2").to_numpy()
        first = np.sort(np.unique(np.stack([t1, t2]), axis=1, return_index=True)[1])
        return table.take(pa.array(first))

    def frequencies(table: pa.Table):
        keys, _, _, _ = sets(block_sets(table).column("text"))
        unique, n = np.unique(keys, return_counts=True)
        return [(0, unique, n.astype(np.int64))]

    def sign(left: pa.Table, right: pa.Table) -> pa.Table:
        left = block_sets(left)
        keys, owner, tf, n = sets(left.column("text"))
        unique, inverse = np.unique(keys, return_inverse=True)
        step = idf_step(totals_of(right, 0, len(unique))[inverse], distinct)
        edges = np.searchsorted(owner, np.arange(n + 1))
        has = np.flatnonzero(np.diff(edges))
        band = signatures(keys, owner, weights(tf, step), n)
        squeeze = zstandard.ZstdCompressor(level=1)
        rows = left.take(pa.array(has))
        release()
        size = pa.array([len(x.as_buffer()) for x in _reads(rows.column("text"))], pa.int64())
        return pa.table({
            "node": rows.column("t1"), "t2": rows.column("t2"), "size": size, "bands": pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1) * BANDS, pa.int32()), pa.array(band.view(np.int64).ravel())),
            "steps": pa.array([squeeze.compress(step[edges[i] : edges[i + 1]].tobytes()) for i in has], pa.binary()),
        })

    replies = answers(sent(blocks, layout, frequencies), layout)
    signed = durable(blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(sign, "node long, t2 long, size long, bands array<long>, steps binary"))
    buckets = signed.select("node", "size", F.posexplode("bands").alias("band", "k")).select("node", "size", F.xxhash64("band", "k").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    candidates = durable(buckets.join(shared, "bucket"))
    near = small_enough(durable(candidates.select("node").distinct()), BROADCAST_ROWS)
    # the texts of candidates alone are read again; each once
    wanted = base.where("text is not null").join(near, F.col("t1") == F.col("node"), "left_semi").select("text", "t1", "t2").mapInArrow(_once, "text string, t1 long, t2 long")
    wanted = wanted.groupBy("t1").agg(F.min("text").alias("text")).join(signed.select(F.col("node").alias("t1"), "steps"), "t1").select(F.col("t1").alias("node"), "text", "steps")
    links = _links(candidates, durable(wanted))
    roots = components(links)
    thin = base.select("doc_id", F.when(F.col("text").isNotNull(), F.col("t1")).alias("node"))
    named = thin.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    whole = named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    class_of = whole.select("node", "root").join(names, "root").select("node", "component_id")
    out = thin.join(class_of, "node", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of each class that names it, all columns kept; of rows that repeat its id, the one with the least hash of the text. Rows without id stay.

    Documents are matched with the ids that go, which are fewer than those that stay."""
    ids = classes(docs, key, text).where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    ids = durable(ids.where("not kept or n > 1"))
    gone = small_enough(ids.where("not kept").select(F.col("doc_id").alias("_gone")), BROADCAST_ROWS)
    stay = docs.join(gone, docs[key] == gone["_gone"], "left_anti")
    several = ids.where("kept").select(F.col("doc_id").alias("_id"))
    if not several.limit(1).count():
        return stay
    again = stay.join(small_enough(several, BROADCAST_ROWS), stay[key] == F.col("_id")).groupBy(F.col("_id").alias("_again")).agg(F.min(F.xxhash64(stay[text])).alias("_first"))
    again = durable(again)
    single = stay.join(again, stay[key] == again["_again"], "left_anti")
    repeated = stay.join(again, (stay[key] == again["_again"]) & F.xxhash64(stay[text]).eqNullSafe(again["_first"]), "left_semi").dropDuplicates([key])
    return single.unionByName(repeated)
