import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from pyspark.sql import functions as F

from flowloom.llm import decontam, gather, minhash
from flowloom.llm.common import hash_pair
from flowloom.llm.components import components
from flowloom.llm.queries import ORACLE_SQL, QUERIES
from tests import oracle


def words(text):
    raw = bytes(x + 32 if 65 <= x <= 90 else x for x in (text or "").encode())
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw)


def shingle_counts(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter()


def classes_by_brute_force(rows):
    texts = sorted({t for _, t in rows if t is not None})
    sets = [shingle_counts(t) for t in texts]
    df = Counter(s for x in sets for s in x)
    top = max(math.log((1 + len(texts)) / 2) or 1.0, 1e-9)
    weight = {s: 1 + minhash.IDF * np.clip(np.rint(minhash.STEPS * math.log((1 + len(texts)) / (1 + n)) / top), 0, minhash.STEPS) / minhash.STEPS for s, n in df.items()}
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(texts)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y:
                both = sum(min(x[s], y[s]) * weight[s] for s in x if s in y)
                total = sum(n * weight[s] for s, n in x.items()) + sum(n * weight[s] for s, n in y.items())
                if both / (total - both) >= minhash.LEAST:
                    root[find(a)] = find(b)
    least = {}
    place = {t: find(i) for i, t in enumerate(texts)}
    for i, t in rows:
        if t is not None and i is not None:
            least[place[t]] = min(least.get(place[t], i), i)
    return sorted(((i, i if t is None else least.get(place[t])) for i, t in rows), key=str)


def prose(r, n):
    return " ".join("".join(r.choice(["an", "er", "th", "on", "re", "ing"]) for _ in range(r.randint(1, 4))) for _ in range(n))


def edited(r, text, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = prose(r, 1) + "x"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    out = []
    for k in range(14):
        base = prose(r, 150)
        out += [base] + [edited(r, base, k % 4 + 1) for _ in range(k % 5)]
    hub = prose(r, 200)
    out += [hub] + [edited(r, hub, 1) for _ in range(30)] + [out[0]] * 12
    out += [None, None, "", "", "!!", "??", "one", "one", "Two words", "two, words", "é " * 4, "same word " * 500, prose(r, 20000)]
    order = list(enumerate(out))
    r.shuffle(order)
    return [(i, t) for i, t in order] + [(3, out[3]), (None, out[0])]


@pytest.mark.parametrize("chunk", [1 << 20, 4000])
def test_classes_equal_brute_force(spark, docs, rows, monkeypatch, chunk):
    monkeypatch.setattr(minhash, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(gather, "BLOCK_BYTES", 20000)
    monkeypatch.setattr(gather, "BUCKET_KEYS", 500)
    monkeypatch.setattr(gather, "GROUP_BLOCKS", 3 if chunk == 4000 else 4096)
    monkeypatch.setattr(minhash, "PART_ROWS", 5 if chunk == 4000 else 1024)
    got = minhash.classes(docs(rows)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == classes_by_brute_force(rows)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)


def linked_only_apart(r, n=24):
    """Texts in one bucket family: copies of a hub, a chain that leads away from it, and two families that are far from the hub."""
    hub = prose(r, 240).split()

    def changed(base, n, far=0):
        w = list(base)
        for i in range(n):
            w[far + 8 * i] = prose(r, 1) + "y"
        return w

    out = [hub] + [changed(hub, 1, 8 * k % 232) for k in range(n)]
    step = hub
    for k in range(8):  # each two edits beyond the one before
        step = changed(step, 2, 16 * k)
        out.append(step)
    for k in range(3):
        base = changed(hub, 9, 60 * k)
        out += [base] + [changed(base, 1, 8 * j) for j in range(n // 4)]
    return [" ".join(w) for w in out]


def similar_classes(texts):
    """Classes of texts by shingle counts alone, all pairs compared."""
    sets = [shingle_counts(t) for t in texts]
    root = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            both = sum((x & y).values())
            if both / (sum(x.values()) + sum(y.values()) - both) >= minhash.LEAST and root[i] != root[j]:
                root = [root[j] if k == root[i] else k for k in root]
    return {frozenset(i for i, k in enumerate(root) if k == one) for one in root}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_no_link_of_a_bucket_in_several_chunks_is_lost(spark, monkeypatch, seed):
    monkeypatch.setattr(minhash, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 9000, raising=False)
    r = random.Random(seed)
    texts = linked_only_apart(r)
    r.shuffle(texts)
    squeeze = zstandard.ZstdCompressor()
    even = [squeeze.compress(bytes(len(minhash.sets(pa.array([t]))[0]))) for t in texts]
    made = spark.createDataFrame([(i, t, bytearray(x)) for i, (t, x) in enumerate(zip(texts, even, strict=True))], "node long, text string, steps binary")
    buckets = spark.createDataFrame([(1, len(texts), i, len(t)) for i, t in enumerate(texts)], "bucket long, n long, node long, size long")
    root = {r.node: r.root for r in components(minhash._links(buckets, made)).collect()}
    whole = [root.get(i, i) for i in range(len(texts))]
    assert {frozenset(i for i, k in enumerate(whole) if k == one) for one in whole} == similar_classes(texts)


def test_texts_that_share_a_hash(docs, rows, monkeypatch):
    # the first hash tells texts of one first letter apart by nothing
    monkeypatch.setattr(minhash, "hash_pair", lambda c: (F.xxhash64(F.substring(c, 1, 1)), F.xxhash64(F.lit(7), c)))
    got = minhash.classes(docs(rows)).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=str) == classes_by_brute_force(rows)


def test_the_second_hash_is_not_a_function_of_the_first(spark):
    h1, h2 = hash_pair(F.col("x"))
    r = spark.createDataFrame([("some text",)], "x string").select(h1.alias("a"), h2.alias("b"), F.xxhash64("x", F.lit(7)).alias("chained")).first()
    from_first = spark.createDataFrame([(r.a,)], "a long")
    assert r.b != r.chained and r.b not in set(from_first.select(F.xxhash64("a"), F.xxhash64(F.lit(7), "a"), F.xxhash64("a", F.lit(7))).first())


def test_one_row_of_each_class_stays(docs, rows, with_clashes):
    df = with_clashes(docs(rows))
    kept = minhash.representatives(df)
    assert kept.columns == df.columns
    want = Counter(c for c in {c for _, c in classes_by_brute_force(rows)} if c is not None)
    got = [r.doc_id for r in kept.collect()]
    assert Counter(i for i in got if i is not None) == want and got.count(None) == 1


def test_nothing_to_compare(docs):
    empty = docs([(1, "a")]).limit(0)
    assert minhash.classes(empty).count() == 0 and minhash.representatives(empty).count() == 0
    assert {(r.doc_id, r.component_id, r.kept) for r in minhash.classes(docs([(1, None), (2, "")])).collect()} == {(1, 1, True), (2, 2, True)}


def test_samples_agree_as_often_as_texts_are_similar():
    r = np.random.default_rng(1)
    keys = np.sort(r.choice(2**40, 400, replace=False).astype(np.uint64))
    w = r.uniform(1, 2, 400)
    text = np.zeros(400, np.int64)
    a = minhash.signatures(keys[:300], text[:300], w[:300], 1)
    assert (a == minhash.signatures(keys[:300], text[:300], w[:300], 1)).all()
    agree = []
    for seed in range(120):
        shifted = np.sort(minhash.mix(keys + np.uint64(seed)))
        x, y = (minhash.signatures(shifted[s], text[s], w[s], 1)[0] for s in (slice(0, 380), slice(20, 400)))
        agree.append((x == y).mean())
    s = w[20:380].sum() / w.sum()
    assert abs(np.mean(agree) - s**minhash.ROWS) < 0.08


# -- decontamination


def contamination_by_brute_force(texts, items):
    windows = {}
    for item, t in items:
        w = words(t)
        n = min(len(w), 13)
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault((n, tuple(w[i : i + n])), set()).add(item)
    out = []
    for i, t in texts:
        w, hit, found = words(t), set(), set()
        for (n, gram), names in windows.items():
            for k in range(len(w) - n + 1):
                if w[k] == gram[0] and tuple(w[k : k + n]) == gram:
                    hit |= set(range(k, k + n))
                    found |= names
        out.append((i, len(w), len(hit), len({x for x in found if x is not None})))
    return sorted(out, key=str)


def made(spark, docs, texts, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in decontam.contamination(docs(texts), bench).collect()), key=str)


def passages(seed, shortest):
    r = random.Random(seed)
    items = [(i, prose(r, r.choice([shortest, 13, 14, 30, 60]))) for i in range(12)]
    items += [(20, items[0][1]), (None, items[1][1]), (21, None), (22, ""), (23, "... !"), (24, items[2][1].upper())]
    texts = []
    for i in range(40):
        t = prose(r, r.randint(0, 60)).split()
        if i % 2:
            w = (r.choice(items[:12])[1]).split()
            a = r.randrange(len(w))
            cut = w[a : a + r.choice([12, 13, 14, 40])]
            at = r.randrange(len(t) + 1)
            t[at:at] = [x.capitalize() + "," if r.random() < 0.3 else x for x in cut]
        texts.append((i, " ".join(t)))
    texts += [(50, None), (51, ""), (52, items[0][1] + "\n" + items[1][1]), (52, items[0][1] + "\n" + items[1][1]), (53, (items[0][1] + " ") * 30), (54, prose(r, 5000)), (None, items[3][1]), (55, "É " * 20), (56, "é " * 20)]
    return texts, items + [(30, "É " * 14)]


@pytest.mark.parametrize(("seed", "shortest"), [(1, 13), (2, 12), (3, 5), (4, 3), (5, 1)])
def test_contamination_equals_brute_force(spark, docs, seed, shortest):
    texts, items = passages(seed, shortest)
    assert made(spark, docs, texts, items) == contamination_by_brute_force(texts, items)


def test_passages_in_capital_greek(spark, docs):
    words_ = [f"ΛΟΓΟΣ ΤΗΣ{k}Α ΠΟΛΕΩΣ" for k in range(6)]
    items, texts = [(1, " ".join(words_))], [(k, " ".join(words_).replace(" ", mark) + " and more words behind") for k, mark in ((1, "."), (2, "'"))] + [(3, "ΠΟΛΕΩΣ")]
    got = made(spark, docs, texts, items)
    assert got == contamination_by_brute_force(texts, items) and [x[2] for x in got] == [18, 18, 0]


def test_large_sides_are_shuffled(spark, docs, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 3)
    texts, items = passages(6, 7)
    assert made(spark, docs, texts, items) == contamination_by_brute_force(texts, items)


def test_no_items_and_no_documents(spark, docs):
    assert made(spark, docs, [(1, "a b c"), (2, None)], []) == [(1, 3, 0, 0), (2, 0, 0, 0)]
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontam.contamination(docs([(1, "a")]).limit(0), bench).count() == 0


def test_clean_rows_stay_as_they_are(spark, docs, with_clashes):
    texts, items = passages(8, 13)
    df = with_clashes(docs(texts))
    out = decontam.clean(df, spark.createDataFrame(items, "item_id long, text string"))
    assert out.columns == df.columns
    bad = Counter(i for i, n, hit, _ in contamination_by_brute_force(texts, items) if hit and 20 * hit >= n)
    assert Counter(r.doc_id for r in out.collect()) == Counter(i for i, _ in texts) - bad


def test_decontamination_query_equals_sql(spark):
    oracle.check(spark, QUERIES["op8_decontamination"], ORACLE_SQL["op8_decontamination"])
