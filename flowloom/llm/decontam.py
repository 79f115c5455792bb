"""Benchmark decontamination by winnowing, with DataFrame functions only.

A window is `SPAN` consecutive words of an item; an item of fewer words, but not none, is one
window. A document word inside any occurrence of a window is hit.

1. Fingerprints: every text's words are hashed, combined to `GRAM`-word hashes, and the least hash
   of every `SPAN - GRAM + 1` consecutive ones is kept. Any span of SPAN words that two texts share
   holds such a run of grams in both, so its least hash is a fingerprint of both: no shared window is
   missed. Items of fewer words have no full run; for them one gram (all of it if shorter) is the
   fingerprint, and all grams of that length are the document's, computed only if there are such items.
2. Join of document and item fingerprints. It only says which documents can hold a window. The item
   side is broadcast up to `BROADCAST_ROWS` rows and shuffled beyond; a document's fingerprints are
   summed up in the task that made them before anything is shuffled.
3. Extension of the hits in these documents: their windows (word hashes of 128 bits) are joined with
   the item windows; the words covered are the union of the occurrences, found by a running maximum
   of ends within the document.

A window that many items share is one row of the window table; its items are joined after the
document's distinct windows are known.

Defined results: null and texts without words have n_words 0, no hits, and are not contaminated;
items without words or with a null text have no windows; repeated document rows give repeated
results; rows of one item_id are one item; an item without id hits words but is not listed.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, hash_pair, small_enough

SPAN = 13
GRAM = 6
#: rows of a side that is broadcast; they are at most five numbers wide, about 64 bytes each in the executors' table, so 8 MB
BROADCAST_ROWS = 125_000
#: runs of ASCII letters and digits and of all other characters beyond ASCII (of a text with A-Z lower-cased)
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased. Not lower(): the case of a capital sigma there depends on what follows the word."""
    folded = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(F.coalesce(folded, F.lit("")), F.lit(WORD), F.lit(0))


def _doubled(df: DataFrame, array: str, steps: list[int], join) -> DataFrame:
    """Combine each element with the one `step` behind it, for each step. The last elements lack successors and stand for shorter runs, which only adds fingerprints.

    Each step is a projection of its own: an expression that used the step before twice would repeat its work."""
    for step in steps:
        df = df.withColumn(array, F.zip_with(array, F.slice(array, 1 + step, 1 << 30), join))
    return df


def _hash2(x: Column, y: Column) -> Column:
    return F.xxhash64(x, y)


#: how the n-word grams are put together from single words
_STEPS = {1: [], 2: [1], 3: [1, 1], 4: [1, 2], 5: [1, 2, 1], 6: [1, 2, 2]}


def with_grams(df: DataFrame, words: str, n: int, name: str) -> DataFrame:
    """Hashes of n-word runs, 1 <= n <= 6, one for each word; runs that pass the end are cut."""
    return _doubled(df.withColumn(name, F.transform(words, lambda w: F.xxhash64(w))), name, _STEPS[n], _hash2)


def with_fingerprints(df: DataFrame, words: str, short: list[int], name: str) -> DataFrame:
    """Winnowed fingerprints, and all grams of the lengths in `short`."""
    assert SPAN - GRAM + 1 == 8  # the steps below cover eight grams
    df = _doubled(with_grams(df, words, GRAM, name), name, [1, 2, 4], lambda x, y: F.least(x, y))
    for n in short:
        df = with_grams(df, words, n, f"{name}_{n}").withColumn(name, F.concat(name, f"{name}_{n}")).drop(f"{name}_{n}")
    return df.withColumn(name, F.array_distinct(name))


def _windows(words: Column, n: Column) -> Column:
    """Array of (first word, 128-bit hash) of all runs of n words."""
    last = F.size(words) - n
    at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("at"), *(h.alias(k) for h, k in zip(hash_pair(F.slice(words, i + 1, n)), ("k1", "k2"), strict=True))))


def _small(df: DataFrame) -> DataFrame:
    """df marked for broadcast if its rows, of a few numbers each, are few."""
    return small_enough(df, BROADCAST_ROWS)


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document row: doc_id, t1, t2 (hashes of the text), n_words, n_hit, n_items, items_sha256."""
    bench = items.select(F.col(item_key).cast("string").alias("item"), F.col(item_text).alias("text"))
    bench = durable(bench.select("item", words_of(F.col("text")).alias("words")).where(F.size("words") > 0))
    lengths = [r.n for r in bench.select(F.least(F.size("words"), F.lit(SPAN)).alias("n")).distinct().collect()]
    short = sorted({min(n, GRAM) for n in lengths if n < SPAN})
    full = with_fingerprints(bench.where(F.size("words") >= SPAN), "words", [], "fps").select(F.explode("fps").alias("fp"))
    for n in short:
        has = (F.size("words") < SPAN) & (F.least(F.size("words"), F.lit(GRAM)) == n)
        full = full.unionByName(with_grams(bench.where(has), "words", n, "grams").select(F.element_at("grams", 1).alias("fp")))
    marks = durable(full.distinct().withColumn("mark", F.lit(1)))

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).withColumns(dict(zip(("t1", "t2"), hash_pair(F.col("text")), strict=True)))
    made = rows.select("doc_id", "t1", "t2", words_of(F.col("text")).alias("words"))
    made = with_fingerprints(made.withColumn("n_words", F.size("words")), "words", short, "fps")
    made = made.select("doc_id", "t1", "t2", "n_words", F.posexplode_outer("fps").alias("pos", "fp"))
    same = ["doc_id", "t1", "t2"]
    facts = made.join(_small(marks), "fp", "left").groupBy(*same, "n_words").agg(F.count(F.when(F.coalesce(F.col("pos"), F.lit(0)) == 0, 1)).alias("copies"), F.max("mark").alias("mark"))
    facts = durable(facts)
    suspects = facts.where("mark = 1").select(*same)

    one = rows.join(_small(suspects), [rows[c].eqNullSafe(suspects[c]) for c in same], "left_semi").dropDuplicates(same)
    one = one.select(*same, words_of(F.col("text")).alias("words"))
    runs = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")
    spots = one.select(*same, "words", F.explode(runs).alias("n")).select(*same, "n", F.inline(_windows(F.col("words"), F.col("n"))))
    wins = bench.select("item", "words", F.least(F.size("words"), F.lit(SPAN)).alias("n")).select("item", "n", F.inline(_windows(F.col("words"), F.col("n")))).select("item", "n", "k1", "k2").distinct()
    known = wins.select("n", "k1", "k2").distinct()
    hits = durable(spots.join(_small(known), ["n", "k1", "k2"]))

    ends = hits.groupBy(*same, "at").agg(F.max(F.col("at") + F.col("n")).alias("end"))
    reach = F.max("end").over(Window.partitionBy(*same).orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    covered = ends.withColumn("reach", F.coalesce(reach, F.lit(0))).groupBy(*same).agg(F.sum(F.greatest(F.col("end") - F.greatest("at", "reach"), F.lit(0))).alias("n_hit"))
    listed = hits.select(*same, "n", "k1", "k2").distinct().join(_small(wins.where("item is not null")), ["n", "k1", "k2"]).select(*same, "item").distinct()
    listed = listed.groupBy(*same).agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("ids"))

    out = facts
    for part in (covered, listed):
        fields = [c for c in part.columns if c not in same]
        part = part.select(*(F.col(c).alias(f"r_{c}") for c in same), *fields)
        out = out.join(part, [out[c].eqNullSafe(part[f"r_{c}"]) for c in same], "left").drop(*(f"r_{c}" for c in same))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(
        *same, F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
    )


def contaminated() -> Column:
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that are not contaminated, all columns kept."""
    bad = contamination(docs, items, key, text).where(contaminated()).select(F.col("doc_id").alias("_bad_id"), F.col("t1").alias("_bad_1"), F.col("t2").alias("_bad_2")).distinct()
    bad = durable(bad)
    t1, t2 = hash_pair(docs[text])
    same = docs[key].eqNullSafe(bad["_bad_id"]) & (t1 == bad["_bad_1"]) & (t2 == bad["_bad_2"])
    return docs.join(_small(bad), same, "left_anti")


_TOKENS = f"regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce({_TOKENS}, []) AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_TOKENS} AS w FROM benchmark WHERE text IS NOT NULL),
n AS (SELECT DISTINCT least(len(w), {SPAN}) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, list_slice(w, i, i + n - 1) AS g
       FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT item, w, least(len(w), {SPAN}) AS n FROM b WHERE len(w) > 0))),
dw AS (SELECT r, n, i, list_slice(w, i, i + n - 1) AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN n WHERE len(w) >= n)),
h AS (SELECT dw.r, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
l AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(l.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l.ids, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN l USING (r)
"""
