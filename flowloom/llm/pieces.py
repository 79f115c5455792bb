"""SentencePiece encoding and decoding, with a max-plus parallel scan over the chunks of giant texts.

The encoding of a BPE model is the one path through the lattice of its pieces on which every two
neighbours are stable: encoding their concatenation gives the two back. With weight 0 for a stable
pair and minus infinity for another it is the heaviest path, so it can be found like a Viterbi path
in the (max, +) semiring. A text of more than `CHUNK` characters is cut at fixed places, anywhere:

1. A chunk's transfer matrix has an entry for each pair of a state at its left and one at its right
   cut. A state is the piece that covers the character before the cut, with its place; margins of the
   longest piece's length let both neighbours name the same states.
2. Matrices are combined by the associative max-plus product up a balanced tree; the states at the
   text's ends are then handed down it, and at each node the state between its two halves is chosen.
3. With its two states known, each chunk finds its own part of the path by itself.

No piece has a word start inside, so all paths meet at word starts. Between its first and last one a
chunk is encoded word by word, each different word once, by the library, and its matrix is the product
of a column (its head) and a row (its tail); only a chunk without a word start runs the whole lattice
here. Other texts are one chunk, from word start to end. The ids are those that the library gives for
the whole text.

Decoding joins the bytes of the pieces; ids of other than text and byte pieces, and bytes that are not
UTF-8, go to the library.

Defined results: null and empty texts have no ids and decode to the empty text; the library reads
U+2581 as a space, so a text that holds it decodes with spaces in its place. Equal giant texts are
encoded once. The model file's path is a parameter; a file that is not BPE is refused.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, fresh, hash_pair, small_batches
from .textbytes import release

CHUNK = 1 << 16
SPACE = "▁"
BATCH_CHARS = 1 << 19
WORDS = 80_000  # words that a process remembers
MINUS = float("-inf")
Span = tuple[int, int]  # first character and the one behind the last, counted from the chunk's left cut


class Coder:
    """A BPE model with what the lattice needs."""

    def __init__(self, model: bytes):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.sp.get_piece_size()
        normal = [i for i in range(n) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i))]
        self.score = {self.sp.id_to_piece(i): self.sp.get_score(i) for i in normal}
        self.ids = {self.sp.id_to_piece(i): i for i in normal}
        self.longest = max(map(len, self.score))
        self.stable_pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, bytes] = {}
        self.table: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("pieces with a word start inside are not supported")

    def merged(self, text: str) -> list[str]:
        """BPE of a short text: join the best-scored neighbours, leftmost first, until none is a piece."""
        parts = list(text)
        while True:
            best = max(((self.score[x + y], -i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)) if x + y in self.score), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def weight(self, left: str, right: str) -> float:
        key = left, right
        if key not in self.stable_pairs:
            if len(self.stable_pairs) > 200_000:
                self.stable_pairs.clear()
            self.stable_pairs[key] = self.merged(left + right) == [left, right]
        return 0.0 if self.stable_pairs[key] else MINUS

    def at(self, text: str, i: int) -> list[str]:
        """Pieces that begin at a place; a character in no piece stands for itself."""
        return [text[i]] + [p for n in range(2, min(self.longest, len(text) - i) + 1) if (p := text[i : i + n]) in self.score]

    def piece_ids(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.sp.piece_to_id(f"<0x{b:02X}>") for b in piece.encode()]

    def middle(self, text: str) -> list[int]:
        """Ids of a part that begins with a word start."""
        return self.sp.encode(text[1:].replace(SPACE, " ")) if len(text) > 1 else self.piece_ids(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts, as 32-bit numbers. Words are encoded once; a text with runs of spaces goes to the library as it is."""
        plain = [not ("  " in t or t[:1] == " " or t[-1:] == " " or SPACE in t) for t in texts]
        split = [t.split(" ") if p else [] for t, p in zip(texts, plain, strict=True)]
        if len(self.words) > WORDS:
            self.words.clear()
        known = self.words
        new = list({w for words in split for w in words if w not in known})
        for w, ids in zip(new, self.sp.encode(new, num_threads=1), strict=True):
            known[w] = np.array(ids, np.int32).tobytes()
        return [b"".join([known[w] for w in words]) if p else np.array(self.sp.encode(t), np.int32).tobytes() for t, words, p in zip(texts, split, plain, strict=True)]

    def _bytes_of_pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first byte, length, all bytes) of the pieces; a length of -1 where the library decides."""
        if self.table is None:
            raw = []
            for i in range(self.sp.get_piece_size()):
                piece = self.sp.id_to_piece(i)
                other = self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i)
                raw.append(None if other else bytes([int(piece[3:5], 16)]) if self.sp.is_byte(i) else piece.replace(SPACE, " ").encode())
            size = np.array([-1 if x is None else len(x) for x in raw], np.int64)
            first = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
            self.table = first, size, np.frombuffer(b"".join(x or b"" for x in raw), np.uint8)
        return self.table

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> pa.Array:
        """Texts of lists of ids: list i is ids[edges[i]:edges[i + 1]]."""
        first, size, flat = self._bytes_of_pieces()
        n = len(edges) - 1
        odd = (ids < 0) | (ids >= len(size))
        safe = np.where(odd, 0, ids)
        length = size[safe]
        odd |= length < 0
        length = np.where(odd, 0, length)
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) - np.repeat(ends - length, length) + np.repeat(first[safe], length)
        data = flat[at]
        edge = np.concatenate([[0], ends])[edges]
        # the space that stands for the start of the text is not part of it
        lead = (edge[1:] > edge[:-1]) & (np.append(data, 0)[np.minimum(edge[:-1], total)] == 32)
        begin, end = edge[:-1] + lead, edge[1:]
        bad = np.concatenate([[0], np.cumsum(odd)])
        strange = bad[edges[1:]] > bad[edges[:-1]]
        out: list[str] = []
        raw = data.tobytes()
        for i in range(n):
            try:
                text = None if strange[i] else raw[begin[i] : end[i]].decode()
            except UnicodeDecodeError:
                text = None
            out.append(self.sp.decode(ids[edges[i] : edges[i + 1]].tolist()) if text is None else text)
        return pa.array(out, pa.string())


class Chunk:
    """A chunk with margins: `text` holds `left` characters before the left cut, then `size`, then the right margin."""

    def __init__(self, coder: Coder, text: str, left: int, size: int, is_first: bool, is_last: bool):
        self.coder, self.text, self.left, self.end = coder, text, left, left + size
        self.is_first, self.is_last = is_first, is_last
        starts = self._word_starts()
        self.first, self.final = (starts[0], starts[-1]) if starts else (None, None)

    def _word_starts(self) -> list[int]:
        """The first and the last word start in the chunk."""
        out = []
        for step in (1, -1):
            places = range(self.left, self.end) if step == 1 else range(self.end - 1, self.left - 1, -1)
            i = next((i for i in places if self.text[i] == SPACE and (i == 0 or self.text[i - 1] != SPACE)), None)
            if i is None:
                return []
            out.append(i)
        return out

    def states(self, cut: int) -> list[Span]:
        """Pieces that cover the character before a cut."""
        return [(i, i + len(p)) for i in range(max(0, cut - self.coder.longest), cut) for p in self.coder.at(self.text, i) if i + len(p) >= cut]

    def _spans(self, span: Span) -> str:
        return self.text[span[0] : span[1]]

    def lattice(self, begin: list[Span], stop: int, ends: list[Span] | None) -> tuple[dict, dict]:
        """From each of the spans `begin`, the weight of the best path to each of `ends`, or (None) to any that ends at `stop`. Returns ({(from, to): weight}, {(from, to): span before}) along best paths."""
        text, coder = self.text, self.coder
        waiting: dict[int, set[Span]] = {}
        best: dict[tuple[Span, Span], float] = {}
        before: dict[tuple[Span, Span], Span] = {}
        sources: dict[Span, set[Span]] = {}
        for b in begin:
            best[b, b] = 0.0
            sources.setdefault(b, set()).add(b)
            waiting.setdefault(b[1], set()).add(b)
        for i in range(min(waiting, default=stop), stop):
            for last in sorted(waiting.pop(i, ())):
                for p in coder.at(text, i):
                    to = (i, i + len(p))
                    w = coder.weight(self._spans(last), p) if last[0] < last[1] else 0.0
                    if w == MINUS or (ends is None and to[1] > stop):
                        continue
                    for b in sources[last]:
                        total = best[b, last] + w
                        if total > best.get((b, to), MINUS):
                            best[b, to], before[b, to] = total, last
                            sources.setdefault(to, set()).add(b)
                    waiting.setdefault(to[1], set()).add(to)
        return best, before

    def matrix(self) -> dict[tuple[Span, Span], float]:
        """Weights from the states at the left cut to those at the right, places counted from the left cut."""
        a, b = self.left, self.end
        entry = [(a, a)] if self.is_first else self.states(a)
        exits = [(b, b)] if self.is_last else self.states(b)
        shift = lambda s: (s[0] - a, s[1] - a)
        if self.first is None:
            best, _ = self.lattice(entry, b, None if self.is_last else exits)
            if self.is_last:
                return {(shift(s), shift((b, b))): w for (s, t), w in best.items() if t[1] == b}
            return {(shift(s), shift(t)): w for (s, t), w in best.items() if t in set(exits)}
        head, _ = self.lattice(entry, self.first, None)
        column = {s: max(w for (x, t), w in head.items() if x == s and t[1] == self.first) for s in entry if any(x == s and t[1] == self.first for x, t in head)}
        if self.is_last:
            row = {(b, b): 0.0}
        else:
            tail, _ = self.lattice([(self.final, self.final)], b, exits)
            row = {t: w for (_, t), w in tail.items() if t in set(exits)}
        return {(shift(s), shift(t)): v + w for s, v in column.items() for t, w in row.items()}

    def path(self, entry: Span, leave: Span) -> list[int]:
        """Ids of the pieces that begin in the chunk, given the states at its cuts."""
        a, b = self.left, self.end
        entry, leave = (entry[0] + a, entry[1] + a), (leave[0] + a, leave[1] + a)
        out: list[int] = []

        def walk(begin: Span, stop: int, ends: list[Span] | None) -> list[Span]:
            best, before = self.lattice([begin], stop, ends)
            to = max((t for x, t in best if (t[1] == stop if ends is None else t == ends[0])), key=lambda t: best[begin, t])
            spans = []
            while to != begin:
                spans.append(to)
                to = before[begin, to]
            return spans[::-1]

        def add(spans: list[Span]) -> None:
            for s in spans:
                out.extend(self.coder.piece_ids(self._spans(s)))

        if self.first is None:
            add(walk(entry, b, None if self.is_last else [leave]))
            return out
        add(walk(entry, self.first, None))
        stop = b if self.is_last else self.final
        if stop > self.first:
            out.extend(self.coder.middle(self.text[self.first : stop]))
        if not self.is_last:
            add(walk((self.final, self.final), b, [leave]))
        return out


def product(a: dict, b: dict) -> dict:
    """Max-plus product of two transfer matrices; the second's states are named like the first's right ones."""
    rows: dict = {}
    for (k, j), w in b.items():
        rows.setdefault(k, []).append((j, w))
    out: dict = {}
    for (i, k), v in a.items():
        for j, w in rows.get(k, ()):
            if v + w > out.get((i, j), MINUS):
                out[i, j] = v + w
    return out


def cut_states(matrices: list[dict], sizes: list[int]) -> list[tuple[Span, Span]]:
    """The states at both cuts of each chunk, each in the chunk's own places: products are combined up a balanced tree, and states handed down it."""
    move = lambda s, n: (s[0] - n, s[1] - n)
    # right states renamed to the next chunk's places
    level = [{(i, move(j, n)): w for (i, j), w in m.items()} for m, n in zip(matrices, sizes, strict=True)]
    tree = [level]
    while len(level) > 1:
        level = [product(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        tree.append(level)
    # a node's states at its outer cuts are known; the one between its children is where their weights are greatest
    known = [max(tree[-1][0], key=tree[-1][0].get)]
    for level in reversed(tree[:-1]):
        below: list[tuple[Span, Span]] = []
        for k, (left, right) in enumerate(known):
            if 2 * k + 1 == len(level):
                below.append((left, right))
                continue
            a, b = level[2 * k], level[2 * k + 1]
            middle = max((j for i, j in a if i == left and (j, right) in b), key=lambda j: a[left, j] + b[j, right])
            below += [(left, middle), (middle, right)]
        known = below
    return [(i, move(j, -n)) for (i, j), n in zip(known, sizes, strict=True)]


def chunks_of(text: str, longest: int, size: int = CHUNK):
    """(text with margins, left margin, size, first?, last?) of each chunk."""
    text = SPACE + text.replace(" ", SPACE)
    for a in range(0, len(text), size):
        b = min(a + size, len(text))
        lo = max(0, a - longest)
        yield text[lo : b + longest], a - lo, b - a, a == 0, b == len(text)


def encode_by_chunks(coder: Coder, text: str, size: int) -> list[int]:
    """The whole scan in one place, for tests and short texts."""
    if not text:
        return []
    parts = [Chunk(coder, *x) for x in chunks_of(text, coder.longest, size)]
    states = cut_states([c.matrix() for c in parts], [c.end - c.left for c in parts])
    return [i for c, s in zip(parts, states, strict=True) for i in c.path(*s)]


_CODERS: dict[int, Coder] = {}


def _coder(shared) -> Coder:
    key = shared.id if hasattr(shared, "id") else id(shared)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(shared.value)
    return _CODERS[key]


def _lists(rows: list[bytes]) -> pa.Array:
    edges = np.cumsum([0, *(len(x) // 4 for x in rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def _batches(batch: pa.RecordBatch, lengths: np.ndarray, most: int):
    """Slices of a batch of about `most` characters or ids."""
    total = np.concatenate([[0], np.cumsum(np.maximum(lengths, 1))])
    at = 0
    while at < len(lengths):
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def encode(docs: DataFrame, model_path: str, text: str = "text", chunk: int = CHUNK) -> tuple[DataFrame, str, str]:
    """docs with two more columns, the ids (array<int>) of the text and whether they decode to it; and those columns' names.

    Ids are decoded where they are made, so that neither they nor the texts travel once more."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(model_path, "rb") as f:  # on the driver; executors get the bytes
        shared = spark.sparkContext.broadcast(f.read())
    name = fresh(docs, "ids")
    same = fresh(docs, "round_trip")
    schema = docs.withColumns({name: F.lit(None).cast("array<int>"), same: F.lit(None).cast("boolean")}).schema
    column = docs.columns.index(text)
    ordinary = F.coalesce(F.length(text), F.lit(0)) <= chunk

    def plain(batches):
        coder = _coder(shared)
        for batch in batches:
            lengths = pa.compute.fill_null(pa.compute.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
            for part in _batches(batch, lengths, BATCH_CHARS):
                texts = [x or "" for x in part.column(column).to_pylist()]
                lists = _lists(coder.encode(texts))
                back = coder.decode(lists.values.to_numpy(), lists.offsets.to_numpy()).to_pylist()
                good = [a == b.replace(SPACE, " ") for a, b in zip(back, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(good, pa.bool_())], names=schema.names)
            release()

    out = docs.where(ordinary).mapInArrow(plain, schema)
    giants = docs.where(~ordinary)
    key1, key2 = fresh(docs, "giant_1"), fresh(docs, "giant_2")
    marked = giants.withColumns(dict(zip((key1, key2), hash_pair(F.col(text)), strict=True)))
    ids = _giants(marked.select(F.col(key1).alias("g1"), F.col(key2).alias("g2"), F.col(text).alias("text")), shared, chunk).withColumnRenamed("ids", name)
    long_rows = marked.join(ids, (marked[key1] == ids["g1"]) & (marked[key2] == ids["g2"])).select(*[marked[c] for c in docs.columns], ids[name])
    back = decoder(spark, model_path)(F.col(name))
    return out.unionByName(long_rows.withColumn(same, back == F.translate(F.col(text), SPACE, " "))), name, same


def _giants(texts: DataFrame, shared, size: int) -> DataFrame:
    """g1, g2, ids of giant texts: matrices by chunk, their scan by text, paths by chunk."""

    def cut(batches):
        longest = _coder(shared).longest
        for batch in batches:
            for g1, g2, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k, (body, left, n, first, last) in enumerate(chunks_of(text, longest, size)):
                    values = {"g1": g1, "g2": g2, "k": k, "body": body, "lead": left, "n": n, "first": first, "last": last}
                    yield pa.RecordBatch.from_pylist([values], schema=kinds)

    kinds = pa.schema([("g1", pa.int64()), ("g2", pa.int64()), ("k", pa.int32()), ("body", pa.string()), ("lead", pa.int32()), ("n", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_())])

    def chunk(row: dict) -> Chunk:
        return Chunk(_coder(shared), row["body"], row["lead"], row["n"], row["first"], row["last"])

    def matrices(batches):
        for batch in batches:
            rows = batch.to_pylist()
            out = [json.dumps([[*s, *t, w] for (s, t), w in chunk(r).matrix().items()]) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("g1"), batch.column("g2"), batch.column("k"), batch.column("n"), pa.array(out, pa.string())], ["g1", "g2", "k", "n", "matrix"])

    def scan(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["k"])
        found = cut_states([{((a, b), (c, d)): w for a, b, c, d, w in json.loads(r["matrix"])} for r in rows], [r["n"] for r in rows])
        flat = [[*s, *t] for s, t in found]
        return pa.table({"g1": [r["g1"] for r in rows], "g2": [r["g2"] for r in rows], "k": pa.array([r["k"] for r in rows], pa.int32()), "states": pa.array(flat, pa.list_(pa.int32()))})

    def paths(batches):
        for batch in batches:
            rows = batch.to_pylist()
            ids = [np.array(chunk(r).path(tuple(r["states"][:2]), tuple(r["states"][2:])), np.int32).tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("g1"), batch.column("g2"), batch.column("k"), _lists(ids)], ["g1", "g2", "k", "ids"])

    fields = "g1 long, g2 long, k int, body string, lead int, n int, first boolean, last boolean"
    parts = durable(texts.mapInArrow(cut, fields).dropDuplicates(["g1", "g2", "k"]))  # the chunks of a text are dealt to many tasks
    states = parts.mapInArrow(matrices, "g1 long, g2 long, k int, n int, matrix string").groupBy("g1", "g2").applyInArrow(scan, "g1 long, g2 long, k int, states array<int>")
    ids = parts.join(states, ["g1", "g2", "k"]).mapInArrow(paths, "g1 long, g2 long, k int, ids array<int>")
    return ids.groupBy("g1", "g2").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))


def decoder(spark, model_path: str):
    """A function from a column of ids to the text."""
    with open(model_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        coder = _coder(shared)
        batch = pa.RecordBatch.from_arrays([column], ["ids"])
        lengths = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
        out = []
        for part in _batches(batch, lengths, BATCH_CHARS):
            lists = part.column(0)
            size = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            out.append(coder.decode(lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)])))
        release()
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    return decode
