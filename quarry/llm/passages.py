r"""Substring dedup: fuzzy passages by collinear chaining of shared k-mer seeds.

Seeds are closed syncmers: runs of five words whose least word is the first or
the last, two in five of all. Each seed that occurs in several texts is tied to its
first holder (the least text id), never to all others, so a passage that a million
texts share makes a million anchors. Anchors of one pair of texts are merged
into runs on a diagonal; runs are chained in order in both texts with gap costs, the
best predecessor within the greatest gap found through a tree of range maxima;
chains are extended over replaced, inserted and deleted words and aligned word by
word (banded edit distance), and passages of ``min_words`` or more with enough equal
words are returned. Equal texts are chained once, as one text.

The pieces of a passage may have different first holders, none of which holds it
whole. So where all seeds are shared, every window of ``min_words`` words that does
not lie within the seeds of one first holder is tied to its own first holder:
any ``min_words`` equal words in a row that an earlier text holds are reported with a
text that holds them, without a cap. For passages that differ in words there is no such
promise: they need two shared seeds with a common first holder.

Passages that repeat within one text only are not looked for.

Results for odd input: null and empty texts hold no passages; very long texts are seeded and read whole; documents with
equal texts are reported with their common text's passages, and a copy of
``min_words`` or more is itself a passage of the least doc_id of its text; null
ids are kept as rows; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections import deque
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bound_batches, keep, map_arrow, text_node
from quarry.llm.dartminhash import WORDS, mix64

K = 5
#: Seeds of one diagonal that are no farther apart make one run.
REACH = 20
MIN_WORDS = 50
#: Least share of equal words in an aligned passage.
MIN_EQUAL = 0.8
#: Longest gap between two runs of a chain, and the cost of a word of gap or of shift.
MAX_GAP, GAP_COST = 40, 0.5
#: No predecessor.
NONE = (-1e18, -1)


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode().split()
    return np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k words in a row, put together from runs of powers of two."""
    n = len(h) - k + 1
    if n < 1:
        return h[:0]
    out, done, power, size = np.zeros(n, np.uint64), 0, mix64(h), 1
    while True:
        if k & size:
            out = mix64(out ^ power[done : done + n])
            done += size
        if done == k:
            return out
        power = mix64(mix64(power[:-size]) ^ power[size:])
        size *= 2


def syncmers(h: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the k-mers whose least word is their first or last.

    The choice rests on the k-mer alone, so a changed word near it does not undo
    it; of any ``k - 1`` k-mers in a row one is chosen.
    """
    n = len(h) - k + 1
    if n < 1:
        return h[:0], np.zeros(0, np.int64)
    order = mix64(h)
    inner = order[1 : n + 1]
    for i in range(2, k - 1):
        inner = np.minimum(inner, order[i : n + i])
    at = np.flatnonzero(np.minimum(order[:n], order[k - 1 :]) <= inner)
    return grams(h, k)[at], at


def runs(a: np.ndarray, b: np.ndarray, k: int = K, reach: int = REACH) -> np.ndarray:
    """Anchors (a, b) merged along diagonals: rows (start a, start b, length)."""
    order = np.lexsort((a, b - a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = ((b - a)[1:] != (b - a)[:-1]) | (a[1:] - a[:-1] > reach)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(a)]]) - 1
    return np.stack([a[first], b[first], a[last] - a[first] + k], axis=1)


class RangeMax:
    """Largest (value, item) over a range of ranks; each rank holds its items in falling order of value."""

    def __init__(self, n: int):
        self.n = n
        self.held: list[deque] = [deque() for _ in range(n)]
        self.best: list[tuple[float, int]] = [NONE] * (2 * n)

    def _renew(self, rank: int) -> None:
        i = rank + self.n
        self.best[i] = self.held[rank][0] if self.held[rank] else NONE
        while i > 1:
            i //= 2
            self.best[i] = max(self.best[2 * i], self.best[2 * i + 1])

    def add(self, rank: int, value: tuple[float, int]) -> None:
        held = self.held[rank]
        # an older item of less value leaves earlier and is never the best again
        while held and held[-1] <= value:
            held.pop()
        held.append(value)
        self._renew(rank)

    def drop(self, rank: int, item: int) -> None:
        if self.held[rank] and self.held[rank][0][1] == item:
            self.held[rank].popleft()
            self._renew(rank)

    def top(self, low: int, high: int) -> tuple[float, int]:
        """Over ranks from ``low`` to below ``high``."""
        found, low, high = NONE, low + self.n, high + self.n
        while low < high:
            if low & 1:
                found = max(found, self.best[low])
                low += 1
            if high & 1:
                high -= 1
                found = max(found, self.best[high])
            low, high = low // 2, high // 2
        return found


def chains(found: np.ndarray) -> list[list[int]]:
    """Chains of runs, each ordered in both texts, best first; every run is in one chain.

    A run's score is its length and the best of its predecessors' scores less the
    cost of the words between them, split into the two texts: predecessors are kept
    with score + cost * (end a + end b), so the best is a maximum over a range of end b.
    Those that end more than ``MAX_GAP`` words back in a have left, and the range
    leaves out those that do so in b: a far run never hides a near one.
    """
    order = np.lexsort((found[:, 1], found[:, 0]))
    ends_b = np.unique(found[:, 1] + found[:, 2])
    tree, score, parent = RangeMax(len(ends_b)), {}, {}
    end_a, end_b = found[:, 0] + found[:, 2], found[:, 1] + found[:, 2]
    rank = np.searchsorted(ends_b, end_b).tolist()
    waiting = np.argsort(end_a, kind="stable").tolist()
    w = gone = 0
    for i in order.tolist():
        a, b, n = (int(x) for x in found[i])
        while w < len(waiting) and end_a[waiting[w]] <= a:
            j = waiting[w]
            tree.add(rank[j], (score[j] + GAP_COST * int(end_a[j] + end_b[j]), j))
            w += 1
        while gone < w and end_a[waiting[gone]] < a - MAX_GAP:
            tree.drop(rank[waiting[gone]], waiting[gone])
            gone += 1
        value, j = tree.top(*np.searchsorted(ends_b, [b - MAX_GAP, b + 1]).tolist())
        gain = value - GAP_COST * (a + b)
        score[i], parent[i] = (n + gain, j) if j >= 0 and gain > 0 else (n, -1)
    out, used = [], set()
    for i in sorted(score, key=lambda i: (-score[i], i)):
        links = []
        while i >= 0 and i not in used:
            used.add(i)
            links.append(int(i))
            i = parent[i]
        if links:
            out.append(links[::-1])
    return out


def align(x: np.ndarray, y: np.ndarray) -> int:
    """Equal words in a best alignment of two word sequences: their longest common subsequence, by bit rows."""
    n = min(len(x), len(y))
    same = x[:n] == y[:n]
    head = n if same.all() else int(same.argmin())
    same = x[len(x) - n + head :][::-1] == y[len(y) - n + head :][::-1]
    tail = len(same) if same.all() else int(same.argmin())
    x, y = x[head : len(x) - tail].tolist(), y[head : len(y) - tail].tolist()
    if not x or not y:
        return head + tail
    where: dict[int, int] = {}
    for i, w in enumerate(x):
        where[w] = where.get(w, 0) | 1 << i
    full = row = (1 << len(x)) - 1
    for w in y:
        if found := row & where.get(w, 0):
            row = ((row + found) | (row - found)) & full
    return head + tail + (full ^ row).bit_count()


#: Shifts tried after words that differ, cheapest first: words passed over in either text.
SHIFTS = sorted(((i, j) for i in range(5) for j in range(5) if i or j), key=lambda s: (max(s), abs(s[0] - s[1]), s))


def extend(x: list, y: list, a: int, b: int, step: int, penalty: int) -> tuple[int, int]:
    """Move a boundary outwards over equal words and over replaced, inserted and deleted ones.

    After words that differ the first shift is taken that two equal words follow.
    Equal words score 1, words passed over lose ``penalty``; the boundary is put
    where the score is highest, and the search ends 12 below that.
    """
    best, score = (a, b), 0
    top, off = 0, -1 if step < 0 else 0
    xs, ys = (a, b) if step < 0 else (len(x) - a, len(y) - b)
    i = j = 0
    while True:
        while i < xs and j < ys and x[a + off + i * step] == y[b + off + j * step]:
            i, j, score = i + 1, j + 1, score + 1
        if score > top:
            best, top = (a + i * step, b + j * step), score
        for di, dj in SHIFTS:
            if score - penalty * max(di, dj) < top - 12:
                return best
            u, v = i + di, j + dj
            if u + 1 < xs and v + 1 < ys and x[a + off + u * step] == y[b + off + v * step] and x[a + off + (u + 1) * step] == y[b + off + (v + 1) * step]:
                i, j, score = u, v, score - penalty * max(di, dj)
                break
        else:
            return best


SEED = np.dtype([("seed", "<u8"), ("node", "<i8"), ("at", "<i4")])
TIE = np.dtype([("node", "<i8"), ("ref", "<i8"), ("at", "<i4"), ("ref_at", "<i4")])
FIRST = np.dtype([("seed", "<u8"), ("node", "<i8"), ("at", "<i4"), ("several", "<i4")])
#: Bytes of records that an ordinary bucket is meant to hold, and from which on a bucket is hot and split.
BUCKET_BYTES, HOT_BYTES = 1 << 23, 1 << 26
#: One text in so many tells which buckets are hot.
SAMPLED = 32


def bucket_bits(text_bytes: int) -> int:
    """Bits of a hash that number so many buckets as the corpus needs; a word makes about 1.4 bytes of records for each of its own."""
    return min(30, max(6, math.ceil(math.log2(max(1, 1.4 * text_bytes / BUCKET_BYTES)))))


def encode(rows: np.ndarray) -> bytes:
    """Records field by field, all but seeds as differences, which the shuffle's compression shortens."""
    fields = [np.ascontiguousarray(rows[f]) for f in rows.dtype.names]
    return b"".join((x if f == "seed" else np.diff(x, prepend=x.dtype.type(0))).tobytes() for f, x in zip(rows.dtype.names, fields))


def decode(data: bytes, kind: np.dtype) -> np.ndarray:
    n, at = len(data) // kind.itemsize, 0
    out = np.empty(n, kind)
    for f in kind.names:
        x = np.frombuffer(data, kind[f], n, at)
        out[f] = x if f == "seed" else np.cumsum(x, dtype=kind[f])
        at += x.nbytes
    return out


def packed(rows: np.ndarray, key: np.ndarray, bits: int) -> pa.RecordBatch:
    """(bucket, rows): encoded records, one value a bucket."""
    bucket = (key >> np.uint64(64 - bits)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = [*first[1:].tolist(), len(rows)]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[first], pa.int32()), pa.array([encode(rows[i:j]) for i, j in zip(first.tolist(), ends)], pa.binary())], names=["bucket", "rows"]
    )


def by_bucket(df: DataFrame, kind: np.dtype, work, schema: str, keys: tuple[str, ...] = ("bucket",)) -> DataFrame:
    """``work`` on all records of each bucket (with ``keys`` each part of one); a task holds one at a time."""
    bound_batches(df.sparkSession)

    def each(batches):
        now, parts = None, []
        for batch in batches:
            for *key, rows in zip(*[batch.column(i).to_pylist() for i in range(len(keys))], batch.column(len(keys))):
                if key != now and parts:
                    yield work(np.concatenate([decode(x, kind) for x in parts]))
                    parts = []
                now = key
                parts.append(rows.as_py())
        if parts:
            yield work(np.concatenate([decode(x, kind) for x in parts]))

    return df.select(*keys, "rows").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(each, schema)


PACKED = "bucket int, rows binary"


def seed_rows(node: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]], bits: int) -> pa.RecordBatch:
    sizes = [len(p[0]) for p in found]
    rows = np.zeros(sum(sizes), SEED)
    if len(rows):
        rows["seed"], rows["at"] = np.concatenate([p[0] for p in found]), np.concatenate([p[1] for p in found])
        rows["node"] = np.repeat(node, sizes)
    return packed(rows, rows["seed"], bits)


def seeds(docs: DataFrame, bits: int, *, text_col: str, node: Column) -> DataFrame:
    """Packed ``SEED`` rows of each text; a batch's copies are read once."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        node, first = np.unique(batch.column(0).to_numpy(), return_index=True)
        # all texts of the batch in a row, so that few calls do the work
        words = [(batch.column(1)[int(i)].as_buffer().to_pybytes() if batch.column(1)[int(i)].is_valid else b"").split() for i in first]
        sizes = np.array([len(w) for w in words], np.int64)
        h = np.fromiter(map(WORDS.__getitem__, chain.from_iterable(words)), np.uint64, int(sizes.sum()))
        start = np.cumsum(sizes) - sizes
        seed, at = syncmers(h)
        text = np.searchsorted(start, at, side="right") - 1
        inside = at + K <= (start + sizes)[text]
        rows = np.zeros(int(inside.sum()), SEED)
        rows["seed"], rows["at"], rows["node"] = seed[inside], (at - start[text])[inside], node[text[inside]]
        return packed(rows, rows["seed"], bits)

    rows = docs.select(node.alias("node"), F.col(text_col).alias("text"))
    return map_arrow(rows, work, PACKED)


def firsts(rows: np.ndarray) -> np.ndarray:
    """The first holder of each seed among ``SEED`` or ``FIRST`` rows, and whether several texts hold the seed."""
    rows = rows[np.lexsort((rows["at"], rows["node"], rows["seed"]))]
    bounds = cuts(rows["seed"])
    head, tail = bounds[:-1], bounds[1:] - 1
    out = np.zeros(len(head), FIRST)
    for name in ("seed", "node", "at"):
        out[name] = rows[name][head]
    out["several"] = rows["node"][head] != rows["node"][tail]
    if "several" in rows.dtype.names and len(rows):
        out["several"] |= np.maximum.reduceat(rows["several"], head)
    return out


def repeated_seeds(rows: np.ndarray) -> np.ndarray:
    """The records whose seed stands in another one too, in their order."""
    order = np.argsort(rows["seed"])
    seed = rows["seed"][order]
    again = np.zeros(len(seed), bool)
    again[1:] = seed[1:] == seed[:-1]
    again[:-1] |= again[1:]
    return rows[np.sort(order[again])]


def tied(rows: np.ndarray, found: np.ndarray, bits: int) -> pa.RecordBatch:
    """Packed ``TIE`` rows of the seeds that several texts hold; ``found`` are first holders in the order of seeds."""
    at = np.searchsorted(found["seed"], rows["seed"])
    at[at == len(found)] = 0
    shared = np.zeros(len(rows), bool) if not len(found) else (found["seed"][at] == rows["seed"]) & (found["several"][at] > 0)
    rows, lead = rows[shared], found[at[shared]]
    out = np.zeros(len(rows), TIE)
    out["node"], out["at"], out["ref"], out["ref_at"] = rows["node"], rows["at"], lead["node"], lead["at"]
    return packed(out, mix64(out["node"].astype(np.uint64)), bits)


def hot_buckets(held: DataFrame) -> DataFrame:
    """(bucket, parts) of the buckets that frequent seeds make hot, judged by a sample's packed records.

    That decides only how records are dealt to tasks; what is found is the same with any parts.
    """
    sizes = held.groupBy("bucket").agg(F.sum(F.octet_length("rows") * SAMPLED).alias("n")).where(F.col("n") > HOT_BYTES)
    return keep(sizes.select("bucket", F.ceil(F.col("n") / HOT_BYTES).cast("int").alias("parts")))


def ties(held: DataFrame, bits: int, hot: DataFrame | None = None) -> DataFrame:
    """Packed ``TIE`` rows: each place of a seed that several texts hold with the seed's first holder, itself included.

    A hot bucket is split by salts. Each part names its first holders, these are
    merged, one a seed, and sent to the parts, which read their records piece by piece.
    """

    def whole(rows: np.ndarray) -> pa.RecordBatch:
        rows = repeated_seeds(rows)
        return tied(rows, firsts(rows), bits)

    if hot is None or hot.isEmpty():
        return by_bucket(held, SEED, whole, PACKED)
    held = keep(held)
    ordinary = by_bucket(held.join(hot, "bucket", "left_anti"), SEED, whole, PACKED)
    rows = held.join(hot, "bucket").withColumn("salt", F.pmod(F.xxhash64("rows"), F.col("parts")).cast("int"))
    named = by_bucket(rows, SEED, lambda rows: packed(found := firsts(rows), found["seed"], bits), PACKED, ("bucket", "salt"))
    merged = by_bucket(named, FIRST, lambda rows: packed((found := firsts(rows))[found["several"] > 0], found["seed"][found["several"] > 0], bits), PACKED)
    sent = merged.join(hot, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("kind"), "rows")
    both = sent.unionByName(rows.select("bucket", "salt", F.lit(1).alias("kind"), "rows"))

    def each(batches):
        now, found = None, np.zeros(0, FIRST)
        for batch in batches:
            for bucket, salt, kind, value in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if (bucket, salt) != now:
                    now, found = (bucket, salt), np.zeros(0, FIRST)
                if kind == 0:
                    found = decode(value, FIRST)
                elif len(found):
                    yield tied(decode(value, SEED), found, bits)

    keys = ("bucket", "salt", "kind")
    return ordinary.unionByName(both.repartition("bucket", "salt").sortWithinPartitions(*keys).mapInArrow(each, PACKED))


def cuts(*columns: np.ndarray) -> np.ndarray:
    """Bounds of the stretches in which all columns stay the same."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.append(np.flatnonzero(new), len(new))


def open_stretches(at: np.ndarray, ref: np.ndarray, shift: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Stretches of one text, as first and last start, of the ``width`` words in a row that need a look of their own.

    These are the windows all of whose seeds other texts hold, less those that lie
    within the seeds of one first holder on one diagonal, as that holder has them whole.
    """
    out = []
    far = np.append(np.insert(np.flatnonzero(np.diff(at) >= K) + 1, 0, 0), len(at))
    for i, j in zip(far[:-1].tolist(), far[1:].tolist()):
        low, high = max(0, int(at[i]) - K + 2), int(at[j - 1]) + 2 * K - 2 - width
        if high < low:
            continue
        look = np.ones(high - low + 1, bool)
        bounds = cuts(ref[i:j], shift[i:j]) + i
        for u, v in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if (end := int(at[v - 1]) + K - width) >= at[u]:
                look[at[u] - low : end - low + 1] = False
        edges = np.flatnonzero(np.diff(np.concatenate([[0], look.view(np.int8), [0]])))
        out.extend((low + int(a), low + int(b) - 1) for a, b in zip(edges[::2], edges[1::2]))
    return out


SPANS = "node long, ref long, a int, a_end int, b int, b_end int"


def span_rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = np.array(rows, np.int64).reshape(-1, 6)
    return pa.RecordBatch.from_arrays([pa.array(cols[:, j], pa.int64() if j < 2 else pa.int32()) for j in range(6)], names=["node", "ref", "a", "a_end", "b", "b_end"])


def chained(tied: DataFrame, width: int) -> DataFrame:
    """Chains of each pair of texts, and (with ``ref`` = ``node`` and ``b`` = -1) the open stretches of each text."""

    def work(rows: np.ndarray) -> pa.RecordBatch:
        out = []
        rows = rows[np.lexsort((rows["at"], rows["node"]))]
        shift = rows["ref_at"] - rows["at"]
        bounds = cuts(rows["node"])
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            node = int(rows["node"][i])
            out.extend((node, node, low, high, -1, -1) for low, high in open_stretches(rows["at"][i:j], rows["ref"][i:j], shift[i:j], width))
        rows = rows[rows["node"] != rows["ref"]]
        rows = rows[np.lexsort((rows["at"], rows["ref"], rows["node"]))]
        bounds = cuts(rows["node"], rows["ref"])
        several = np.flatnonzero(np.diff(bounds) > 1)
        for i, j in zip(bounds[several].tolist(), bounds[several + 1].tolist()):
            found = runs(rows["at"][i:j].astype(np.int64), rows["ref_at"][i:j].astype(np.int64))
            node, ref = int(rows["node"][i]), int(rows["ref"][i])
            for links in chains(found):
                head, tail = found[links[0]], found[links[-1]]
                if tail[0] + tail[2] - head[0] >= 2 * K:
                    out.append((node, ref, head[0], tail[0] + tail[2], head[1], tail[1] + tail[2]))
        return span_rows(out)

    return by_bucket(tied, TIE, work, SPANS)


def whole_windows(docs: DataFrame, stretches: DataFrame, width: int, bits: int, *, text_col: str, node: Column) -> DataFrame:
    """Spans of windows of ``width`` equal words in the open stretches, each tied to its own first holder."""
    asked = stretches.groupBy("node").agg(F.collect_set(F.struct("a", "a_end")).alias("asked"))
    texts = docs.select(node.alias("node"), F.col(text_col).alias("text")).join(asked.hint("merge"), "node")

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        node, first = np.unique(batch.column(0).to_numpy(), return_index=True)
        found = []
        for i in first:
            h, at, keys = word_hashes(batch.column(1)[int(i)].as_py()), [], []
            for s in batch.column(2)[int(i)].as_py():
                keys.append(grams(h[s["a"] : s["a_end"] + width], width))
                at.append(s["a"] + np.arange(len(keys[-1])))
            found.append((np.concatenate(keys), np.concatenate(at)))
        return seed_rows(node, found, bits)

    def work(rows: np.ndarray) -> pa.RecordBatch:
        out = []
        rows = rows[rows["node"] != rows["ref"]]
        rows = rows[np.lexsort((rows["at"], rows["ref"], rows["node"]))]
        bounds = cuts(rows["node"], rows["ref"])
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            node, ref = int(rows["node"][i]), int(rows["ref"][i])
            for a, b, n in runs(rows["at"][i:j].astype(np.int64), rows["ref_at"][i:j].astype(np.int64), width, width).tolist():
                out.append((node, ref, a, a + n, b, b + n))
        return span_rows(out)

    return by_bucket(ties(map_arrow(texts, windows, PACKED), bits), TIE, work, SPANS)


#: Words on either side of a chain that are fetched for extension: none goes farther. Equal words beyond it are in
#: a chain of their own, as of any four five-word runs one is a seed.
MARGIN = 64


#: Stretches of one text that are read from it together.
ASKED = 4096
SLICE = ("pair", "side", "node", "low", "high", "from")


def slices(docs: DataFrame, sides: DataFrame, *, text_col: str, node: Column) -> DataFrame:
    """(pair, side, node, low, high, from, words): the asked stretches of texts, and with ``MARGIN`` words around them as 32-bit word hashes.

    A text is shuffled once, and read once for every ``ASKED`` of its stretches.
    """
    counts = sides.groupBy("text_node").agg(F.count("*").alias("n"))
    chunk = F.coalesce(F.pmod(F.xxhash64("pair"), F.ceil(F.col("n") / ASKED)), F.lit(0)).alias("chunk")
    asked = sides.join(counts.where(F.col("n") > ASKED), "text_node", "left").groupBy("text_node", chunk).agg(F.collect_list(F.struct("pair", "side", "low", "high")).alias("asked"))
    texts = docs.select(node.alias("text_node"), F.col(text_col).alias("text")).join(counts.select("text_node").hint("merge"), "text_node", "left_semi")
    rows = texts.dropDuplicates(["text_node"]).join(asked.hint("merge"), "text_node").select("text", "asked", "text_node")
    bound_batches(docs.sparkSession)

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        words = [f[-1] for f in found]
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate([*words, np.zeros(0, np.int32)])))
        plain = [pa.array([f[i] for f in found], pa.int64() if n in ("pair", "node") else pa.int32()) for i, n in enumerate(SLICE)]
        return pa.RecordBatch.from_arrays([*plain, lists], names=[*SLICE, "words"])

    def each(batches):
        found, size = [], 0
        for batch in batches:
            for text, own, name in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
                h = word_hashes(text.as_py()).astype(np.uint32).view(np.int32)
                for x in own.as_py():
                    begin = max(0, x["low"] - MARGIN)
                    found.append((x["pair"], x["side"], name, x["low"], x["high"], begin, h[begin : x["high"] + MARGIN]))
                    size += len(found[-1][-1])
                    if size > 1 << 18:
                        yield batch_of(found)
                        found, size = [], 0
        if found:
            yield batch_of(found)

    return rows.mapInArrow(each, "pair long, side int, node long, low int, high int, from int, words array<int>")


def passages(docs: DataFrame, *, text_col: str = "text", node: Column | None = None, min_words: int = MIN_WORDS, min_equal: float = MIN_EQUAL) -> DataFrame:
    """(node, ref, start, end, ref_start, ref_end, equal): passages of texts that another text holds first.

    Ends are exclusive; places count words. ``equal`` is the number of aligned equal words.
    """
    node = text_node(docs, F.col(text_col)) if node is None else node
    bits = bucket_bits(docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0)
    sample = docs.where(F.pmod(F.xxhash64(F.lit(5), node), F.lit(SAMPLED)) == 0)
    hot = hot_buckets(seeds(sample, bits, text_col=text_col, node=node))
    told = keep(chained(ties(seeds(docs, bits, text_col=text_col, node=node), bits, hot), min_words))
    stretches = told.where("b < 0").select("node", "a", "a_end")
    spans = told.where("b >= 0").unionByName(whole_windows(docs, stretches, min_words, bits, text_col=text_col, node=node))
    spans = keep(spans.distinct().withColumn("pair", F.monotonically_increasing_id()))
    # both sides of every chain ask for their words; texts are shuffled once
    sides = spans.select(F.col("node").alias("text_node"), "pair", F.lit(0).alias("side"), F.col("a").alias("low"), F.col("a_end").alias("high")).unionByName(
        spans.select(F.col("ref").alias("text_node"), "pair", F.lit(1).alias("side"), F.col("b").alias("low"), F.col("b_end").alias("high"))
    )
    def best(x: np.ndarray, y: np.ndarray, a: int, a_end: int, b: int, b_end: int) -> tuple | None:
        lx, ly = x.tolist(), y.tolist()
        # a far extension that makes the whole too unequal is tried again more strictly
        for penalty in (2, 4):
            start, ref_start = extend(lx, ly, a, b, -1, penalty)
            end, ref_end = extend(lx, ly, a_end, b_end, 1, penalty)
            if min(end - start, ref_end - ref_start) < min_words:
                return None
            equal = align(x[start:end], y[ref_start:ref_end])
            if equal >= min_equal * max(end - start, ref_end - ref_start):
                return start, end, ref_start, ref_end, equal
        return None

    def aligned(batches):
        left = None
        for batch in batches:
            out = []
            columns = [batch.column(n).to_pylist() for n in SLICE]
            flat, bounds = batch.column("words").values.to_numpy(), batch.column("words").offsets.to_numpy()
            for i, (pair, side, name, low, high, begin) in enumerate(zip(*columns)):
                words = flat[bounds[i] : bounds[i + 1]]
                if side == 0:
                    left = (pair, name, low - begin, high - begin, begin, words)
                elif found := best(left[5], words, left[2], left[3], low - begin, high - begin):
                    start, end, ref_start, ref_end, equal = found
                    out.append((left[1], name, start + left[4], end + left[4], ref_start + begin, ref_end + begin, equal))
            if left is not None:
                left = (*left[:5], left[5].copy())  # its batch is let go
            rows = np.array(out, np.int64).reshape(-1, 7)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, j]) for j in range(7)], names=["node", "ref", "start", "end", "ref_start", "ref_end", "equal"])

    both = slices(docs, sides, text_col=text_col, node=node).repartition("pair").sortWithinPartitions("pair", "side")
    return both.mapInArrow(aligned, "node long, ref long, start long, end long, ref_start long, ref_end long, equal long").distinct()


def repeated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each document's passage: doc_id, start, end, ref_doc_id, ref_start, ref_end, equal."""
    node = text_node(docs, F.col(text_col))
    found = passages(docs, text_col=text_col, node=node, **options)
    ids = docs.select(F.col(id_col).alias("doc_id"), node.alias("node"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).alias("n"))
    ids = keep(ids)
    least = ids.groupBy("node").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.max("n").alias("n"))
    refs = least.select(F.col("node").alias("ref"), F.col("least").alias("ref_doc_id"))
    fuzzy = found.join(refs, "ref").join(ids.select("doc_id", "node"), "node")
    columns = ["doc_id", "start", "end", "ref_doc_id", "ref_start", "ref_end", "equal"]
    whole = ids.select("doc_id", "node").join(least.where((F.col("n") >= options.get("min_words", MIN_WORDS)) & (F.col("least") < F.col("most"))), "node")
    n = F.col("n").cast("long")
    whole = whole.where("doc_id <> least").select("doc_id", F.lit(0).cast("long").alias("start"), n.alias("end"), F.col("least").alias("ref_doc_id"), F.lit(0).cast("long").alias("ref_start"), n.alias("ref_end"), n.alias("equal"))
    return fuzzy.select(*columns).unionByName(whole)


def op4_collinear_passages(docs: DataFrame) -> DataFrame:
    return repeated(docs)
