r"""Benchmark decontamination with a distributed positional inverted index.

``store`` writes an index of the training documents: its shards, one for each batch of
documents, hold for every term of the benchmark (or every term) the sorted list of its
positions. A shard is one row, in the order of its terms, so that all lists of a
document lie together and no list is shuffled or grows with the table. ``look_up`` reads
the stored shards. Posting lengths of the whole table tell which terms are rare. A
phrase is looked up from its rarest term: the position list, shifted by the
term's offset in the phrase, is intersected with the shifted lists of the next
rarest terms, until it is empty or all terms have agreed; all phrases of a block go
through each step together. A proximity match is a window whose ``rarest`` rarest distinct
terms (all of a shorter one) stand, in any order, within ``span`` words of a document, so
reworded passages are found too. Terms that no document has are passed over, but so many
must be left.

The test phrases are broadcast in blocks of at most ``block_bytes`` of text (a worker holds
about 40 times that while it works); a larger benchmark takes several passes over the documents,
one a block, whose marks are written before the next block is broadcast, and then joined.

Results for odd input: null and empty texts have no words and no hits; very long texts are
a shard of their own and indexed whole; an empty benchmark marks nothing; items without words
never occur; items with equal texts are all reported; repeated item ids are reported once; null
item ids are left out of the reported ids but still mark words; repeated documents get equal
results; an empty documents table gives no rows; other columns, whatever their names, are ignored
by ``op5_positional_index`` and passed on by ``remove_contaminated``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bound_batches, keep, text_pair

WINDOW = 13
#: Words within which the terms of a proximity match stand, and how many of a window's distinct terms, from the rarest on, must.
SPAN, RAREST = 2 * WINDOW, 4
#: A document is contaminated if this times its hit words reach its words.
SHARE = 20
#: Most bytes of benchmark text that are broadcast at once.
BLOCK_BYTES = 4 << 20
#: Windows, and places in documents, that are looked at together; bounds of memory only.
STEP, PLACES = 50_000, 2_000_000

#: Lower-cases A-Z and turns every ASCII character but digits and letters into a space;
#: bytes of non-ASCII characters stay, as all of these are word characters.
TABLE = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def tokens(text: str | bytes | None) -> list[bytes]:
    if not text:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(TABLE).split()


class Phrases:
    """The distinct test windows, by length, and the items that hold each."""

    def __init__(self, items: list[tuple[object, str | None]], n: int = WINDOW):
        self.terms: dict[bytes, int] = {}
        self.items = [item for item, _ in items]
        ids = [np.array([self.terms.setdefault(t, len(self.terms)) for t in tokens(text)], np.int32) for _, text in items]
        sizes = np.array([len(x) for x in ids], np.int64)
        self.flat = np.concatenate([*ids, np.zeros(0, np.int32)])
        first = np.cumsum(sizes) - sizes
        #: length of the windows, starts in ``flat``, and bounds in ``owners`` of the items of each
        self.groups: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for length in sorted({min(int(s), n) for s in sizes} - {0}):
            own = np.flatnonzero(np.minimum(sizes, n) == length)
            counts = sizes[own] - length + 1
            owner = np.repeat(own, counts)
            starts = np.repeat(first[own], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            rows = np.ascontiguousarray(self.flat[starts[:, None] + np.arange(length)]).view(np.dtype((np.void, 4 * length))).ravel()
            _, at, inverse = np.unique(rows, return_index=True, return_inverse=True)
            pairs = np.unique(inverse.astype(np.int64) * len(items) + owner)
            bounds = np.searchsorted(pairs // len(items), np.arange(len(at) + 1))
            self.groups.append((length, starts[at], bounds, (pairs % len(items)).astype(np.int32)))
        self.near: tuple[int, np.ndarray, np.ndarray, np.ndarray] | None = None

    def near_sets(self, rank: np.ndarray, rarest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct sets of ``rarest`` terms, from the rarest on, and in ``bounds`` and ``owners`` the items whose windows ask for each.

        ``rank`` orders terms by rarity; those without documents have the rank -1. A
        smaller set repeats its last term.
        """
        if self.near and self.near[0] == rarest:
            return self.near[1:]
        sets, owner = [np.zeros((0, rarest), np.int64)], [np.zeros(0, np.int64)]
        for length, starts, bounds, owners in self.groups:
            for i in range(0, len(starts), STEP):
                terms = self.flat[starts[i : i + STEP, None] + np.arange(length)].astype(np.int64)
                terms = np.take_along_axis(terms, np.argsort(rank[terms], axis=1, kind="stable"), axis=1)
                new = np.ones(terms.shape, bool)
                new[:, 1:] = terms[:, 1:] != terms[:, :-1]
                known = new & (rank[terms] >= 0)
                nth, count = np.cumsum(known, axis=1), known.sum(axis=1)
                ok = (count > 0) & (count >= np.minimum(rarest, new.sum(axis=1)))
                picked = np.stack([terms[np.arange(len(terms)), np.argmax(nth >= np.minimum(j, np.maximum(count, 1))[:, None], axis=1)] for j in range(1, rarest + 1)], axis=1)
                w = np.flatnonzero(ok) + i
                n = bounds[w + 1] - bounds[w]
                sets.append(np.repeat(picked[ok], n, axis=0))
                owner.append(owners[np.repeat(bounds[w], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
        every, owner = np.concatenate(sets), np.concatenate(owner)
        distinct, inverse = np.unique(every, axis=0, return_inverse=True)
        pairs = np.unique(inverse.ravel().astype(np.int64) * len(self.items) + owner) if len(every) else np.zeros(0, np.int64)
        bounds = np.searchsorted(pairs // max(len(self.items), 1), np.arange(len(distinct) + 1))
        self.near = (rarest, distinct, bounds, (pairs % max(len(self.items), 1)).astype(np.int32))
        return self.near[1:]


def shard_row(batch: pa.RecordBatch, carried: list[str], terms: dict[bytes, int] | None) -> pa.RecordBatch:
    """The index of a batch of documents as one row; ``terms`` restricts it to some terms."""
    own: dict[bytes, int] = {}
    ids, counts = [], []
    for text in batch.column("text"):
        words = tokens(text.as_buffer().to_pybytes() if text.is_valid else None)
        counts.append(len(words))
        if terms is None:
            number = [own.setdefault(w, len(own)) for w in words]
            ids.append(np.array(number, np.int32))
        else:
            get = terms.get
            ids.append(np.fromiter((get(w, -1) for w in words), np.int32, len(words)))
        ids.append(np.full(1, -1, np.int32))  # no phrase runs into the next document
    flat = np.concatenate(ids)
    known = np.flatnonzero(flat >= 0).astype(np.int32)
    known = known[np.argsort(flat[known], kind="stable")]
    present, sizes = np.unique(flat[known], return_counts=True)
    names = list(own) if terms is None else list(terms)
    lists = np.split(known, np.cumsum(sizes)[:-1]) if len(present) else []
    order = sorted(range(len(present)), key=lambda i: names[present[i]])
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    positions = np.concatenate([lists[i] for i in order]) if order else np.zeros(0, np.int32)
    return pa.RecordBatch.from_arrays(
        [
            *[one(batch.column(c)) for c in carried],
            one(pa.array(counts, pa.int64())),
            one(pa.array([names[present[i]].decode("utf-8", "replace") for i in order], pa.string())),
            one(pa.array([int(sizes[i]) for i in order], pa.int64())),
            pa.array([positions.tobytes()], pa.binary()),
        ],
        names=[*carried, "counts", "terms", "sizes", "positions"],
    )


def store(docs: DataFrame, *, carry: list[Column], text_col: str = "text", block=None, n: int = WINDOW) -> DataFrame:
    """The index of ``docs``, not yet written: one row a shard.

    The columns of ``carry``, ``counts`` (words), ``terms``, ``sizes`` (postings of each
    term) are lists; ``positions`` holds all postings in the order of the terms, 32-bit, and
    numbers the words of the shard's documents in a row, with one number between documents.
    """
    bound_batches(docs.sparkSession)
    cols = docs.select(*carry, F.col(text_col).alias("text"))
    carried = cols.columns[:-1]
    schema = [f"`{f.name}` array<{f.dataType.simpleString()}>" for f in cols.schema.fields[:-1]]

    def each(batches):
        for batch in batches:
            if batch.num_rows:
                yield shard_row(batch, carried, None if block is None else _phrases(block, n).terms)

    return cols.mapInArrow(each, ", ".join([*schema, "counts array<long>", "terms array<string>", "sizes array<long>", "positions binary"]))


class Shard:
    """A stored shard, as far as its terms belong to ``phrases``: one sorted array of (term, position) keys."""

    def __init__(self, counts: np.ndarray, terms: list[str], sizes: np.ndarray, positions: bytes, phrases: Phrases):
        self.counts = counts
        self.first = np.cumsum(counts + 1) - counts - 1
        self.size = int(counts.sum()) + len(counts)
        ids = np.array([phrases.terms.get(t.encode(), -1) for t in terms], np.int64)
        every = np.frombuffer(positions, np.int32)
        at = np.repeat(ids, sizes)
        self.keys = at[at >= 0] * self.size + every[at >= 0]
        self.keys.sort()
        self.held = np.zeros(len(phrases.terms) + 1, np.int64)
        self.held[ids[ids >= 0]] = sizes[ids >= 0]
        self.low = np.zeros(len(phrases.terms) + 1, np.int64)
        self.low[1:] = np.cumsum(self.held)[:-1]

    def document_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, positions, side="right") - 1

    def has(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether a term stands between two positions, both included."""
        at = np.searchsorted(self.keys, term * self.size + low)
        return (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] <= term * self.size + high) & (low <= high)

    def places(self, rarest: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, positions): all places of each row's term, in pieces of bounded size."""
        many = self.held[rarest]
        ends, j = np.cumsum(many), 0
        while j < len(rarest):
            k = max(j + 1, int(np.searchsorted(ends, (ends[j - 1] if j else 0) + PLACES, side="right")))
            n = many[j:k]
            row = np.repeat(np.arange(j, k), n)
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield row, self.keys[self.low[rarest[row]] + nth] - rarest[row] * self.size
            j = k

    def phrases(self, phrases: Phrases, rank: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, items, start positions) of phrases: offset-adjusted lists, intersected from the rarest term."""
        for length, starts, bounds, owners in phrases.groups:
            for i in range(0, len(starts), STEP):
                terms = phrases.flat[starts[i : i + STEP, None] + np.arange(length)].astype(np.int64)
                window = np.flatnonzero((self.held[terms] > 0).all(axis=1))
                terms = terms[window]
                order = np.argsort(rank[terms], axis=1, kind="stable")
                terms = np.take_along_axis(terms, order, axis=1)
                for row, place in self.places(terms[:, 0]):
                    start = place - order[row, 0]
                    ok = (start >= 0) & (start + length <= self.size)
                    row, start = row[ok], start[ok]
                    for k in range(1, length):
                        at = start + order[row, k]
                        ok = self.has(terms[row, k], at, at)
                        row, start = row[ok], start[ok]
                    if len(row):
                        yield length, *told(bounds, owners, window[row] + i, start)

    def near(self, phrases: Phrases, rank: np.ndarray, span: int, rarest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(items, positions of the rarest term) of proximity matches."""
        sets, bounds, owners = phrases.near_sets(rank, rarest)
        held = np.flatnonzero((self.held[sets] > 0).all(axis=1))
        terms = sets[held]
        for row, place in self.places(terms[:, 0]):
            doc = self.document_of(place)
            first, last = self.first[doc], self.first[doc] + self.counts[doc] - 1
            for k in range(1, rarest):
                ok = self.has(terms[row, k], np.maximum(place - span + 1, first), np.minimum(place + span - 1, last))
                row, place, first, last = row[ok], place[ok], first[ok], last[ok]
            found = np.zeros(len(row), bool)
            for back in range(span):
                low = place - back
                whole = ~found & (low >= first)
                for k in range(1, rarest):
                    whole[whole] = self.has(terms[row[whole], k], low[whole], np.minimum(low + span - 1, last)[whole])
                found |= whole
            if found.any():
                yield told(bounds, owners, held[row[found]], place[found])

    def pairs(self, phrases: Phrases, item: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Distinct document * items + item."""
        return np.unique(self.document_of(place) * len(phrases.items) + item)

    def marks(self, phrases: Phrases, rank: np.ndarray, span: int, rarest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hit words (by position), and the pairs of documents and items of phrases and of proximity matches."""
        edges, exact, close = np.zeros(self.size + 1, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for length, item, start in self.phrases(phrases, rank):
            np.add.at(edges, start, 1)
            np.add.at(edges, start + length, -1)
            exact.append(self.pairs(phrases, item, start))
        for item, place in self.near(phrases, rank, span, rarest):
            close.append(self.pairs(phrases, item, place))
        return np.cumsum(edges[:-1]) > 0, np.unique(np.concatenate(exact)), np.unique(np.concatenate(close))


def told(bounds: np.ndarray, owners: np.ndarray, found: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(items, places): each place once for every item that asked for what was found there."""
    n = bounds[found + 1] - bounds[found]
    return owners[np.repeat(bounds[found], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)].astype(np.int64), np.repeat(place, n)


_loaded: dict[object, Phrases] = {}


def _phrases(broadcast, n: int) -> Phrases:
    """A block's phrases, built once in each Python worker."""
    key = (broadcast.value[0], n)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Phrases(broadcast.value[1], n)
    return _loaded[key]


def blocks(spark: SparkSession, benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator:
    """Broadcast the benchmark in blocks of a checked size; equal items come in one order. A block lives until the next."""
    rows = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).orderBy("item", "text")
    block, size, none = [], 0, True
    for row in rows.toLocalIterator():
        length = len((row["text"] or "").encode())
        if block and size + length > block_bytes:
            yield spark.sparkContext.broadcast((uuid.uuid4().hex, block))
            block, size, none = [], 0, False
        block.append((row["item"], row["text"]))
        size += length
    if block or none:
        yield spark.sparkContext.broadcast((uuid.uuid4().hex, block))


MARKS = "n_words long, n_hit long, item_ids array<string>, near_ids array<string>, hit_runs array<long>"


def by_shard(index: DataFrame, block, n: int, work, schema: str) -> DataFrame:
    """``work`` (carried columns, shard, phrases, rank of terms by rarity) on every stored shard."""
    known = Phrases(block.value[1], n).terms
    frequency = np.zeros(len(known), np.int64)
    lists = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t")).groupBy("t.terms").agg(F.sum("t.sizes").alias("n"))
    # of an index of all terms only those of the block, whose number the block bounds
    for row in lists.toLocalIterator():
        if (at := known.get(row["terms"].encode())) is not None:
            frequency[at] = row["n"]
    rank, names = np.full(len(known) + 1, -1, np.int64), list(known)
    for place, at in enumerate(sorted(np.flatnonzero(frequency).tolist(), key=lambda t: (frequency[t], names[t]))):
        rank[at] = place
    ranks = index.sparkSession.sparkContext.broadcast(rank)
    carried = index.columns[:-4]

    def each(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                phrases = _phrases(block, n)
                value = lambda c: batch.column(c)[r].values.to_numpy(zero_copy_only=False)
                shard = Shard(value("counts"), batch.column("terms")[r].as_py(), value("sizes"), batch.column("positions")[r].as_py(), phrases)
                yield work([batch.column(c)[r].values for c in carried], shard, phrases, ranks.value)

    own = [f"`{f.name}` {f.dataType.elementType.simpleString()}" for f in index.schema.fields[:-4]]
    return index.mapInArrow(each, ", ".join([*own, schema]))


def look_up(index: DataFrame, block, *, n: int = WINDOW, span: int = SPAN, rarest: int = RAREST) -> DataFrame:
    """The carried columns of every document of a stored index, with ``MARKS`` for the block's phrases."""
    names = [*index.columns[:-4], "n_words", "n_hit", "item_ids", "near_ids", "hit_runs"]

    def ids(phrases: Phrases, pairs: np.ndarray, documents: int) -> pa.Array:
        out: list[set] = [set() for _ in range(documents)]
        for pair in pairs.tolist():
            if (item := phrases.items[pair % len(phrases.items)]) is not None:
                out[pair // len(phrases.items)].add(str(item))
        return pa.array([sorted(x) for x in out], pa.list_(pa.string()))

    def work(carried, shard: Shard, phrases: Phrases, rank) -> pa.RecordBatch:
        hit, exact, close = shard.marks(phrases, rank, span, rarest)
        before, first, counts = np.concatenate([[0], np.cumsum(hit)]), shard.first, shard.counts
        n_hit = before[first + counts] - before[first]
        none = np.zeros(0, np.int64)
        runs = [np.flatnonzero(np.diff(np.concatenate([[0], hit[f : f + c].view(np.int8), [0]]))) if h else none for f, c, h in zip(first, counts, n_hit)]
        found = [ids(phrases, exact, len(counts)), ids(phrases, close, len(counts)), pa.array(runs, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*carried, pa.array(counts), pa.array(n_hit), *found], names=names)

    return by_shard(index, block, n, work, MARKS)


def matches(index: DataFrame, block, *, n: int = WINDOW, span: int = SPAN, rarest: int = RAREST) -> DataFrame:
    """The carried columns with item_id, kind (``phrase`` or ``near``) and position: a row for every start of a
    phrase, and for every place of the rarest term of a proximity match. Positions count a document's words."""
    names = [*index.columns[:-4], "item_id", "kind", "position"]

    def work(carried, shard: Shard, phrases: Phrases, rank) -> pa.RecordBatch:
        rows = set()
        for kind, found in ("phrase", ((i, p) for _, i, p in shard.phrases(phrases, rank))), ("near", shard.near(phrases, rank, span, rarest)):
            for item, place in found:
                doc = shard.document_of(place)
                rows.update((d, i, kind, p) for d, i, p in zip(doc.tolist(), item.tolist(), (place - shard.first[doc]).tolist()))
        rows = sorted(rows)
        at = pa.array([r[0] for r in rows], pa.int64())
        item = pa.array([None if (x := phrases.items[r[1]]) is None else str(x) for r in rows], pa.string())
        return pa.RecordBatch.from_arrays([*[c.take(at) for c in carried], item, pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.int64())], names=names)

    return by_shard(index, block, n, work, "item_id string, kind string, position long")


def merged(runs: Column) -> Column:
    """Runs (start, end, start, end and so on) of several passes as runs that do not touch."""
    pairs = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(runs) - 2, F.lit(2)), lambda i: F.struct(F.get(runs, i).alias("a"), F.get(runs, i + 1).alias("b"))))
    out = F.aggregate(
        F.when(F.size(runs) > 0, pairs),
        F.array().cast("array<long>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (x["a"] <= F.element_at(acc, -1)),
                              F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.greatest(F.element_at(acc, -1), x["b"]))))
        .otherwise(F.concat(acc, F.array(x["a"], x["b"]))),
    )
    return F.coalesce(out, F.array().cast("array<long>"))


def mark(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    carry: list[Column],
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = WINDOW,
    span: int = SPAN,
    rarest: int = RAREST,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``carry`` with n_words, n_hit, item_ids and near_ids (sorted strings; near_ids are those of proximity matches) and hit_runs.

    ``hit_runs`` holds the bounds of runs of hit words: start, end, start, end
    and so on, ends exclusive. With several blocks the marks of the passes are
    joined by a row number that is written before the first pass.
    """
    spark = docs.sparkSession
    cols = docs.select(*carry, F.col(text_col).alias("text"))
    carried = [F.col(f"`{c}`") for c in cols.columns[:-1]]
    passes, numbered, last = [], None, None
    parts = blocks(spark, benchmark, item_col, item_text_col, block_bytes)
    block = next(parts)
    while block is not None:
        following = next(parts, None)
        if numbered is None and following is None:
            return look_up(keep(store(cols, carry=carried, block=block, n=n)), block, n=n, span=span, rarest=rarest)
        if numbered is None:
            numbered = keep(cols.withColumn("_row", F.monotonically_increasing_id()))
        passes.append(keep(look_up(keep(store(numbered, carry=[F.col("_row")], block=block, n=n)), block, n=n, span=span, rarest=rarest)))
        block.unpersist(blocking=True)
        block = following
    out = passes[0]
    for more in passes[1:]:
        out = out.unionByName(more)
    ids = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    joined = out.groupBy("_row").agg(F.max("n_words").alias("n_words"), ids("item_ids"), ids("near_ids"), F.flatten(F.collect_list("hit_runs")).alias("_runs"))
    joined = joined.withColumn("hit_runs", merged(F.col("_runs")))
    length = F.aggregate(F.transform("hit_runs", lambda end, i: F.when(i % 2 == 1, end).otherwise(-end)), F.lit(0).cast("long"), lambda acc, x: acc + x)
    joined = joined.withColumn("n_hit", length)
    return numbered.drop("text").join(joined, "_row").select(*carried, "n_words", "n_hit", "item_ids", "near_ids", "hit_runs")


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (SHARE * n_hit >= n_words)


def holds_window(hit_runs: Column, n: int = WINDOW) -> Column:
    """Whether ``n`` or more hit words stand in a row: a whole window of an item, or short items side by side."""
    lengths = F.transform(hit_runs, lambda end, i: F.when(i % 2 == 1, end - F.get(hit_runs, i - 1)).otherwise(F.lit(0)))
    return F.exists(lengths, lambda length: length >= n)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no whole window of an item and are not contaminated by share, columns unchanged.

    A window of ``n`` words is proof whatever the document's length; items shorter than a
    window, which common phrases may equal, only count by their share of the document. The
    verdict hangs on the text alone, so the texts that go are joined by their 128-bit hash.
    """
    names = docs.columns
    one, two = text_pair(F.col(f"`{text_col}`"))
    told = mark(docs.select(one.alias("_one"), two.alias("_two"), F.col(f"`{text_col}`").alias("text")), benchmark, carry=[F.col("_one"), F.col("_two")], **options)
    leaked = holds_window(F.col("hit_runs"), options.get("n", WINDOW)) | contaminated(F.col("n_hit"), F.col("n_words"))
    gone = keep(told.where(leaked).select("_one", "_two").distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), one.alias("_one"), two.alias("_two"))
    return rows.join(gone, ["_one", "_two"], "left_anti").select(*[F.col("_row")[c].alias(c) for c in names])


def write_index(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Store the postings of all training terms, to answer benchmarks that come later."""
    store(docs, carry=[F.col(id_col).alias("doc_id")], text_col=text_col).write.parquet(path)


def search_index(spark: SparkSession, path: str, phrases: list[list[str]]) -> DataFrame:
    """Start positions of phrases in a stored index of all terms: (phrase, doc_id, start), without the texts."""
    asked = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(phrases)], "item_id long, text string")
    out = None
    for block in blocks(spark, asked, "item_id", "text", BLOCK_BYTES):
        found = matches(spark.read.parquet(path), block, n=max(map(len, phrases), default=1)).where("kind = 'phrase'")
        found = found.select(F.col("item_id").cast("int").alias("phrase"), "doc_id", F.col("position").alias("start"))
        out = found if out is None else out.unionByName(found)
    return out


def proximity(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", n: int = WINDOW, span: int = SPAN, rarest: int = RAREST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Proximity matches, (doc_id, item_id, position), by an index stored for them."""
    out = None
    for block in blocks(docs.sparkSession, benchmark, "item_id", "text", block_bytes):
        index = keep(store(docs, carry=[F.col(id_col).alias("doc_id")], block=block, n=n))
        found = keep(matches(index, block, n=n, span=span, rarest=rarest).where("kind = 'near'").drop("kind"))
        out = found if out is None else out.unionByName(found)
    return out


def digest(item_ids: list[str]) -> str:
    return hashlib.sha256(",".join(item_ids).encode()).hexdigest()


def op5_positional_index(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The contract's columns, and n_near: items with a proximity match (those with a phrase among them)."""
    out = mark(docs, benchmark, carry=[F.col("doc_id")], **options)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
        F.size("near_ids").cast("long").alias("n_near"),
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM bs),
ds AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN (SELECT DISTINCT n FROM bw) ON len(w) >= n),
m AS (SELECT r, i, n, item_id FROM (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM ds) JOIN bw USING (n, k)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
found AS (SELECT DISTINCT r, item_id::VARCHAR AS item FROM m WHERE item_id IS NOT NULL),
dt AS (SELECT r, unnest(w) AS t, unnest(range(len(w))) AS p FROM d),
cf AS (SELECT t, count(*) AS n FROM dt GROUP BY t),
kw AS (SELECT row_number() OVER () AS k, * FROM (SELECT DISTINCT w[i:i + n - 1] AS w FROM bs)),
kt0 AS (SELECT DISTINCT k, unnest(w) AS t FROM kw),
kt1 AS (SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY n, t) AS i, count(*) OVER (PARTITION BY k) AS known FROM kt0 JOIN cf USING (t)),
kt AS (SELECT k, t, i, least(4, known) AS nt FROM kt1 JOIN (SELECT k, count(*) AS every FROM kt0 GROUP BY k) USING (k) WHERE i <= 4 AND known >= least(4, every)),
c AS (SELECT k, nt, r, p AS place FROM kt JOIN dt USING (t) WHERE i = 1),
o AS (SELECT c.k, c.nt, c.r, place, dt.t, dt.p FROM c JOIN kt USING (k) JOIN dt ON dt.r = c.r AND dt.t = kt.t AND dt.p BETWEEN place - 25 AND place + 25),
ow AS (SELECT *, count(DISTINCT t) OVER (PARTITION BY k, r, place) AS got FROM o),
sp AS (SELECT DISTINCT a.k, a.r FROM (SELECT a.k, a.r, a.place, a.p, a.nt, count(DISTINCT b.t) AS got FROM ow a JOIN ow b ON a.k = b.k AND a.r = b.r AND a.place = b.place AND b.p BETWEEN a.p AND a.p + 25
   WHERE a.got = a.nt AND a.p <= a.place GROUP BY ALL) a WHERE got = nt),
nr AS (SELECT r, count(DISTINCT item_id::VARCHAR) AS n_near FROM sp JOIN kw USING (k) JOIN (SELECT DISTINCT item_id, w[i:i + n - 1] AS w FROM bs WHERE item_id IS NOT NULL) USING (w) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM found GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r) LEFT JOIN nr USING (r)
"""
