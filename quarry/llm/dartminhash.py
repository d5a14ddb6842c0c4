r"""Near-duplicate detection with DartMinHash signatures, banding and exact checks.

A document is a weighted set of its five-word shingles (weight 1, or the
shingle's count). Each element owns a strip of the plane, as wide as its weight;
hashed darts land in the strip as a Poisson process along the rank axis, and a
dart is inside if its height is under the weight. Every dart belongs to one of
``k`` coordinates, and a coordinate keeps its earliest dart. Two sets keep the
same dart with a probability of their weighted Jaccard similarity. About
k ln k + 2k darts fill a signature, however large the set.

``rows`` coordinates make a band; equal bands put texts into one bucket. A pair
of similarity s meets in a bucket with probability 1 - (1 - s^rows)^bands, which
is 0.99995 at 0.8 for the defaults. Within buckets all links that matter to the
classes are found without forming all pairs. First each text is compared with
its bucket's hub, and links make components; where components meet in a bucket,
this is done once more with a random hub. Then, among the texts of buckets that
hold several components, pairs of different components that share one of their
rarest elements are compared; by the prefix filter that misses no link. So no
partner is capped. Components come from star contraction.

Results for odd input: equal texts form one class, null and empty texts too;
texts of fewer than five words have one shingle, all their words; a null doc_id
is kept as a row and never names a class unless all its members are null;
repeated rows share a class; an empty table gives no rows; other columns are
ignored by ``near_duplicates`` and passed on by ``drop_near_duplicates``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import keep, map_arrow, text_node

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix)."""
    x = x + _A
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hashes of words, remembered; forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


WORDS = Words()


def elements(text: str | None, shingle: int = SHINGLE, counted: bool = False) -> np.ndarray:
    """Sorted hashes of a text's weighted elements, each of weight 1.

    With ``counted``, the j-th copy of a shingle is an element of its own, so
    that set similarity of elements is weighted similarity of shingle counts.
    """
    words = (text or "").encode().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - shingle + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(shingle, len(h))):
        out = mix64(out ^ h[i : i + n])
    found, counts = np.unique(out, return_counts=True)
    if counted and len(found) < n:
        nth = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
        return np.unique(mix64(np.repeat(found, counts) + nth.astype(np.uint64)))
    return found


def signatures(sets: list[np.ndarray], k: int, weights: list[np.ndarray] | None = None) -> np.ndarray:
    """DartMinHash: one row of k dart identities for each set; empty sets get zeros.

    ``weights`` are positive reals, one for each element; 1 if not given.
    """
    out = np.zeros((len(sets), k), np.uint64)
    total = np.array([float(len(s) if weights is None else weights[i].sum()) for i, s in enumerate(sets)])
    todo, reach = np.flatnonzero(total > 0), 1.0
    while len(todo):
        # a strip for every started unit of weight
        elem, doc, room = [], [], []
        for at, i in enumerate(todo):
            if weights is None:
                e, r = sets[i], np.ones(len(sets[i]))
            else:
                n = np.ceil(weights[i]).astype(int)
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                e = mix64(np.repeat(sets[i], n) ^ mix64(nth.astype(np.uint64)))
                r = np.minimum(1.0, np.repeat(weights[i], n) - nth)
            elem.append(e)
            doc.append(np.full(len(e), at, np.int64))
            room.append(r)
        elem, doc, room = np.concatenate(elem), np.concatenate(doc), np.concatenate(room)
        far = reach * (k * math.log(k) + 2 * k) / total[todo]
        rank, seed = np.zeros(len(elem)), mix64(elem)
        ids, ranks, cells = [], [], []
        while len(seed):
            # the next dart of every strip: an exponential step along the rank axis
            seed = mix64(seed)
            rank = rank - np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            inside = rank <= far[doc]
            seed, rank, doc, room = seed[inside], rank[inside], doc[inside], room[inside]
            dart = mix64(seed ^ _C)
            low = slice(None) if weights is None else (dart >> np.uint64(40)).astype(np.float64) * 2.0**-24 < room
            ids.append(dart[low])
            ranks.append(rank[low])
            cells.append(doc[low] * k + (mix64(dart[low]) % np.uint64(k)).astype(np.int64))
        ids, ranks, cells = np.concatenate(ids), np.concatenate(ranks), np.concatenate(cells)
        # the earliest dart of each coordinate: write in falling order of rank, the last one stays
        order = np.argsort(-ranks, kind="stable")
        first = np.zeros(len(todo) * k, np.uint64)
        first[cells[order]] = ids[order]
        seen = np.zeros(len(todo) * k, bool)
        seen[cells] = True
        full = seen.reshape(-1, k).all(axis=1)
        out[todo[full]] = first.reshape(-1, k)[full]
        todo, reach = todo[~full], reach * 2
    return out


def band_keys(sigs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.broadcast_to(mix64(np.arange(bands, dtype=np.uint64)), (len(sigs), bands)).copy()
    for r in range(rows):
        keys = mix64(keys ^ sigs[:, r::rows][:, :bands])
    return keys


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(a) for a in arrays])]), pa.int32()), pa.array(flat))


def signed(docs: DataFrame, *, id_col: str, text_col: str, node: Column, shingle: int, counted: bool, bands: int, rows: int) -> DataFrame:
    """(doc_id, node, keys): the text's identity and its band keys. Empty sets have no keys."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        node = batch.column(1).to_numpy()
        texts = batch.column(2)
        # copies within a batch are signed once
        _, first, back = np.unique(node, return_index=True, return_inverse=True)
        sets = [elements(texts[int(i)].as_py(), shingle, counted) for i in first]
        keys = band_keys(signatures(sets, bands * rows), bands, rows)
        none = np.zeros(0, np.uint64)
        lists = [keys[j] if len(sets[j]) else none for j in back]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(lists)], names=["doc_id", "node", "keys"])

    rows_in = docs.select(F.col(id_col).alias("doc_id"), node.alias("node"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(rows_in, work, f"doc_id {kind}, node long, keys array<long>")


def element_sets(docs: DataFrame, nodes: DataFrame, *, text_col: str, node: Column, shingle: int, counted: bool) -> DataFrame:
    """(node, elements) for the texts in ``nodes``, each once."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, first = np.unique(batch.column(0).to_numpy(), return_index=True)
        found = [elements(batch.column(1)[int(i)].as_py(), shingle, counted) for i in first]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(first)), _lists(found)], names=["node", "elements"])

    texts = docs.select(node.alias("node"), F.col(text_col).alias("text"))
    return map_arrow(texts.join(nodes, "node", "left_semi"), work, "node long, elements array<long>").dropDuplicates(["node"])


#: Pairs of one text that are compared with its elements in one place.
CHUNK = 1024


def similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, sim) with the exact similarity of each pair.

    The text of a pair with more pairs is its hub. The other's elements travel to the hub's, which
    stand in one place for every ``CHUNK`` of its pairs: a hub of many is dealt to many tasks.
    Both tables of pairs are read several times, so they are kept: else the driver plans their making as often.
    """
    pairs = keep(pairs)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").agg(F.count("*").alias("d"))
    for side in ("a", "b"):
        pairs = pairs.join(degree.select(F.col("n").alias(side), F.col("d").alias(f"d{side}")), side)
    more = F.col("da") >= F.col("db")
    pairs = pairs.select(F.when(more, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(more, F.col("b")).otherwise(F.col("a")).alias("spoke"), F.greatest("da", "db").alias("d"))
    pairs = keep(pairs.select("hub", "spoke", F.pmod(F.xxhash64("spoke"), F.ceil(F.col("d") / CHUNK)).alias("chunk")))
    hubs = pairs.select("hub", "chunk").distinct().join(sets.select(F.col("node").alias("hub"), F.col("elements").alias("ea")), "hub")
    spokes = pairs.join(sets.select(F.col("node").alias("spoke"), F.col("elements").alias("eb")), "spoke")
    both = F.size(F.array_intersect("ea", "eb"))
    return spokes.join(hubs, ["hub", "chunk"]).select(F.col("hub").alias("a"), F.col("spoke").alias("b"), (both / (F.size("ea") + F.size("eb") - both)).alias("sim"))


def spokes(buckets: DataFrame) -> DataFrame:
    """(a, b): each text of a bucket with the bucket's hub, that with the most company in all its buckets.

    The middle of a group of near copies shares more buckets than its rim, so it
    becomes the hub of nearly all the group's buckets.
    """
    sizes = buckets.groupBy("key").agg(F.count("*").alias("n"))
    company = keep(buckets.join(sizes, "key").groupBy("node").agg(F.sum("n").alias("company")))
    return _star(buckets.join(company, "node"), F.struct("company", "node"), F.lit(True))


def random_spokes(open_buckets: DataFrame) -> DataFrame:
    """(a, b): texts of a bucket with a hub drawn for the bucket, where their components differ."""
    return _star(open_buckets, F.struct(F.xxhash64("key", "node"), "node", "component"), F.col("component") != F.col("top.component"))


def _star(ranked: DataFrame, rank, told) -> DataFrame:
    hubs = ranked.groupBy("key").agg(F.max(rank).alias("top"))
    pairs = ranked.join(hubs, "key").where((F.col("node") != F.col("top.node")) & told)
    return pairs.select(F.least("top.node", "node").alias("a"), F.greatest("top.node", "node").alias("b")).distinct()


def open_ends(buckets: DataFrame, named: DataFrame) -> DataFrame:
    """(key, node, component) of the buckets that hold several components."""
    labelled = buckets.join(named, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = labelled.groupBy("key").agg((F.min("component") != F.max("component")).alias("several")).where("several").select("key")
    return labelled.join(several, "key").select("key", "node", "component")


def rest_pairs(open_buckets: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Candidate pairs (a, b) of different components in buckets that hold several, by prefix filtering.

    Two sets of n and m elements and a similarity of s or more have an overlap
    of o = ceil(s (n + m) / (1 + s)) or more, so one element is among the n - o + 1 rarest
    of the one and the m - o + 1 rarest of the other: no link is missed. Elements
    that only one component has are left out, and pairs are formed between the members of the element's
    smaller components and all others, never inside its largest component.
    """
    open_nodes = open_buckets.select("node", "component").distinct()
    held = open_nodes.join(sets, "node").select("node", "component", F.size("elements").alias("n"), F.explode("elements").alias("element"))
    df = held.groupBy("element").agg(F.count("*").alias("df"))
    rare = held.join(df, "element").groupBy("node", "component", "n").agg(F.sort_array(F.collect_list(F.struct("df", "element"))).alias("e"))
    reach = (F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1).cast("int")
    prefix = rare.select("node", "component", "n", F.posexplode(F.slice("e", 1, reach)).alias("at", "e"))
    prefix = keep(prefix.where("e.df > 1").select("node", "component", "n", "at", F.col("e.element").alias("element")))
    shares = prefix.groupBy("element", "component").agg(F.count("*").alias("m"))
    largest = shares.groupBy("element").agg(F.max(F.struct("m", "component"))["component"].alias("largest"), F.count("*").alias("components"))
    told = prefix.join(keep(largest.where("components > 1")), "element")
    side = lambda df, i: df.select("element", *[F.col(c).alias(c + i) for c in ("node", "component", "n", "at")])
    left, right = side(told.where("component <> largest"), "x"), side(told, "y")
    overlap = F.ceil((F.col("nx") + F.col("ny")) * similarity / (1 + similarity) - 1e-9)
    met = (left["element"] == right["element"]) & (F.col("componentx") != F.col("componenty"))
    met = met & (F.col("nx") - F.col("atx") >= overlap) & (F.col("ny") - F.col("aty") >= overlap)
    return left.join(right, met).select(F.least("nodex", "nodey").alias("a"), F.greatest("nodex", "nodey").alias("b")).distinct()


def classes(buckets: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, component) of the linked texts among ``buckets``: (key, node), two nodes or more a key."""
    linked = lambda pairs: keep(similarities(pairs, sets).where(F.col("sim") >= similarity).select("a", "b"))
    found = linked(spokes(buckets))
    named = components(found)
    for pairs in (random_spokes, lambda left: rest_pairs(left, sets, similarity)):
        left = keep(open_ends(buckets, named))
        if left.isEmpty():
            break
        more = linked(pairs(left))
        if not more.isEmpty():
            found = found.unionByName(more)
            named = components(found)
    return named


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes in ``edges`` (a, b), the component being its least node.

    Alternating large-star and small-star steps; each is a pair of aggregations
    with map-side minima, so a hub with many neighbours is no hot task.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def both_ways(df: DataFrame) -> DataFrame:
        return df.unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b")))

    edges = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = state(edges)
    while before[0]:
        # large star: every larger neighbour of a is tied to a's least neighbour
        near = both_ways(edges)
        least = near.groupBy("a").agg(F.min("b").alias("m"))
        star = near.join(least, "a").withColumn("m", F.least("a", "m")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        star = star.where("a <> b").distinct()
        # small star: every smaller neighbour of a, and a, are tied to the least of them
        star = keep(star)
        least = star.groupBy("a").agg(F.min("b").alias("m"))
        small = star.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = keep(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    named = edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    roots = edges.select(F.col("b").alias("node")).distinct().join(named, "node", "left_anti")
    return keep(named.unionByName(roots.select("node", F.col("node").alias("component"))))


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    counted: bool = False,
    bands: int = BANDS,
    rows: int = ROWS,
    node: Column | None = None,
) -> DataFrame:
    """One row a document: doc_id, node (identity of its text) and class_id, the least doc_id of its class."""
    node = text_node(docs, F.col(text_col)) if node is None else node
    options = {"text_col": text_col, "node": node, "shingle": shingle, "counted": counted}
    sigs = keep(signed(docs, id_col=id_col, bands=bands, rows=rows, **options))
    texts = sigs.groupBy("node").agg(F.first("keys").alias("keys"))
    buckets = texts.select("node", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key")
    buckets = keep(buckets.join(shared, "key"))
    sets = keep(element_sets(docs, buckets.select("node").distinct(), **options))
    found = classes(buckets, sets, similarity)
    owners = sigs.groupBy("node").agg(F.min("doc_id").alias("_least"))
    named = owners.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("_least").alias("class_id"))
    told = named.join(least, "component").select("node", "class_id", "component")
    return sigs.select("doc_id", "node").join(told, "node").select("doc_id", "node", "class_id", "component")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each class, columns unchanged: that with the least doc_id (of equals, any one)."""
    node = text_node(docs, F.col(f"`{text_col}`"))
    told = keep(near_duplicates(docs, id_col=id_col, text_col=text_col, node=node, **options))
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("node").alias("t"))
    first = told.groupBy("component").agg(F.min(order).alias("_k"))
    counts = told.groupBy("doc_id", "node").agg(F.count("*").alias("_copies"))
    chosen = first.select(F.col("_k.i").alias("_id"), F.col("_k.t").alias("_node"))
    chosen = keep(chosen.join(counts, chosen["_id"].eqNullSafe(counts["doc_id"]) & (chosen["_node"] == counts["node"])).select("_id", "_node", "_copies"))
    names = docs.columns
    rows = docs.join(chosen, F.col(f"`{id_col}`").eqNullSafe(F.col("_id")) & (node == F.col("_node")))
    single = rows.where("_copies = 1").select(*[F.col(f"`{c}`") for c in names])
    # rows that repeat both id and text: one of them stays
    repeated = rows.where("_copies > 1").dropDuplicates(["_id", "_node"]).select(*[F.col(f"`{c}`") for c in names])
    return single.unionByName(repeated)


def op2_dartminhash(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "class_id")
