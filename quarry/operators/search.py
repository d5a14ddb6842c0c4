"""Search: query text and filters to ranked files.

Parsing and planning run on the driver. Expansions of a word are a bounded
result (``MAX_EXPANSIONS`` a word and field) that is collected; the terms then reach the
scan of the postings as a filter, with all that a score needs but the posting
itself. Scores, met clauses and matches are summed in one pass by file, before
the shuffle; the files are joined once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quarry.functions.paths import covers
from quarry.functions.query import ParsedQuery, parse
from quarry.functions.snippets import snippet_column
from quarry.functions.stems import STEMMERS, stems
from quarry.functions.text import osa_distance, tokenize_py
from quarry.plans.index import Index

#: Fixed values of ranking and expansion.
BOOSTS = {"name": 2.5, "dir": 0.8, "content": 1.0}
PREFIX, FUZZY, FORM = 0.6, {0: 1.0, 1: 0.45, 2: 0.3}, 0.8
MAX_EXPANSIONS, MAX_LONGER = 40, 6
SCANNED = {"exact": 1, "prefix": 64, "fuzzy": 64, "form": 400}
K1, B = 1.2, 0.75
#: Clauses in one bit mask.
BITS = 62


@dataclass
class Request:
    query: str = ""
    categories: tuple[str, ...] = ()
    modified_since: int | None = None
    folder: tuple[str, bool] | None = None
    sort: str = "relevance"
    limit: int = 100
    fuzzy: bool = True
    word_forms: bool = True


@dataclass
class Clause:
    """One required part: alternatives (field, term, multiplier, df), any of which may match; or a phrase."""

    alternatives: list[tuple[str, str, float, int]] = field(default_factory=list)
    phrase: list[str] = field(default_factory=list)
    highlighted: bool = True


@F.pandas_udf(T.IntegerType())
def _osa(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else osa_distance(x, y) for x, y in zip(a, b)], dtype="Int32")


@F.pandas_udf(T.BooleanType())
def _is_form(term: pd.Series, stem: pd.Series) -> pd.Series:
    return pd.Series([any(f(t) == s for f in STEMMERS) for t, s in zip(term, stem)], dtype=bool)


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows that stand in the plan itself, so that no Python worker is asked for them."""
    fields = T._parse_datatype_string(schema)
    return spark.createDataFrame(pa.table({f.name: pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(fields)}), fields)


def expand(index: Index, asks: list[tuple[int, str, str, bool, bool, bool]]) -> dict[tuple[int, str], list[tuple[str, float, int]]]:
    """Terms that stand for a word, with multiplier and df: exact, by prefix, by edit distance, by stem. ``asks``: (clause, field, word, prefix, fuzzy, forms).

    Each kind of expansion looks at so many terms in term order (``SCANNED``), which
    Spark cuts in every partition before it shuffles.
    """
    if not asks:
        return {}
    spark = index.files.sparkSession
    rows = []
    for clause, f, word, prefix, fuzzy, forms in asks:
        most = 0 if word.isdigit() or not fuzzy or len(word) < 4 else 1 if len(word) < 8 else 2
        rows.append((clause, f, word, prefix and len(word) > 1, most, [{"stem": s, "shared": p} for s, p in (stems(word) if forms else [])]))
    fields = tuple(sorted({r[1] for r in rows}))
    out: dict[tuple[int, str], list[tuple[str, float, int]]] = {}
    if not any(prefix or most or forms for *_, prefix, most, forms in rows):
        known = {(r["field"], r["term"]): r["df"] for r in index.frequencies(fields, {r[2] for r in rows}).collect()}
        for clause, f, word, *_ in rows:
            if (f, word) in known:
                out[clause, f] = [(word, 1.0, known[f, word])]
        return out
    words = local(spark, rows, "clause int, field string, word string, prefix boolean, most int, forms array<struct<stem: string, shared: string>>")
    dictionary = index.frequencies(fields)
    n = F.length("word")
    # a swap costs two plain edits, so plain distance bounds the pairs before the exact distance runs
    near = (F.col("most") > 0) & (F.abs(F.length("term") - n) <= F.col("most")) & (F.levenshtein("term", "word", 4) >= 0) & (F.levenshtein("term", "word") <= 2 * F.col("most"))
    kind = lambda name, test, stem: F.struct(F.when(test, name).alias("kind"), stem.alias("stem"))
    plain = {"exact": F.col("term") == F.col("word"), "prefix": F.col("prefix") & F.col("term").startswith(F.col("word")), "fuzzy": near}
    kinds = F.concat(
        F.array(*[kind(k, test, F.lit("")) for k, test in plain.items()]),
        F.transform("forms", lambda x: kind("form", F.col("term").startswith(x["shared"]), x["stem"])),
    )
    kinds = F.filter(kinds, lambda k: k["kind"].isNotNull())
    pairs = dictionary.join(F.broadcast(words), "field").withColumn("k", F.explode(kinds)).select("clause", "field", "term", "df", "word", "most", "k.*")
    apart = pairs.where("kind <> 'fuzzy'").withColumn("d", F.lit(None).cast("int"))
    if any(r[4] for r in rows):
        # a Python function runs on every row it is given: only those that need it
        close = pairs.where("kind = 'fuzzy'").withColumn("d", _osa("term", "word")).where(F.col("d") <= F.col("most"))
        pairs = apart.unionByName(close)
    else:
        pairs = apart
    in_order = Window.partitionBy("clause", "field", "kind", "stem").orderBy("term")
    seen = pairs.withColumn("pn", F.row_number().over(in_order)).where(F.col("pn") <= max(SCANNED.values()))
    limit = F.create_map(*[F.lit(x) for kv in SCANNED.items() for x in kv])[F.col("kind")]
    seen = seen.where(F.col("pn") <= limit)
    if any(r[5] for r in rows):
        short = F.octet_length("term") <= F.octet_length("word") + MAX_LONGER
        seen = seen.where("kind <> 'form'").unionByName(seen.where((F.col("kind") == "form") & short).where(_is_form("term", "stem")))
    score = F.when(F.col("kind") == "exact", 1.0).when(F.col("kind") == "prefix", PREFIX).when(F.col("kind") == "form", FORM)
    score = score.otherwise(F.when(F.col("d") == 0, FUZZY[0]).when(F.col("d") == 1, FUZZY[1]).otherwise(FUZZY[2]))
    terms = seen.groupBy("clause", "field", "term").agg(F.max(score).alias("mult"), F.max("df").alias("df"))
    best = Window.partitionBy("clause", "field").orderBy(F.desc("mult"), F.desc("df"), "term")
    kept = terms.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= MAX_EXPANSIONS)
    for r in kept.select("clause", "field", "term", "mult", "df").collect():
        out.setdefault((r["clause"], r["field"]), []).append((r["term"], r["mult"], r["df"]))
    return out


def clauses(index: Index, q: ParsedQuery, fuzzy: bool = True, word_forms: bool = True) -> list[Clause]:
    asks, out = [], []

    def ask(word: str, fields: tuple[str, ...], prefix: bool, highlighted: bool = True, as_is: bool = False) -> None:
        asks.extend((len(out), f, word, prefix, fuzzy and not as_is, word_forms and highlighted and not as_is) for f in fields)
        out.append(Clause(highlighted=highlighted))

    words = [t for w in q.words for t in tokenize_py(w)]
    for i, w in enumerate(words):
        ask(w, ("name", "dir", "content"), q.typing_last and i == len(words) - 1)
    for w in (t for x in q.names for t in tokenize_py(x)):
        ask(w, ("name",), True)
    for w in (t for x in q.folders for t in tokenize_py(x)):
        ask(w, ("dir",), True, False)
    for p in q.phrases:
        terms = tokenize_py(p)
        if len(terms) == 1:
            ask(terms[0], ("name", "content"), False, as_is=True)
        elif terms:
            out.append(Clause(phrase=terms))
    for (clause, f), terms in expand(index, asks).items():
        out[clause].alternatives += [(f, *t) for t in terms]
    return out


def filters(request: Request, q: ParsedQuery) -> Column:
    """Predicates on the files' own columns."""
    out = F.lit(True)
    if q.types:
        out = out & (F.col("category").isin(*[v for k, v in q.types if k == "category"]) | F.col("ext").isin(*[v for k, v in q.types if k == "ext"]))
    if request.categories:
        out = out & F.col("category").isin(*request.categories)
    if request.modified_since is not None:
        out = out & (F.col("mtime") >= request.modified_since)
    if request.folder:
        out = out & covers(F.col("path"), F.col("parent"), *request.folder)
    return out


def narrowed(request: Request, q: ParsedQuery) -> bool:
    """Whether predicates on the files' own columns restrict a search."""
    return bool(q.types or request.categories or request.modified_since is not None or request.folder)


def moved(positions: Column, i: int) -> Column:
    return F.transform(positions, lambda p: p - i)


def phrase_counts(index: Index, terms: list[str], fields: tuple[str, ...]) -> DataFrame:
    """(field, file_id, len, tf): occurrences of adjacent terms, from the positions of each term in one field of one file."""
    rows = index.postings.where(F.col("field").isin(*fields) & F.col("term").isin(*terms))
    distinct = list(dict.fromkeys(terms))
    # a term has one posting in a field of a file
    where = [F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"p{i}") for i, t in enumerate(distinct)]
    whole = rows.groupBy("field", "file_id").agg(F.max("len").alias("len"), *where).dropna(subset=[f"p{i}" for i in range(len(distinct))])
    starts = None
    for i, t in enumerate(terms):
        shifted = moved(F.col(f"p{distinct.index(t)}"), i)
        starts = shifted if starts is None else F.array_intersect(starts, shifted)
    return whole.select("field", "file_id", "len", F.size(starts).alias("tf")).where("tf > 0")


def idf(n: int, df: Column) -> Column:
    return F.log(F.lit(1.0) + (F.lit(float(n)) - df + 0.5) / (df + 0.5))


def scored(index: Index, parts: list[Clause]) -> DataFrame:
    """(file_id, score, matches) of the files that match every clause.

    matches: occurrences in name and content of all highlighted terms. One row a
    (field, term) is asked for, whatever the number of clauses that want it, so a
    posting is read once and joined to one row at most.
    """
    n, totals = index.stats
    blocks = range(-(-len(parts) // BITS))
    bits = lambda clauses: [sum(1 << i % BITS for i in clauses if i // BITS == b) for b in blocks]
    average = {f: float(totals.get(f, 0)) / max(n, 1) or 1.0 for f in BOOSTS}
    shown = {t for c in parts if c.highlighted for _, t, *_ in c.alternatives} | {t for c in parts for t in c.phrase}
    wanted: dict[tuple[str, str], tuple[list[int], float]] = {(f, t): ([], 0.0) for f in ("name", "content") for t in shown}
    for i, c in enumerate(parts):
        for f, t, mult, df in c.alternatives:
            clauses, weight = wanted.get((f, t), ([], 0.0))
            wanted[f, t] = ([*clauses, i], weight + mult * BOOSTS[f] * math.log(1 + (n - df + 0.5) / (df + 0.5)))
    rows = [(f, t, w, average[f], f != "dir" and t in shown, bits(clauses)) for (f, t), (clauses, w) in wanted.items()]
    asked = local(index.files.sparkSession, rows, "field string, term string, weight double, average double, counted boolean, bits array<long>")
    found = index.counts(tuple(sorted({f for f, _ in wanted}))).where(F.col("term").isin(*{t for _, t in wanted}))
    norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (F.lit(1 - B) + B * F.col("len") / F.col("average")))
    masks = [F.col("bits")[b].alias(f"b{b}") for b in blocks]
    hits = found.join(F.broadcast(asked), ["field", "term"]).select("file_id", (F.col("weight") * norm).alias("part"), F.when(F.col("counted"), F.col("tf")).otherwise(0).cast("long").alias("n"), *masks)
    by_field = lambda values: F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("field")]
    for i, c in enumerate(parts):
        if c.phrase:
            tf = phrase_counts(index, c.phrase, ("name", "content"))
            one = tf.join(F.broadcast(tf.groupBy("field").agg(F.count("*").alias("df"))), "field").withColumn("average", by_field(average))
            masks = [F.lit(m).cast("long").alias(f"b{b}") for b, m in enumerate(bits([i]))]
            hits = hits.unionByName(one.select("file_id", (by_field(BOOSTS) * idf(n, F.col("df")) * norm).alias("part"), F.lit(0).cast("long").alias("n"), *masks))
    sums = [F.sum("part").alias("score"), F.sum("n").alias("matches"), *[F.bit_or(f"b{b}").alias(f"b{b}") for b in blocks]]
    by_file = hits.groupBy("file_id").agg(*sums)
    for b, full in enumerate(bits(range(len(parts)))):
        by_file = by_file.where(F.col(f"b{b}") == full)
    return by_file.select("file_id", "score", "matches")


SORTS = {
    "relevance": (F.desc, "score"),
    "newest": (F.desc, "mtime"),
    "oldest": (F.asc, "mtime"),
    "largest": (F.desc, "size"),
    "name": (F.asc, "name_key"),
}


#: Columns of the files that a search returns.
SHOWN = ("path", "name", "mtime", "size", "category")


def matching(index: Index, request: Request, columns: tuple[str, ...] = ()) -> DataFrame:
    """All matching files (file_id, score, matches) with ``columns`` of theirs, before any limit."""
    q = parse(request.query)
    rows = index.files.where(filters(request, q)).select("file_id", *columns)
    parts = clauses(index, q, request.fuzzy, request.word_forms)
    narrow = narrowed(request, q)
    unmet = any(not c.alternatives and not c.phrase for c in parts)
    if unmet or not (q.has_terms or q.excluded or narrow):
        return rows.limit(0).select("*", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("matches"))
    if parts:
        out = scored(index, parts)
        out = out.join(rows, "file_id") if columns or narrow else out
    else:
        out = rows.select("*", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("matches"))
    for text in q.excluded:
        terms = tokenize_py(text)
        if len(terms) == 1:
            gone = index.counts().where(F.col("term") == terms[0]).select("file_id")
        elif terms:
            gone = phrase_counts(index, terms, ("name", "dir", "content")).select("file_id")
        else:
            continue
        out = out.join(gone, "file_id", "left_anti")
    return out


def search(index: Index, request: Request) -> DataFrame:
    """The top files in order: file_id, path, name, mtime, size, category, score (6 digits), matches."""
    q = parse(request.query)
    sort = "newest" if request.sort == "relevance" and not q.has_terms else request.sort
    direction, column = SORTS[sort]
    if sort == "relevance" and not narrowed(request, q):
        # the best files and those equal to the last of them, cut in each partition before they are joined to their columns
        ranked = matching(index, request).withColumn("score", F.round("score", 6)).withColumn("_rank", F.rank().over(Window.orderBy(F.desc("score"))))
        best = ranked.where(F.col("_rank") <= max(request.limit, 1)).drop("_rank")
        found = best.join(index.files.select("file_id", *SHOWN), "file_id")
    else:
        found = matching(index, request, SHOWN).withColumn("score", F.round("score", 6))
    found = found.withColumn("name_key", F.lower("name"))
    top = found.orderBy(direction(column), "path").limit(max(request.limit, 1))
    return top.select("file_id", *SHOWN, "score", "matches")


def matched_terms(index: Index, request: Request) -> list[str]:
    """The terms that a search marks in names and texts: all that stand for its words, and those of phrases."""
    parts = clauses(index, parse(request.query), request.fuzzy, request.word_forms)
    return sorted({t for c in parts if c.highlighted for _, t, *_ in c.alternatives} | {t for c in parts for t in c.phrase})


def search_snippets(index: Index, request: Request) -> DataFrame:
    """The top files of a search, in order, with ``snippet``: segments of the passage that shows most of the matched terms,
    typos, beginnings and word forms among them. Only the texts of the top files are read by Python."""
    top = search(index, request).withColumn("place", F.monotonically_increasing_id())
    texts = index.files.select("file_id", "content").join(F.broadcast(top), "file_id")
    shown = texts.withColumn("snippet", snippet_column(F.col("content"), matched_terms(index, request))).drop("content")
    return shown.orderBy("place").drop("place")


def total(index: Index, request: Request) -> DataFrame:
    """One row: the number of matching files, whatever the limit."""
    return matching(index, request).agg(F.count("*").alias("total"))
