"""Registered queries over the reference's operators, each with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.categories import BY_EXTENSION
from quarry.functions.display import (
    categories_of,
    column_widths,
    description,
    display_name,
    display_path,
    failure_text,
    format_count,
    format_date,
    markup,
    matching_cells,
    next_match,
    preview_rows,
    since,
)
from quarry.functions.paths import covers, excluded, skips
from quarry.functions.query import parse
from quarry.operators import sync
from quarry.functions.text import PAIRS, fold_map, tokenize
from quarry.operators.library import Library
from quarry.operators.search import Request, search, search_snippets, total
from quarry.plans.files import files
from quarry.plans.index import Index, open_index, tokens, update_index, write_index
from quarry.plans.session import session_index, shared_dir, spread
from quarry.sources.decode import extract_udf, html_text_udf
from quarry.sources.formats import BY_EXTENSION as KIND_OF, classified
from quarry.streaming.changes import alive, apply_batch, coalesced, from_events

# ---- SQL ----------------------------------------------------------------

_CASES = " ".join(f"WHEN '{e}' THEN '{c}'" for e, c in BY_EXTENSION.items())
_KINDS = " ".join(f"WHEN '{e}' THEN '{k}'" for e, k in KIND_OF.items())
FILES = f"""
f0 AS (SELECT *, ['txt','md','html','pdf','docx','csv','pptx','jpg','mp3','zip','py','bin'][(doc_id % 12 + 1)::INT] AS ext FROM documents),
f1 AS (SELECT *, '/lib/' || source || '/' || lang AS parent,
  coalesce(list_filter(regexp_extract_all(replace(strip_accents(lower(text)), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+'), lambda x: strlen(x) < 48)[1], 'empty') || '-' || doc_id || '.' || ext AS name,
  CASE WHEN doc_id % 37 = 0 AND ext NOT IN ('jpg','mp3','zip','bin') THEN 'failed' END AS status FROM f0),
files AS (SELECT doc_id AS file_id, ext, parent, name, parent || '/' || name AS path, 'lib ' || source || '/' || lang AS dir_text,
  CASE WHEN ext NOT IN ('jpg','mp3','zip','bin') AND status IS NULL THEN text END AS content,
  (1704067200 + doc_id * 3600)::BIGINT AS mtime, strlen(text)::BIGINT AS size, status,
  CASE WHEN status IS NOT NULL THEN ['encrypted','timed-out','crashed','unreadable'][((doc_id // 37) % 4 + 1)::INT] END AS failure,
  CASE ext {_CASES} ELSE 'other' END AS category FROM f1)""".replace("\\\\", "\\")
TOKENS = FILES + r""",
lists AS (SELECT file_id, u.field, list_filter(regexp_extract_all(replace(strip_accents(lower(u.t)), 'ß', 'ss'), '[\p{L}\p{N}]+'), lambda x: strlen(x) < 48) AS l
  FROM (SELECT file_id, unnest([{'field': 'name', 't': name}, {'field': 'dir', 't': dir_text}, {'field': 'content', 't': coalesce(content, '')}]) AS u FROM files)),
tok AS (SELECT field, file_id, unnest(l) AS term, unnest(range(len(l))) AS pos FROM lists),
post AS (SELECT field, term, file_id, count(*) AS tf FROM tok GROUP BY ALL),
dict AS (SELECT field, term, count(*) AS df FROM post GROUP BY ALL),
lens AS (SELECT file_id, field, len(l) AS len FROM lists),
avgs AS (SELECT field, sum(len)::DOUBLE / count(*) AS av, count(*)::DOUBLE AS n FROM lens GROUP BY ALL)"""


def searched(words: list[tuple[str, str, bool, bool]] = (), phrases: list[list[str]] = (), excluded: list[str] = (), where: str = "TRUE", order: str = "score DESC, path", limit: int = 20, columns: str = "file_id, path, score, matches") -> str:
    """SQL of a search. words: (word, fields, prefix, fuzzy)."""
    values = ", ".join(f"({i}, '{w}', '{f}', {str(p).upper()}, {str(z).upper()})" for i, (w, fs, p, z) in enumerate(words) for f in fs.split())
    sql = "WITH " + TOKENS
    hits = []
    if words:
        sql += f""",
asks(clause, word, field, prefix, fuzzy) AS (VALUES {values}),
cand AS (SELECT clause, field, term, df, term = word AS exact, prefix AND len(word) >= 2 AND starts_with(term, word) AS begins,
  CASE WHEN NOT fuzzy OR len(word) < 4 OR regexp_full_match(word, '[0-9]+') THEN 0 WHEN len(word) < 8 THEN 1 ELSE 2 END AS most,
  CASE WHEN fuzzy AND abs(len(term) - len(word)) <= 2 THEN damerau_levenshtein(term, word) ELSE 99 END AS d FROM dict JOIN asks USING (field)),
c2 AS (SELECT *, most > 0 AND d <= most AS near FROM cand WHERE exact OR begins OR (most > 0 AND d <= most)),
c3 AS (SELECT *, sum(begins::INT) OVER w AS pn, sum(near::INT) OVER w AS fn FROM c2 WINDOW w AS (PARTITION BY clause, field ORDER BY term)),
c4 AS (SELECT *, greatest(CASE WHEN exact THEN 1.0 ELSE 0.0 END, CASE WHEN begins AND pn <= 64 THEN 0.6 ELSE 0.0 END,
  CASE WHEN near AND fn <= 64 THEN CASE d WHEN 0 THEN 1.0 WHEN 1 THEN 0.45 ELSE 0.3 END ELSE 0.0 END)::DOUBLE AS mult FROM c3),
terms AS (SELECT clause, field, term, df, mult FROM c4 WHERE mult > 0
  QUALIFY row_number() OVER (PARTITION BY clause, field ORDER BY mult DESC, df DESC, term) <= 40)"""
        hits.append("SELECT clause, field, file_id, tf, mult, df FROM terms JOIN post USING (field, term)")
    for i, p in enumerate(phrases):
        join = " ".join(f"JOIN tok t{k} ON t{k}.field = t0.field AND t{k}.file_id = t0.file_id AND t{k}.pos = t0.pos + {k} AND t{k}.term = '{t}'" for k, t in enumerate(p) if k)
        sql += f""",
ph{i} AS (SELECT t0.field, t0.file_id, count(*) AS tf FROM tok t0 {join} WHERE t0.term = '{p[0]}' AND t0.field IN ('name', 'content') GROUP BY ALL)"""
        hits.append(f"SELECT {len(words) + i}, field, file_id, tf, 1.0::DOUBLE, count(*) OVER (PARTITION BY field) FROM ph{i}")
    if hits:
        own = " UNION ".join((["SELECT term FROM terms WHERE field IN (SELECT field FROM asks)"] if words else []) + [f"SELECT '{t}'" for p in phrases for t in p])
        sql += f""",
hits(clause, field, file_id, tf, mult, df) AS ({' UNION ALL '.join(hits)}),
found AS (SELECT file_id, round(sum(mult * CASE field WHEN 'name' THEN 2.5 WHEN 'dir' THEN 0.8 ELSE 1.0 END::DOUBLE
  * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / av)))), 6) AS score
  FROM hits JOIN lens USING (file_id, field) JOIN avgs USING (field) GROUP BY file_id HAVING count(DISTINCT clause) = {len(words) + len(phrases)}),
marks AS (SELECT file_id, sum(tf)::BIGINT AS matches FROM post WHERE field IN ('name', 'content') AND term IN ({own}) GROUP BY file_id),
every AS (SELECT files.*, score, coalesce(matches, 0)::BIGINT AS matches FROM files JOIN found USING (file_id) LEFT JOIN marks USING (file_id))"""
    else:
        sql += ", every AS (SELECT *, 0.0::DOUBLE AS score, 0::BIGINT AS matches FROM files)"
    gone = "".join(f" AND file_id NOT IN (SELECT file_id FROM post WHERE term = '{t}')" for t in excluded)
    return sql + f" SELECT {columns} FROM every WHERE {where}{gone}" + (f" ORDER BY {order} LIMIT {limit}" if limit else "")


# ---- queries ------------------------------------------------------------

ROOTS = [("/lib/src1", True), ("/lib/src1/en", False), ("/lib/src2/fr", False), ("/lib/src3", True), ("/lib", False)]
OUT = ("file_id", "path", "score", "matches")
ALL3 = "name dir content"


def _index(spark: SparkSession, d: str, request: Request) -> Index:
    """Filters alone need no index; words share that of the session."""
    q = parse(request.query)
    return session_index(spark, d) if q.has_terms or q.excluded else Index(files(spark, d))


def _search(columns=OUT, **request) -> Callable[[SparkSession, str], DataFrame]:
    ask = Request(**{"limit": 20, "word_forms": False} | request)
    return lambda spark, d: search(_index(spark, d, ask), ask).select(*columns)


def _total(**request):
    ask = Request(**{"word_forms": False} | request)
    return lambda spark, d: total(_index(spark, d, ask), ask)


def _listing(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("path", "mtime", "size")


def _indexed(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot that misses every seventh file, is behind on every fifth, and holds vanished paths."""
    f = files(spark, d)
    some = f.where("file_id % 7 <> 0").select("path", (F.col("mtime") - F.when(F.col("file_id") % 5 == 0, 1).otherwise(0)).alias("mtime"), "size")
    return some.unionByName(f.where("file_id % 11 = 0").select(F.concat("path", F.lit(".old")).alias("path"), "mtime", "size"))


INDEXED = """, indexed AS (SELECT path, mtime - CASE WHEN file_id % 5 = 0 THEN 1 ELSE 0 END AS mtime, size FROM files WHERE file_id % 7 <> 0
  UNION ALL SELECT path || '.old', mtime, size FROM files WHERE file_id % 11 = 0)"""


def _postings(spark, d):
    p = Index(spread(files(spark, d))).postings
    return p.select("field", "term", "file_id", F.col("tf").cast("long").alias("tf"), F.element_at("positions", 1).cast("long").alias("first_pos"), F.element_at("positions", -1).cast("long").alias("last_pos"))


def _upkept(spark: SparkSession, d: str) -> Index:
    """An index of an older state of the files, brought up to date: every seventh file was missing, every fifth
    had another text, and there were files that have vanished since."""
    now = spread(files(spark, d))
    old = now.where("file_id % 7 <> 0").withColumn("content", F.when(F.col("file_id") % 5 == 0, F.concat(F.lit("former words "), "content")).otherwise(F.col("content")))
    vanished = now.where("file_id % 11 = 0").withColumn("path", F.concat("path", F.lit(".old"))).withColumn("file_id", -1 - F.col("file_id"))
    path = f"{shared_dir(spark)}/upkept-{uuid.uuid4().hex}"
    write_index(old.unionByName(vanished), path)
    # in two updates, so that one comes on top of the other
    update_index(spark, path, now.where("file_id % 7 = 0"), vanished.where("file_id % 2 = 0").select("path"))
    update_index(spark, path, now.where("file_id % 5 = 0"), vanished.where("file_id % 2 <> 0").select("path"))
    return open_index(spark, path)


#: Words of many scripts, dealt to the documents in turn.
SCRIPTS = ("हिन्दी भाषा में", "தமிழ் மொழி", "ภาษาไทย ๑๒", "Größe ÆØ_x Ístanbul", "日本語、テスト", "עברית שָׁלוֹם", "ελληνικά 3½", "русский ёж")
#: Signs of those scripts that are parts of words and neither letters nor numbers, as ranges for the SQL. Fixed values.
SIGNS = "\u0345\u05b0-\u05bd\u05bf\u05c1\u05c2\u05c4\u05c5\u05c7\u0900-\u0903\u093a\u093b\u093e-\u094c\u094e\u094f\u0955-\u0957\u0bbe-\u0bc2\u0bc6-\u0bc8\u0bca-\u0bcc\u0bd7\u0e31\u0e34-\u0e3a\u0e4d"


def _scripts(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{d}/documents.parquet"))
    more = F.element_at(F.array(*map(F.lit, SCRIPTS)), (F.col("doc_id") % len(SCRIPTS) + 1).cast("int"))
    terms = tokenize(F.concat_ws(" ", F.coalesce("text", F.lit("")), more))
    return docs.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def _scripts_sql() -> str:
    source, target = fold_map()
    folded = f"translate(lower(x), '{source}', '{target}')"
    for one, two in PAIRS.items():
        folded = f"replace({folded}, '{one}', '{two}')"
    samples = ", ".join(f"'{t}'" for t in SCRIPTS)
    # as in Spark, words are split first and folded then
    return f"""WITH w AS (SELECT unnest(regexp_extract_all(coalesce(text, '') || ' ' || [{samples}][(doc_id % {len(SCRIPTS)} + 1)::INT], '[\\p{{L}}\\p{{N}}{SIGNS}]+')) AS x FROM documents)
SELECT unnest(regexp_extract_all({folded}, '[^ ]+')) AS term, count(*) AS n FROM w WHERE strlen(x) < 48 GROUP BY term""".replace("\\\\", "\\")


def _library(spark: SparkSession, d: str) -> DataFrame:
    """The folders of a library after its rows were added in several orders, in the order it keeps."""
    library = Library()
    for folder, deep in [("/lib/src3", True), *ROOTS, ("/lib/src9/en/", False), ("/lib/src2", True)]:
        library.add(folder, deep)
    library.remove("/lib/src9/en")
    return spark.createDataFrame([(i, f, deep) for i, (f, deep) in enumerate(library.folders.items())], "place int, folder string, deep boolean")


def _previews(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a table of words a line, as its preview shows it."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.split(x, " "))
    shown = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", preview_rows(lines).alias("rows"))
    return shown.select(
        "doc_id",
        F.size("rows").cast("long").alias("n_rows"),
        F.array_join(column_widths(F.col("rows")).cast("array<string>"), ",").alias("widths"),
        matching_cells(F.col("rows"), ["the", "555"]).cast("long").alias("matching"),
    )


PREVIEWS = r"""WITH r AS (SELECT doc_id, list_transform(list_filter(list_transform(string_split(coalesce(text, ''), chr(10))[1:500], lambda l: string_split(l, ' ')),
  lambda c: coalesce(list_bool_or(list_transform(c, lambda x: regexp_matches(x, '[^\s\x{0b}\x{85}\p{Z}]'))), FALSE)), lambda c: c[1:40]) AS rows FROM documents)
SELECT doc_id, len(rows)::BIGINT AS n_rows,
  coalesce(array_to_string(list_transform(range(1, coalesce(list_max(list_transform(rows, lambda c: len(c))), 0) + 1), lambda i: list_max(list_transform(rows, lambda c: coalesce(length(c[i]), 0)))), ','), '') AS widths,
  len(list_filter(flatten(rows), lambda c: list_has_any(list_filter(regexp_extract_all(replace(strip_accents(lower(c)), 'ß', 'ss'), '[\p{L}\p{N}]+'), lambda x: strlen(x) < 48), ['the', '555'])))::BIGINT AS matching FROM r"""


def _decoded(spark: SparkSession, d: str) -> DataFrame:
    """Texts written as bytes in three encodings and read again."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    utf8 = F.encode("text", "UTF-8")
    data = F.when(F.col("doc_id") % 3 == 0, F.encode("text", "UTF-16")).when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("EFBBBF")), utf8)).otherwise(utf8)
    return docs.select("doc_id", extract_udf(F.lit("txt"), data).alias("x")).select("doc_id", F.md5("x.text").alias("text_md5"), "x.failure")


def _change_state(spark: SparkSession, d: str) -> DataFrame:
    """The state after the events came in three batches, none of them in order."""
    events = from_events(spark.read.parquet(f"{d}/events.parquet"))
    state = coalesced(events.where("seq % 3 = 1"))
    for i in (2, 0):
        state = apply_batch(state, events.where(F.col("seq") % 3 == i))
    return alive(state).select("path", "seq")


def _shown_hits(spark: SparkSession, d: str) -> DataFrame:
    """What a list of results shows of each file: marked text, its description, the match before the current one."""
    segments = F.array(
        F.struct(F.concat("dir_text", F.lit(" & <"), "ext", F.lit(">'\"")).alias("text"), F.lit(False).alias("highlighted")),
        F.struct(F.col("name").alias("text"), F.lit(True).alias("highlighted")),
    )
    passage = F.when(F.col("file_id") % 3 == 0, " ").when(F.col("file_id") % 3 == 1, F.col("name"))
    before = next_match(F.col("file_id") % 5, -1, F.col("file_id") % 7)
    return files(spark, d).select("file_id", markup(segments).alias("marked"), description(passage, F.col("parent")).alias("description"), before.cast("long").alias("before"))


def _natural(spark, d):
    from quarry.functions.text import natural_key

    prefix, number = natural_key(F.col("name"))
    return files(spark, d).select("file_id", prefix.alias("prefix"), number.alias("number"))


def _export(spark, d):
    from pyspark.sql import Window

    top = search(session_index(spark, d), Request("the of ", limit=10, fuzzy=False, word_forms=False))
    rank = F.row_number().over(Window.orderBy(F.desc("score"), "path")) - 1
    return top.select("file_id", F.round(F.greatest(F.lit(1.0) - F.lit(0.05) * rank, F.lit(0.1)), 6).alias("relevance"))


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "files_view": (
        lambda s, d: files(s, d).select("file_id", "ext", "name", "path", "dir_text", F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("content_chars"), "mtime", "size", "status", "failure", "category"),
        f"WITH {FILES} SELECT file_id, ext, name, path, dir_text, coalesce(length(content), 0)::BIGINT AS content_chars, mtime, size, status, failure, category FROM files",
    ),
    "tokenize_counts": (
        lambda s, d: tokens(spread(files(s, d)), ("content",)).groupBy("term").agg(F.count("*").alias("n")),
        f"WITH {TOKENS} SELECT term, count(*) AS n FROM tok WHERE field = 'content' GROUP BY term",
    ),
    "postings_build": (_postings, f"WITH {TOKENS} SELECT field, term, file_id, count(*) AS tf, min(pos) AS first_pos, max(pos) AS last_pos FROM tok GROUP BY ALL"),
    "dictionary_df": (lambda s, d: Index(spread(files(s, d))).dictionary, f"WITH {TOKENS} SELECT * FROM dict"),
    "field_lengths": (lambda s, d: Index(spread(files(s, d))).lengths, f"WITH {TOKENS} SELECT file_id, field, len::BIGINT AS len FROM lens"),
    "search_bm25_topk": (_search(query="thtion attion ", fuzzy=False), searched([("thtion", ALL3, False, False), ("attion", ALL3, False, False)])),
    "search_exact_and": (_total(query="thtion that ", fuzzy=False), searched([("thtion", ALL3, False, False), ("that", ALL3, False, False)], limit=0, columns="count(*) AS total")),
    "search_multifield_boost": (_search(query="src1 the ", fuzzy=False), searched([("src1", ALL3, False, False), ("the", ALL3, False, False)])),
    "search_prefix": (_search(query="the thtio", fuzzy=False), searched([("the", ALL3, False, False), ("thtio", ALL3, True, False)])),
    "search_fuzzy": (_search(query="thanedble thtion "), searched([("thanedble", ALL3, False, True), ("thtion", ALL3, False, True)])),
    "search_phrase": (_search(query='"the of"'), searched(phrases=[["the", "of"]])),
    "search_phrase_and_word": (_search(query='thtion "of the" ', fuzzy=False), searched([("thtion", ALL3, False, False)], [["of", "the"]])),
    "search_exclude": (_search(query="thtion -that -src3 ", fuzzy=False), searched([("thtion", ALL3, False, False)], excluded=["that", "src3"])),
    "search_name": (_search(query="name:the that ", fuzzy=False), searched([("that", ALL3, False, False), ("the", "name", True, False)])),
    "search_in_folder": (
        _search(query="in:src5 that ", fuzzy=False, columns=("file_id", "path", "score")),
        searched([("that", ALL3, False, False), ("src5", "dir", True, False)], columns="file_id, path, score"),
    ),
    "search_type": (_search(query="that type:pdf type:code ", fuzzy=False), searched([("that", ALL3, False, False)], where="category IN ('pdf', 'text')")),
    "filter_type": (_search(query="type:image ext:py", limit=50), searched(where="category = 'image' OR ext = 'py'", order="mtime DESC, path", limit=50)),
    "filter_since": (_search(modified_since=1704067200 + 3600 * 100, limit=30), searched(where=f"mtime >= {1704067200 + 3600 * 100}", order="mtime DESC, path", limit=30)),
    "filter_folder_recursive": (_search(folder=("/lib/src1", True), limit=40), searched(where="starts_with(path, '/lib/src1/')", order="mtime DESC, path", limit=40)),
    "filter_folder_flat": (_search(folder=("/lib/src1/en", False), limit=40), searched(where="parent = '/lib/src1/en'", order="mtime DESC, path", limit=40)),
    "sort_newest": (_search(query="that ", sort="newest", fuzzy=False), searched([("that", ALL3, False, False)], order="mtime DESC, path")),
    "sort_oldest": (_search(query="that ", sort="oldest", fuzzy=False), searched([("that", ALL3, False, False)], order="mtime, path")),
    "sort_largest": (_search(query="that ", sort="largest", fuzzy=False), searched([("that", ALL3, False, False)], order="size DESC, path")),
    "sort_name": (_search(query="that ", sort="name", fuzzy=False), searched([("that", ALL3, False, False)], order="lower(name), path")),
    "total_hits": (_total(query="that -of ", fuzzy=False), searched([("that", ALL3, False, False)], excluded=["of"], limit=0, columns="count(*) AS total")),
    "export_relevance": (
        _export,
        f"SELECT file_id, round(greatest(1.0::DOUBLE - 0.05::DOUBLE * (row_number() OVER (ORDER BY score DESC, path) - 1), 0.1::DOUBLE), 6) AS relevance FROM ({searched([('the', ALL3, False, False), ('of', ALL3, False, False)], limit=10)})",
    ),
    "folder_counts": (
        lambda s, d: sync.folder_counts(files(s, d), ROOTS),
        f"WITH {FILES} " + " UNION ALL ".join(f"SELECT '{r}' AS root, count(*) FILTER (WHERE {f'''starts_with(path, '{r}/')''' if deep else f'''parent = '{r}' '''}) AS files FROM files" for r, deep in ROOTS),
    ),
    "failed_files": (
        lambda s, d: files(s, d).where("status = 'failed'").select("path", "failure").orderBy("path").limit(1000),
        f"WITH {FILES} SELECT path, failure FROM files WHERE status = 'failed' ORDER BY path LIMIT 1000",
    ),
    "failed_count": (
        lambda s, d: files(s, d).agg(F.count_if(F.col("status") == "failed").alias("failed"), F.count("*").alias("num_docs")),
        f"WITH {FILES} SELECT count(*) FILTER (WHERE status = 'failed') AS failed, count(*) AS num_docs FROM files",
    ),
    "extraction_stats": (
        lambda s, d: files(s, d).groupBy("category").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")),
        f"WITH {FILES} SELECT category, count(*) AS files, sum(size)::BIGINT AS bytes FROM files GROUP BY category",
    ),
    "glob_exclusions": (
        lambda s, d: files(s, d).where(~skips(F.expr("substring(path, 6)"), names=("the*", "?r", "*.ZIP"))).select("file_id"),
        f"WITH {FILES} SELECT file_id FROM files WHERE NOT list_bool_or(list_transform(string_split(path[6:], '/'), lambda c: starts_with(c, '.') OR regexp_full_match(lower(c), 'the.*', 's') OR regexp_full_match(lower(c), '.r', 's') OR regexp_full_match(lower(c), '.*\\.zip', 's')))",
    ),
    "natural_sort": (
        _natural,
        f"WITH {FILES} SELECT file_id, regexp_extract(s, '^(.*?)([0-9]*)$', 1) AS prefix, coalesce(nullif(regexp_extract(s, '([0-9]+)$', 1), '')::BIGINT, 0) AS number FROM (SELECT file_id, regexp_replace(name, '\\.[^.]*$', '') AS s FROM files)",
    ),
    "sync_changed": (
        lambda s, d: sync.changed(_listing(s, d), _indexed(s, d)).select("path", "mtime", "change"),
        f"WITH {FILES}{INDEXED} SELECT files.path, files.mtime, CASE WHEN i.path IS NULL THEN 'new' ELSE 'changed' END AS change FROM files LEFT JOIN indexed i ON files.path = i.path WHERE i.path IS NULL OR i.mtime <> files.mtime OR i.size <> files.size",
    ),
    "sync_deleted": (
        lambda s, d: sync.deleted(_listing(s, d), _indexed(s, d), ("/lib/src2",)).select("path"),
        f"WITH {FILES}{INDEXED} SELECT path FROM indexed WHERE NOT starts_with(path, '/lib/src2/') AND path NOT IN (SELECT path FROM files)",
    ),
    "sync_upsert": (
        lambda s, d: sync.upsert(_indexed(s, d), sync.changed(_listing(s, d), _indexed(s, d)).drop("change"), sync.deleted(_listing(s, d), _indexed(s, d), ("/lib/src2",))),
        f"WITH {FILES}{INDEXED} SELECT path, mtime, size FROM files UNION ALL SELECT * FROM indexed WHERE starts_with(path, '/lib/src2/') AND path NOT IN (SELECT path FROM files)",
    ),
    "sync_first_root": (
        lambda s, d: sync.first_root(files(s, d).select("path"), ROOTS),
        f"WITH {FILES} SELECT path, CASE WHEN starts_with(path, '/lib/src1/') THEN '/lib/src1' WHEN parent = '/lib/src2/fr' THEN '/lib/src2/fr' WHEN starts_with(path, '/lib/src3/') THEN '/lib/src3' END AS root FROM files",
    ),
    "classify_files": (
        lambda s, d: classified(files(s, d).select("file_id", "name", (F.col("size") * 100_000).alias("size"))),
        f"WITH {FILES} SELECT file_id, name, size * 100000 AS size, ext, CASE WHEN size * 100000 <= CASE WHEN k IN ('text', 'html', 'rtf') THEN 33554432 ELSE 268435456 END THEN k END AS kind FROM (SELECT *, CASE ext {_KINDS} END AS k FROM files)",
    ),
    "displayed_values": (
        lambda s, d: files(s, d).select(
            "file_id",
            format_date(F.col("mtime"), F.lit("2024-01-20 12:00:00").cast("timestamp")).alias("date"),
            format_count(F.col("mtime"), "es").alias("count"),
            display_path(F.col("path"), "/lib/src1").alias("shown"),
            display_name(F.col("path")).alias("name"),
            failure_text(F.col("failure")).alias("failure"),
        ),
        f"""WITH {FILES} SELECT file_id, CASE WHEN m::DATE = DATE '2024-01-20' THEN strftime(m, '%H:%M') WHEN year(m) = 2024 THEN strftime(m, '%-d %b') ELSE strftime(m, '%-d %b %Y') END AS date,
  replace(format('{{:,}}', mtime), ',', '.') AS count, CASE WHEN starts_with(path, '/lib/src1/') THEN '~' || substr(path, 10) ELSE path END AS shown, name,
  CASE failure WHEN 'encrypted' THEN 'Password protected' WHEN 'timed-out' THEN 'Took too long to read' WHEN 'crashed' THEN 'Couldn''t be read safely' WHEN 'unreadable' THEN 'Damaged or unsupported' END AS failure
  FROM (SELECT *, make_timestamp(mtime * 1000000) AS m FROM files)""",
    ),
    "filter_category": (
        _search(query="type:pdf ext:csv ext:jpg", categories=("pdf", "spreadsheet"), limit=60),
        searched(where="category IN ('pdf', 'spreadsheet') AND (category = 'pdf' OR ext IN ('csv', 'jpg'))", order="mtime DESC, path", limit=60),
    ),
    "filter_chips": (_search(categories=categories_of(["media", "document"]), limit=70), searched(where="category IN ('audio', 'video', 'document')", order="mtime DESC, path", limit=70)),
    "filter_date_range": (
        _search(modified_since=since("month", datetime(2024, 2, 5, tzinfo=UTC)), sort="oldest", limit=30),
        searched(where=f"mtime >= {1707091200 - 30 * 86400}", order="mtime, path", limit=30),
    ),
    "empty_request": (_search(), searched(where="FALSE")),
    "search_unmatchable": (_search(query="zzqxvw that ", fuzzy=False), searched([("zzqxvw", ALL3, False, False), ("that", ALL3, False, False)])),
    "match_all_excluding": (_total(query="-that "), searched(excluded=["that"], limit=0, columns="count(*) AS total")),
    "exclude_phrase": (
        _search(query='that -"of the" ', fuzzy=False),
        searched(
            [("that", ALL3, False, False)],
            where="file_id NOT IN (SELECT a.file_id FROM tok a JOIN tok b ON b.field = a.field AND b.file_id = a.file_id AND b.pos = a.pos + 1 AND b.term = 'the' WHERE a.term = 'of')",
        ),
    ),
    "excluded_folders": (
        lambda s, d: files(s, d).where(~excluded(F.col("path"), ("/lib/src1/en", "/lib/src4/"))).select("file_id"),
        f"WITH {FILES} SELECT file_id FROM files WHERE NOT starts_with(path, '/lib/src1/en/') AND NOT starts_with(path, '/lib/src4/')",
    ),
    "folder_coverage": (
        lambda s, d: files(s, d).select("file_id", covers(F.col("path"), F.col("parent"), "/lib/src1", True).alias("deep"), covers(F.col("path"), F.col("parent"), "/lib/src1/en/", False).alias("flat")),
        f"WITH {FILES} SELECT file_id, starts_with(path, '/lib/src1/') AS deep, parent = '/lib/src1/en' AS flat FROM files",
    ),
    "delete_subtree": (
        lambda s, d: sync.delete_under(_listing(s, d), "/lib/src3"),
        f"WITH {FILES} SELECT path, mtime, size FROM files WHERE NOT starts_with(path, '/lib/src3/')",
    ),
    "folder_total": (
        lambda s, d: sync.total_files(files(s, d), ROOTS),
        f"WITH {FILES} SELECT count(*) FILTER (WHERE starts_with(path, '/lib/src1/')) + count(*) FILTER (WHERE parent = '/lib/src1/en') + count(*) FILTER (WHERE parent = '/lib/src2/fr') + count(*) FILTER (WHERE starts_with(path, '/lib/src3/')) + count(*) FILTER (WHERE parent = '/lib') AS files FROM files",
    ),
    "preview_tables": (_previews, PREVIEWS),
    "decoded_texts": (_decoded, "SELECT doc_id, md5(coalesce(text, '')) AS text_md5, NULL::VARCHAR AS failure FROM documents"),
    "shown_hits": (
        _shown_hits,
        f"""WITH {FILES} SELECT file_id, dir_text || ' &amp; &lt;' || ext || '&gt;&apos;&quot;<b>' || name || '</b>' AS marked, CASE WHEN file_id % 3 = 1 THEN name ELSE parent END AS description,
  CASE WHEN file_id % 7 > 0 THEN (file_id % 5 - 1 + file_id % 7) % (file_id % 7) END AS before FROM files""",
    ),
    "change_state": (
        _change_state,
        "SELECT '/lib/user' || user_id || '.txt' AS path, arg_max(event_id, (ts, event_id)) AS seq FROM events GROUP BY user_id HAVING arg_max(event_type, (ts, event_id)) <> 'error'",
    ),
    "files_by_folder": (
        lambda s, d: files(s, d).groupBy("parent").agg(F.count("*").alias("files"), F.max("mtime").alias("newest")).orderBy("parent"),
        f"WITH {FILES} SELECT parent, count(*) AS files, max(mtime) AS newest FROM files GROUP BY parent ORDER BY parent",
    ),
    "library_folders": (
        _library,
        "SELECT * FROM (VALUES (0, '/lib', FALSE), (1, '/lib/src1', TRUE), (2, '/lib/src2', TRUE), (3, '/lib/src3', TRUE)) AS t(place, folder, deep)",
    ),
    "tokenize_scripts": (_scripts, _scripts_sql()),
    "index_upkeep": (lambda s, d: _upkept(s, d).dictionary, f"WITH {TOKENS} SELECT * FROM dict"),
    "search_after_upkeep": (
        lambda s, d: search(_upkept(s, d), Request("thtion attion ", limit=20, fuzzy=False, word_forms=False)).select(*OUT),
        searched([("thtion", ALL3, False, False), ("attion", ALL3, False, False)]),
    ),
    "stream_change_dedup": (
        lambda s, d: coalesced(from_events(s.read.parquet(f"{d}/events.parquet"))).select("path", "op", "seq"),
        "SELECT '/lib/user' || user_id || '.txt' AS path, CASE WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN 'delete' ELSE 'upsert' END AS op, arg_max(event_id, (ts, event_id)) AS seq FROM events GROUP BY user_id",
    ),
}


def snippet_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets of the top 10, matches in brackets; SQL can't express it, unit tests cover it."""
    hits = search_snippets(session_index(spark, sf_dir), Request("thtion attion ", limit=10, fuzzy=False, word_forms=False))
    shown = F.transform("snippet", lambda x: F.when(x["highlighted"], F.concat(F.lit("["), x["text"], F.lit("]"))).otherwise(x["text"]))
    return hits.select("file_id", "path", F.array_join(shown, "").alias("snippet"))


def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of every page; SQL can't express it, unit tests cover it."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", html_text_udf("html").alias("text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    unsaid = {"html_to_text": html_to_text, "snippet_topk": snippet_topk, "search_word_forms": _search(query="attions thtioned ", word_forms=True)}
    return {k: v[0] for k, v in QUERIES.items()} | unsaid


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in QUERIES.items()}
