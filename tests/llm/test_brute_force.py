"""Queries without SQL, and odd rows, against plain versions of their contracts."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import dartminhash, decision_list, decontaminate, html_layout, importance, mixing, passages, pii, sharding, wordpiece

BLANK = r"[^\x20\x09-\x0D]+"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "x", "y") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, size string, shard string")


def words_of(seed, n, letters="abcdefghij"):
    r = random.Random(seed)
    return ["".join(r.choices(letters, k=r.randint(2, 7))) for _ in range(n)]


def prose(seed, n):
    return " ".join(words_of(seed, n))


# ---- 3: the draw, sizes and checksums -------------------------------------------


def spark_hash(values, seed=42):
    """64-bit hash of numbers, as public: little-endian bytes, each hashed with the last hash as seed."""
    for value, size in values:
        if value is not None:
            seed = xxhash.xxh64_intdigest(value.to_bytes(size, "little", signed=True), seed=seed)
    return seed


def test_sharding_against_brute_force(spark):
    texts = [None, "", "é", "日本語", "a" * 100_000, "plain"]
    rows = [(i if i % 50 else None, texts[i % 6], "a") for i in range(600)]
    out = sharding.op3_rendezvous_sharding(make(spark, rows)).collect()

    def bid(key, shard):
        u = ((spark_hash([(key, 8), (shard, 4), (11, 4)]) >> 12) + 0.5) / float(1 << 52)
        return -1.0 / math.log(u)

    def shard_of(key, n):
        return max(range(n), key=lambda s: (bid(key, s), -s))

    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), shard_of(i, 16), shard_of(i, 17)) for i, t, _ in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in out) == want
    assert {r["law"] for r in out} == {"key"}


# ---- 6: statistics and the learned list -----------------------------------------


def statistics(text):
    text = text or ""
    words = re.findall(BLANK, text)
    windows, held = {}, set()
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in windows.values():
        if len(at) > 1:
            held.update(i + k for i in at for k in range(3))
    lines = [x for x in text.split("\n") if re.search(BLANK, x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(held)


def test_statistics_against_brute_force(spark):
    r = random.Random(8)
    texts = [None, "", " \n\t", "x"]
    for _ in range(120):
        texts.append("".join(r.choice(["a ", "b ", "é ", "a b ", "# ", "c\n", "\n", " ", "\x0b", "<x> ", "a b\n"]) for _ in range(r.randint(0, 80))))
    texts += ["same line here\n" * 400, " ".join(words_of(1, 300_000, "ab")), "w " * 60_000]
    out = decision_list.op6_decision_list(make(spark, list(zip(range(len(texts)), texts, "a" * len(texts)))), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    for row in out.collect():
        n, chars, symbols, dups, repeats = statistics(texts[row["doc_id"]])
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == (n, chars, symbols, dups, repeats)
        assert row["base_failed"] == (n < 50 or 100 * repeats > 50 * n) and row["kept"] == (not row["base_failed"])


def test_windows_whose_keys_are_equal_are_compared(spark, monkeypatch):
    # a hash of few values: nearly all windows share keys
    monkeypatch.setattr(decision_list.F, "xxhash64", lambda *cols: F.pmod(F.crc32(F.concat_ws(" ", *cols)), F.lit(5)).cast("long"))
    texts = [" ".join(words_of(s, 200, "ab")[:n]) for s in range(10) for n in (3, 50, 200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for row in decision_list.measure(df).select("i", "_stats.n_repeat_words").collect():
        assert row["n_repeat_words"] == statistics(texts[row["i"]])[4]


# ---- 7: visible text ----------------------------------------------------------------


def page_of(r, depth=0):
    """A random page and its visible words in order."""
    out, words = [], []
    for _ in range(r.randint(1, 4)):
        kind = r.choice(["text", "p", "div", "ul", "table", "hidden", "script", "span", "select"] if depth < 4 else ["text"])
        if kind == "text":
            w = words_of(r.random(), r.randint(1, 4))
            out.append(" ".join(w) + " ")
            words += w
        elif kind in ("hidden", "script"):
            out.append("<div style='display:none'>no <b>no</b></div>" if kind == "hidden" else "<script>if (a<b) {'<p>'}</script>")
        else:
            inner, own = page_of(r, depth + 1)
            words += own
            out.append({"p": f"<div>{inner}</div>", "ul": f"<ul><li>{inner}</ul>", "table": f"<table><tr><td>{inner}</td></tr></table>", "select": f"<span>{inner}</span>"}.get(kind, f"<{kind}>{inner}</{kind}>"))
    return "".join(out), words


def test_all_visible_words_stay_in_order():
    r = random.Random(3)
    for _ in range(300):
        page, words = page_of(r)
        assert re.findall("[a-j]{2,}", html_layout.render(page)) == words


@pytest.mark.parametrize(
    "page,text",
    [
        ("<button>Buy</button><select><option>One<option>Two</select><textarea>\nhi &amp; ho</textarea>", "Buy One Two hi & ho"),
        ("<input value=a><input type=hidden value=b><input type=submit value='c d'>", "a c d"),
        ("<table><tr><td rowspan=2>A<td>b<tr><td>c</table>", "A  b\n   c"),
        ("<table><tr><td colspan=12345>A<td>b<tr><td>c</table>", "A  b\nc"),
        ("<table><tr><td colspan=2>long cell<td>d<tr><td>a<td>b<td>c</table>", "long cell     d\na          b  c"),
        ("<p title='a>b'>x<a href='cut", "x"),
        ("<dialog>no</dialog><svg><title>no</title><text>yes</text></svg>", "yes"),
    ],
)
def test_forms_spans_and_cut_tags(page, text):
    assert html_layout.render(page) == text


@pytest.mark.parametrize("piece", ["<a ", "<div>", "<b></i>", '<a x="', "<a '>'", "<ul><li>x", "<p><table><td><div>", "<!", "<tr><td rowspan=9999>x<td>y", "<table><tr><td>x", "<select><option>x"])
def test_broken_pages_take_time_in_proportion(piece):
    import time

    took = []
    for n in (4000, 16000):
        began = time.process_time()
        html_layout.render("<table>" * ("<tr>" in piece) + piece * n)
        took.append(time.process_time() - began)
    assert took[1] < 0.5 or took[1] < 10 * took[0]


def test_html_query_over_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "<p>a"), (3, "<b>x"), (3, "<b>x"), (4, "<p>" + prose(1, 50_000))]
    df = spark.createDataFrame([(i, "u", h, "t") for i, h in rows], "page_id long, url string, html string, text string")
    out = html_layout.op7_layout_html(df)
    assert out.columns == ["page_id", "text"]
    assert sorted((str(r["page_id"]), str(r["text"])) for r in out.collect()) == sorted((str(i), str(html_layout.render(h))) for i, h in rows)
    assert html_layout.op7_layout_html(df.limit(0)).count() == 0


# ---- 8 and 9 ----------------------------------------------------------------------------


def test_token_query_against_greedy(spark, tmp_path):
    import base64

    vocabulary = [b"a", b"ab", b" a", b" ab", b"bc", " é".encode(), b"abc"]
    (tmp_path / "v").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(vocabulary)))
    pieces = {*vocabulary, *(bytes([b]) for b in range(256))}

    def count(word):
        word, n, i = b" " + word, 0, 0
        while i < len(word):
            i, n = max(j for j in range(i + 1, min(len(word), i + 4) + 1) if word[i:j] in pieces), n + 1
        return n

    r = random.Random(2)
    rows = [(i, "".join(r.choices("abcé \n", k=40)), "a") for i in range(100)] + [(100, None, "a"), (101, "", "a"), (102, "abc" * 5000, "a")]
    for row in wordpiece.count_tokens(make(spark, rows), path=str(tmp_path / "v")).collect():
        words = (rows[row["doc_id"]][1] or "").encode().split()
        assert (row["n_words"], row["n_tokens"]) == (len(words), sum(map(count, words)))


def test_importance_against_brute_force(spark):
    rows = [(i, prose(i % 9, 30) + " " + prose(i, 5), "a") for i in range(60)] + [(60, None, "a"), (61, "", "a")]
    labels = [(i, i % 2, 0) for i in range(20)] + [(2, 1, 1), (99, 1, 0), (None, 1, 0)]
    out = {r["doc_id"]: r for r in importance.select(make(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), keep_share=0.3).collect()}
    buckets = importance.BUCKETS
    counts = {i: np.bincount(importance.grams((t or "").encode(), buckets), minlength=buckets) for i, t, _ in rows}
    good = {d for d, q, x in labels if q == 1 and x == 0}
    raw, target = sum(counts.values()), sum(c for i, c in counts.items() if i in good)
    p = lambda c: np.log((c + 1.0) / (c.sum() + buckets))
    ratio = p(target) - p(raw)
    for i, c in counts.items():
        assert out[i]["n_grams"] == c.sum() and abs(out[i]["log_weight"] - (c * ratio).sum()) < 1e-6
    least = sorted((r["key"] for r in out.values()), reverse=True)[round(0.3 * len(rows)) - 1]
    assert all(r["kept"] == (r["key"] >= least) for r in out.values())


# ---- 10 -----------------------------------------------------------------------------------


def plain_spans(text):
    """The contract's patterns as they are written."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return [(s, e, pii.BASE[k]) for s, k, e in sorted(out)]


def test_base_spans_against_plain_patterns(spark):
    r = random.Random(4)
    texts = [None, ""] + ["".join(r.choice(["1", "25", "4111 1111 1111 1111", ".", "-", " ", "+", "(", ")", "@", "a", "é", "b.c", "日", "192.168.1.1", "\n"]) for _ in range(r.randint(1, 40))) for _ in range(1500)]
    out = pii.op10_crf_pii(make(spark, list(zip(range(len(texts)), texts, "a" * len(texts))))).collect()
    for row in out:
        spans = plain_spans(texts[row["doc_id"]] or "")
        assert [row[f"n_{k}"] for k in pii.BASE] == [sum(s[2] == k for s in spans) for k in pii.BASE]
        told = ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
        assert row["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert set(filter(None, told.split(","))) <= set(row["spans"].split(","))


def labels_of(texts):
    crf = pii.Crf(pii.trained().weights, pii.trained().moves)
    words = [t.encode().split() for t in texts]
    labels, at, out = crf.decode(crf.emissions(words)), 0, []
    for w in words:
        out.append(labels[at : at + len(w)].tolist())
        at += len(w) + 2
    return out


def test_texts_are_labelled_alone_as_together():
    r = random.Random(6)
    parts = ["tel", "123-4567", "(555)", "555-0101", "the", "token", "=", '"ab12cd34ef56ab12cd34ef56"', "ssn", "123-45-6789", "key", "mail", "ann", "(at)", "home", "(dot)", "org", "x" * 300, "9" * 300]
    texts = [" ".join(r.choices(parts, k=r.randint(0, 6))) for _ in range(1500)] + ["tel", "123-4567 the key (555) 555"]
    assert labels_of(texts) == [labels_of([t])[0] for t in texts]


# ---- 2, 4, 5 and the pipeline -----------------------------------------------------------


def test_two_texts_with_one_64_bit_hash_stay_apart(spark, monkeypatch):
    from quarry.llm import common

    monkeypatch.setattr(common, "text_pair", lambda text: (F.lit(1).cast("long"), F.xxhash64(F.coalesce(text, F.lit("")))))
    docs = make(spark, [(1, prose(1, 60), "a"), (2, prose(2, 60), "a"), (3, prose(1, 60), "a")])
    assert {r["doc_id"]: r["class_id"] for r in dartminhash.op2_dartminhash(docs).collect()} == {1: 1, 2: 2, 3: 1}


def test_near_duplicates_plan_nothing_twice(spark, monkeypatch):
    # the driver holds each query's whole plan, so what several branches read is a kept table
    joins, keep = [], dartminhash.keep

    def planned(df):
        joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return df

    monkeypatch.setattr(dartminhash, "keep", lambda df: keep(planned(df)))
    chain = words_of(6, 160)
    docs = make(spark, [(i, " ".join(chain[i : i + 100]), "a") for i in range(0, 60, 3)] + [(100 + i, prose(i, 100), "a") for i in range(5)])
    planned(dartminhash.op2_dartminhash(docs))
    out = planned(dartminhash.drop_near_duplicates(docs)).collect()
    assert sorted(r["doc_id"] for r in out) == [0, *range(100, 105)]
    assert max(joins) <= 8


def test_hot_buckets_change_nothing(spark, monkeypatch):
    shared = prose(5, 60)
    docs = make(spark, [(i, f"{prose(100 + i, 30)} {shared} {prose(200 + i, 30)}", "a") for i in range(40)])
    plain = sorted(map(tuple, passages.op4_collinear_passages(docs).collect()))
    monkeypatch.setattr(passages, "HOT_BYTES", 64)
    monkeypatch.setattr(passages, "SAMPLED", 1)
    assert sorted(map(tuple, passages.op4_collinear_passages(docs).collect())) == plain and len(plain) == 39


def test_no_window_of_the_benchmark_survives(spark):
    items = [(i, prose(900 + i, 14 + i)) for i in range(6)] + [(6, "two words"), (7, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, f"{prose(i, 700)} {items[i % 8][1] or ''}, {prose(-i, 700)}", "a") for i in range(24)] + [(50, None, "a"), (51, "", "a"), (52, "two words", "a")]
    kept = {r["doc_id"]: r["text"] for r in decontaminate.remove_contaminated(make(spark, rows), bench).collect()}
    assert set(kept) == {i for i in range(24) if i % 8 in (6, 7)} | {50, 51}
    windows = {tuple(w[k : k + 13]) for _, t in items if t and len(w := t.split()) >= 13 for k in range(len(w) - 12)}
    for text in kept.values():
        w = re.findall("[a-z0-9]+", text or "")
        assert not windows & {tuple(w[k : k + 13]) for k in range(len(w) - 12)}


def test_mix_ends_at_the_budget(spark):
    rows = [(i % 40, prose(i, 1 + i % 60 if i % 17 else 900), "abc"[i % 3] if i % 5 else None) for i in range(200)] + [(None, "x y", "a")] * 5
    out = mixing.op1_wfq_mixing(make(spark, rows)).collect()
    total = sum(r["size"] for r in out)
    assert sum(r["taken"] for r in out) == math.floor(1.5 * total)
    mixed = mixing.mix(make(spark, rows)).collect()
    assert sum(len((r["text"] or "").split()) for r in mixed) == math.floor(1.5 * total)


@pytest.mark.parametrize("odd", [True, False])
def test_pipeline_over_odd_tables(spark, tmp_path, odd):
    import corpus_pipeline

    rows = [(1, None), (2, ""), (None, prose(1, 100)), (3, prose(2, 100)), (3, prose(2, 100)), (4, prose(2, 100)), (5, prose(3, 200_000)), (6, " \t\n")] if odd else []
    docs = spark.createDataFrame([(i, t, None, "s", 0, "clash", 7) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, size string, shard int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None), (None, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == ({None, 3, 5} if odd else set())
