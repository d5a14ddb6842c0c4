import random
import re
from collections import Counter

import numpy as np
import pytest

from quarry.llm import dartminhash, decision_list, decontaminate, html_layout, importance, mixing, passages, pii, sharding, wordpiece

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string"


def make(spark, rows):
    """(doc_id, text, source) with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "en", s, 0, "x", "y") for i, t, s in rows], SCHEMA)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(n))


ODD = [(1, None, "a"), (2, "", None), (None, "one two", "b"), (3, "x", "a"), (3, "x", "a"), (4, prose(1, 9000), "a"), (5, " \t\n ", None), (6, "é ß " * 30, "b")]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 0), (4, 1, 0), (None, 1, 0), (99, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, prose(7, 20)), (2, None), (None, "one two"), (3, "")], "item_id long, text string")


def every(spark, rows, labels, benchmark):
    docs = make(spark, rows)
    return {
        "mix": mixing.op1_wfq_mixing(docs),
        "near": dartminhash.op2_dartminhash(docs),
        "shards": sharding.op3_rendezvous_sharding(docs),
        "passages": passages.op4_collinear_passages(docs),
        "leaks": decontaminate.op5_positional_index(docs, benchmark),
        "rules": decision_list.op6_decision_list(docs, labels),
        "tokens": wordpiece.op8_longest_match_tokens(docs),
        "sample": importance.op9_importance_resampling(docs, labels),
        "pii": pii.op10_crf_pii(docs),
    }


def test_odd_rows(spark, labels, benchmark):
    for name, df in every(spark, ODD, labels, benchmark).items():
        rows = df.collect()
        if name != "passages":
            assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(x[0]) for x in ODD), name
    assert make(spark, ODD).columns == dartminhash.drop_near_duplicates(make(spark, ODD)).columns
    assert dartminhash.drop_near_duplicates(make(spark, ODD)).count() == 6


def test_empty_tables(spark, labels, benchmark):
    for name, df in every(spark, [], labels.limit(0), benchmark.limit(0)).items():
        assert df.count() == 0, name


def test_mixing_law(spark):
    rows = [(i, prose(i, 5 + i % 40), "abc"[i % 3 if i % 7 else 0]) for i in range(300)]
    out = mixing.op1_wfq_mixing(make(spark, rows)).collect()
    total = sum(r["size"] for r in out)
    taken, target = Counter(), {}
    for (i, _, s), r in zip(sorted(rows), sorted(out, key=lambda r: r["doc_id"])):
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
        assert r["target"] <= 2 * r["source_size"]
    assert abs(sum(target.values()) - 1.5 * total) < 1e-6 * total
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    mixed = mixing.mix(make(spark, rows)).collect()
    assert sum(len(r["text"].split()) for r in mixed) == sum(taken.values())


def test_sharding_law(spark):
    rows = [(i, prose(i, 3), "a") for i in range(400)]
    out = sharding.op3_rendezvous_sharding(make(spark, rows)).collect()
    assert all(r["grown_shard"] in (r["shard"], 16) for r in out)
    for s, n in Counter(r["shard"] for r in out).items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n))
    weighted = sharding.assign(make(spark, rows), weights=[3.0, 1.0]).groupBy("shard").count().collect()
    assert 260 < {r["shard"]: r["count"] for r in weighted}[0] < 340


@pytest.mark.parametrize("counted", [False, True])
def test_dart_signatures_estimate_similarity(counted):
    base = prose(3, 500).split()
    other = base[:440] + prose(4, 60).split()
    sets = [dartminhash.elements(" ".join(w), counted=counted) for w in (base, other)]
    a, b = (set(s.tolist()) for s in sets)
    sigs = dartminhash.signatures(sets, 2000)
    assert abs((sigs[0] == sigs[1]).mean() - len(a & b) / len(a | b)) < 0.05
    weights = [np.full(len(s), 2.5) for s in sets]
    sigs = dartminhash.signatures(sets, 1000, weights)
    assert abs((sigs[0] == sigs[1]).mean() - len(a & b) / len(a | b)) < 0.06


def test_near_duplicates_against_brute_force(spark):
    r, rows = random.Random(2), []
    for g in range(12):
        base = prose(g, 120).split()
        for _ in range(r.randint(1, 14)):
            words = list(base)
            for _ in range(r.randint(0, 5)):
                words[r.randrange(len(words))] = prose(r.random(), 1)
            rows.append((len(rows), " ".join(words), "a"))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t, _ in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    found = {r["doc_id"]: r["class_id"] for r in dartminhash.op2_dartminhash(make(spark, rows)).collect()}
    assert found == {i: root(i) for i in sets}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    out = {r["node"]: r["component"] for r in dartminhash.components(edges).collect()}
    assert all(out[i] == 0 for i in range(41)) and out[101] == 100 and out[100] == 100


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination_against_brute_force(spark, block_bytes):
    items = [(i, prose(50 + i, 6 if i == 3 else 25)) for i in range(8)] + [(8, prose(50, 25))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, prose(i, 60) + " " + (items[i % 8][1] if i % 3 == 0 else "") + ". " + prose(-i, 40), "a") for i in range(30)]
    out = {r["doc_id"]: r for r in decontaminate.op5_positional_index(make(spark, rows), bench, block_bytes=block_bytes).collect()}
    windows = {}
    for i, t in items:
        w = re.findall("[a-z0-9]+", t)
        for k in range(max(1, len(w) - 12)):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    for i, t, _ in rows:
        w, hit, found = re.findall("[a-z0-9]+", t), set(), set()
        for win, owners in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= owners
        r = out[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (len(w), len(hit), len(found), decontaminate.digest(sorted(map(str, found))))


def test_stored_index_and_proximity(spark, tmp_path):
    docs = make(spark, [(1, "the red fox runs", "a"), (2, "red the fox", "a"), (3, "fox the red fox", "a")])
    decontaminate.write_index(docs, str(tmp_path / "i"))
    hits = decontaminate.search_index(spark, str(tmp_path / "i"), [["red", "fox"]]).collect()
    assert {(r["doc_id"], r["start"]) for r in hits} == {(1, 1), (3, 2)}
    bench = spark.createDataFrame([(9, "red fox")], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.proximity(docs, bench, span=3).collect()} == {1, 2, 3}


def test_proximity_does_not_hang_on_partitions(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(1, item.replace("thirteen", "other"), "a"), (2, "thirteen " + prose(1, 30), "a"), (3, "one two three", "a"), (4, "four five six", "a")]
    rows += [(10 + i, "thirteen " + prose(20 + i, 9), "a") for i in range(5)]
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    one, many = (
        {(r["doc_id"], r["position"]) for r in decontaminate.proximity(make(spark, rows).repartition(k), bench).collect()} for k in (1, len(rows))
    )
    assert one == many and {d for d, _ in one} == {1}


def test_rules_are_learned(spark):
    r = random.Random(1)
    rows, lab = [], []
    for i in range(240):
        text = prose(i, 80)
        if i % 4 == 0:
            text = re.sub(r" ", lambda m: r.choice(["%%% ", "&&& "]), text)
        rows.append((i, text, "a"))
        lab.append((i, 0 if i % 4 == 0 else 1, 0))
    labels = spark.createDataFrame(lab, "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r["kept"] for r in decision_list.op6_decision_list(make(spark, rows), labels).collect()}
    assert sum(out[i] == (i % 4 != 0) for i in out) >= 235


@pytest.mark.parametrize("text,n", [("a b c a b c", 6), ("a a a a", 4), ("a b c d", 0), ("a b c x a b c a b c", 9), ("a b", 0)])
def test_repeated_words(spark, text, n):
    df = spark.createDataFrame([(text,)], "text string")
    assert decision_list.measure(df).select("_stats.n_repeat_words").first()[0] == n


def test_passages(spark):
    shared = prose(900, 70).split()
    fuzzy = shared[:30] + ["changed"] + shared[31:]
    rows = [(i, prose(i, 80) + " " + " ".join(fuzzy if i % 2 else shared) + " " + prose(-i, 60), "a") for i in range(6)] + [(10 + i, prose(100 + i, 200), "a") for i in range(5)]
    out = passages.op4_collinear_passages(make(spark, rows)).collect()
    assert {x for r in out for x in (r["doc_id"], r["ref_doc_id"])} == set(range(6))
    assert all(r["start"] == 80 and r["end"] == 150 for r in out)


def test_chains_and_alignment():
    found = np.array([[0, 0, 20], [25, 26, 20], [10, 500, 15], [50, 48, 10]])
    assert passages.chains(found)[0] == [0, 1, 3]
    x = np.arange(100, dtype=np.uint64)
    assert passages.align(x, np.delete(x, [40, 60])) == 98


def held_windows(texts, n):
    """(text, start) of every n words in a row that another text holds too."""
    held = {}
    for i, w in texts.items():
        for p in range(len(w) - n + 1):
            held.setdefault(tuple(w[p : p + n]), set()).add((i, p))
    return {x for places in held.values() if len({i for i, _ in places}) > 1 for x in places}


def test_mosaic_passages_against_brute_force(spark):
    r = random.Random(5)
    pieces = [prose(2000 + i, r.randint(8, 40)) for i in range(12)]
    rows = [(i, " ".join([prose(3000 + i, 20), pieces[i], prose(4000 + i, 20)]), "a") for i in range(12)]
    for i in range(40):
        mosaic = " ".join(pieces[j] for j in r.sample(range(12), 4))
        for k in range(2):
            words = mosaic.split()
            low = r.randint(0, 8)
            rows.append((100 + 2 * i + k, " ".join([prose(5000 + 2 * i + k, 15), *words[low : len(words) - r.randint(0, 8)], prose(6000 + 2 * i + k, 15)]), "a"))
    texts = {i: t.split() for i, t, _ in rows}
    out = passages.op4_collinear_passages(make(spark, rows)).collect()
    told = {}
    for x in out:
        told.setdefault(x["doc_id"], []).append((x["start"], x["end"]))
        told.setdefault(x["ref_doc_id"], []).append((x["ref_start"], x["ref_end"]))
    wanted = held_windows(texts, passages.MIN_WORDS)
    assert len(wanted) > 500
    assert not [(i, p) for i, p in wanted if not any(a <= p and p + passages.MIN_WORDS <= b for a, b in told.get(i, ()))]


def test_syncmers_leave_no_gap():
    h = np.random.default_rng(1).integers(0, 30, 5000).astype(np.uint64)
    at = passages.syncmers(h)[1]
    assert at[0] < passages.K and np.diff(at).max() < passages.K
    assert all((passages.grams(h, n)[:-1] == passages.grams(h[:-1], n)).all() for n in (1, 5, 50))


def altered(words, every, r):
    """One word in ``every`` replaced, taken out or put in, at random places."""
    out = []
    for w in words:
        x = r.random() * every
        out.extend([w] if x >= 1 else [] if x < 0.2 else [w, "new"] if x < 0.4 else ["other"])
    return out


def test_passages_with_many_changed_words(spark):
    r, rows = random.Random(6), []
    for i in range(60):
        shared = prose(7000 + i, 75).split()
        rows.append((2 * i, " ".join([prose(8000 + i, 40), *shared, prose(9000 + i, 40)]), "a"))
        rows.append((2 * i + 1, " ".join([prose(10000 + i, 30), *altered(shared, 10, r), prose(11000 + i, 50)]), "a"))
    out = passages.op4_collinear_passages(make(spark, rows)).collect()
    pairs = {frozenset((x["doc_id"], x["ref_doc_id"])) for x in out}
    assert all(len({i // 2 for i in p}) == 1 for p in pairs)
    assert len(pairs) >= 55


def test_a_far_run_hides_no_near_one():
    found = np.array([[0, 0, 500], [900, 900, 30], [930, 931, 30]])
    assert [1, 2] in passages.chains(found)


def test_chains_against_brute_force():
    r = random.Random(4)
    for _ in range(60):
        found = np.unique(np.array([[r.randrange(300), r.randrange(300), r.randint(8, 60)] for _ in range(40)]), axis=0)
        best = {}
        for i in np.lexsort((found[:, 1], found[:, 0])).tolist():
            a, b, n = found[i].tolist()
            best[i] = n
            for j in best:
                da, db = a - found[j, 0] - found[j, 2], b - found[j, 1] - found[j, 2]
                if j != i and 0 <= da <= passages.MAX_GAP and 0 <= db <= passages.MAX_GAP:
                    best[i] = max(best[i], n + best[j] - passages.GAP_COST * (da + db))
        top = passages.chains(found)[0]
        score = found[top[0], 2]
        for j, i in zip(top, top[1:]):
            score += found[i, 2] - passages.GAP_COST * (found[i, :2] - found[j, :2] - found[j, 2]).sum()
        assert score == max(best.values())


@pytest.mark.parametrize(
    "page,text",
    [
        ("<p>a<p>b", "a\n\nb"),
        ("<ul><li>x<li>y</ul>", "- x\n- y"),
        ("<ol start=3><li>x<li>y<ul><li>z</ul></ol>", "3. x\n4. y\n  - z"),
        ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"),
        ("<script>var t='</p>'</script>q<style>p{}</style> r", "q r"),
        ("<div hidden>n</div><div style='display: none'>m</div>s", "s"),
        ("a &lt; b<br>c", "a < b\nc"),
        ("<pre>x\n  y</pre>", "x\n  y"),
        ("1 < 2", "1 < 2"),
        ("", ""),
        (None, None),
    ],
)
def test_html(page, text):
    assert html_layout.render(page) == text


@pytest.mark.parametrize(
    "page,text",
    [
        ("<head><title>x</title><p>a", "a"),
        ("<html><head><meta charset=utf-8><title>x</title> text <b>b</b>", "text b"),
        ("<head><title>x</title></head><p>a", "a"),
        ("<p>a <button>b</button> c", "a b c"),
        ("<button>a<p>b", "a\n\nb"),
        ("x <math><mi>y</mi><mo>=</mo><mn>2</mn></math>", "x y=2"),
        ("<table><tr>stray<td>a<td>b</table>", "stray\na  b"),
    ],
)
def test_html_emits_all_visible_text(page, text):
    assert html_layout.render(page) == text


def test_deep_html():
    assert "x" in html_layout.render("<div>" * 5000 + "x") and html_layout.render("<table><tr><td>" * 300 + "x")


def test_token_counts_against_greedy():
    vocabulary = [b"a", b"ab", b"abc", b"bcd", b"cde", b"de", b" a", b" abc", b"abcdef"]
    auto, pieces = wordpiece.Automaton(vocabulary), {*vocabulary, *(bytes([b]) for b in range(256))}
    r = random.Random(0)
    for _ in range(2000):
        word, n, i = bytes(r.choices(b" abcdefx", k=r.randint(0, 14))), 0, 0
        while i < len(word):
            i = max(j for j in range(i + 1, len(word) + 1) if word[i:j] in pieces)
            n += 1
        assert auto.count(word) == n


def test_importance_prefers_the_target(spark):
    rows = [(i, prose(i % 5, 60) if i % 4 else "junk%%% " * 40 + prose(i, 10), "a") for i in range(80)]
    labels = spark.createDataFrame([(i, int(bool(i % 4)), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in importance.op9_importance_resampling(make(spark, rows), labels).collect()}
    assert sum(r["kept"] for r in out.values()) == 60
    assert all(out[i]["kept"] == bool(i % 4) for i in out)


@pytest.mark.parametrize(
    "text,spans",
    [
        ("mail a.b@c.de now", "email:5:13"),
        ("a@b.c@d.e", "email:0:5"),
        ("ip 1.2.3.4.5.6.7.8 999.1.1.1", "ip:3:10,ip:11:18"),
        ("4111 1111 1111 1111", "card:0:19"),
        ("4111111111111112", ""),
        ("+1 (017) 555-7713", "phone:0:17"),
        ("+1 23", ""),
        ("9" * 5000, ""),
    ],
)
def test_base_spans(text, spans):
    assert pii.spans_text(pii.base_spans(text)) == spans


def test_crf_on_held_out_sentences():
    crf, wrong, total = pii.trained(), 0, 0
    for sentence in pii.labelled_table(200, seed=77):
        e = crf.emissions([[w.encode() for w, _ in sentence]])
        got = [pii.LABELS[x] for x in crf.decode(e)[: len(sentence)]]
        wrong += sum(g != g2 for g, (_, g2) in zip(got, sentence))
        total += len(sentence)
    assert wrong / total < 0.01


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    good = [(i, prose(i, 150), f"s{i % 3}") for i in range(40)]
    bench = [(1, prose(500, 30))]
    rows = [*good, (50, good[0][1], "s0"), (51, "short text", "s0"), (52, prose(8, 1) + " " + bench[0][1] + " " + prose(9, 60), "s1")]
    spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} <= set(range(40)) and len({r["doc_id"] for r in out}) > 25
    words = sum(len(r["text"].split()) for r in out)
    assert abs(words - 1.5 * 40 * 150) <= 3
