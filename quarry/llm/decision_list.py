r"""Quality rules as a learned decision list. Native: no Python workers.

``measure`` computes statistics of whole texts inside each row, without a
shuffle. ``learn`` runs sequential covering: it grows a conjunction of
thresholds that covers mostly rejected (quality 0) labelled documents, prunes
it on held-out rows, removes what it covers and repeats. The list becomes one
ordered Spark conditional expression (``rules_column``).

Only aggregated counts of binned statistics of at most ``max_labelled``
labelled rows reach the driver; the measured statistics and the verdict cover
every row.

Results for odd input: null and empty texts have no words and fail the base
rule; labels that are null, or of documents that don't exist, are ignored; with
no usable labels, or only one class of them, the list is empty and the base rule
alone decides; repeated labels of a document count repeatedly; repeated documents
get equal verdicts; an empty table gives no rows; other columns, whatever their names, are
passed on by ``filter_quality`` and ignored by ``op6_decision_list``.

Very long texts are measured whole. Repeated three-word windows are found by sorting
64-bit keys that hold the window's place in their low bits and its hash above. Windows whose
hash stands alone are not repeated; the words of all others are sorted and compared,
so the count is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BLANKS, keep, words_array

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: At most so many labelled rows are learned from, chosen by a hash of doc_id.
MAX_LABELLED = 20_000
#: Thresholds tried for a statistic: so many quantiles of the labelled rows of each class.
BINS = 24


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that the text holds twice or more."""

    def starts_to_count(starts: Column) -> Column:
        """Sorted starts of repeated windows: each covers three words, less what the next one covers."""
        gaps = F.zip_with(starts, F.slice(starts, 2, F.size(starts)), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def of(w: Column) -> Column:
        return let(F.size(w), lambda n: let(F.length(F.bin(n)).cast("int"), lambda bits: windows(w, n, bits)))

    def windows(w: Column, n: Column, bits: Column) -> Column:
        shift = lambda x: F.call_function("shiftleft", x, bits)
        same = lambda a, b: F.call_function("shiftrightunsigned", a.bitwiseXOR(b), bits) == 0
        keys = F.sort_array(
            F.transform(
                F.sequence(F.lit(0), n - 3),
                lambda i: shift(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))).bitwiseOR(i.cast("long")),
            )
        )
        mask = shift(F.lit(1).cast("long")) - 1
        twice = lambda k: F.filter(
            k, lambda x, j: F.coalesce(same(x, F.get(k, j + 1)), F.lit(False)) | F.coalesce(same(x, F.get(k, j - 1)), F.lit(False))
        )
        # words hold no blanks, so windows are equal if their joined words are
        window = lambda x: let(x.bitwiseAND(mask).cast("int"), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.cast("long").alias("i")))
        beside = lambda s, x, j: (F.get(s, j)["t"] == x["t"]) & (j >= 0)
        equal = lambda s: F.transform(F.filter(s, lambda x, j: F.coalesce(beside(s, x, j + 1), F.lit(False)) | F.coalesce(beside(s, x, j - 1), F.lit(False))), lambda x: x["i"])
        dealt = lambda found: F.when(F.size(found) == 0, F.lit(0).cast("long")).otherwise(
            let(F.sort_array(F.transform(found, window)), lambda s: let(F.sort_array(equal(s)), starts_to_count))
        )
        return let(keys, lambda k: let(twice(k), dealt))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(words, of))


#: Statistics that are counts of a text; the rules see them as shares.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``_stats``, a struct of COUNTS."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    without = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    row = docs.withColumn("_words", words_array(F.col(text_col))).withColumn("_lines", lines)
    stats = (
        F.size("_words").cast("long"),
        F.length(F.translate(text, BLANKS, "")).cast("long"),
        without(SYMBOLS).cast("long"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        repeated_words(F.col("_words")),
        without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long"),
        without("!?").cast("long"),
    )
    # columns first and a struct of them after: the optimizer inlines fields of a struct, not shared columns
    columns = {f"_stat_{name}": value for name, value in zip(COUNTS, stats)}
    out = row.withColumns(columns).withColumn("_stats", F.struct(*[F.col(c).alias(n) for n, c in zip(COUNTS, columns)]))
    return out.drop("_words", "_lines", *columns)


def features(stats: Column) -> dict[str, Column]:
    """What the rules test: numbers that don't depend on a text's length, and the length."""
    words, chars = F.greatest(stats["n_words"], F.lit(1)), F.greatest(stats["word_chars"], F.lit(1))
    return {
        "n_words": stats["n_words"].cast("double"),
        "word_length": stats["word_chars"] / words,
        "symbol_share": stats["n_symbols"] / chars,
        "dup_line_share": stats["n_dup_lines"] * 20 / words,
        "repeat_share": stats["n_repeat_words"] / words,
        "upper_share": stats["n_upper"] / chars,
        "mark_share": stats["n_marks"] / words,
    }


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, '>=' or '<', threshold) and the verdict it gives."""

    terms: tuple[tuple[str, str, float], ...]
    keep: bool = False

    def column(self, feats: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, op, cut in self.terms:
            out = out & ((feats[name] >= cut) if op == ">=" else (feats[name] < cut))
        return out

    def __str__(self) -> str:
        return " AND ".join(f"{n} {o} {c:.6g}" for n, o, c in self.terms) + f" -> {'keep' if self.keep else 'reject'}"


def rules_column(rules: list[Rule], stats: Column) -> Column:
    """The first rule that holds decides; with none, the document is kept."""
    feats, out = features(stats), None
    for rule in rules:
        cond = rule.column(feats)
        out = F.when(cond, F.lit(rule.keep)) if out is None else out.when(cond, F.lit(rule.keep))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def labelled(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, max_labelled: int) -> DataFrame:
    """Features of a bounded sample of labelled rows that pass the base rule, with ``bad``."""
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias("_label_id"), (F.col("quality") == 0).alias("bad"))
        .orderBy(F.xxhash64("_label_id"), "_label_id", "bad")
        .limit(max_labelled)
    )
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(
        F.broadcast(chosen), F.col("_id") == F.col("_label_id")
    )
    held = (F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(3)) == 0).alias("held")
    # written before the features use them, or the optimizer would inline the statistics into each
    stats = keep(measure(found, "_text").select("bad", held, "_stats")).where(~base_failed(F.col("_stats")))
    return stats.select("bad", "held", *[c.alias(n) for n, c in features(F.col("_stats")).items()])


def learn(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_labelled: int = MAX_LABELLED,
    bins: int = BINS,
    max_rules: int = 12,
    max_terms: int = 3,
    min_precision: float = 0.9,
    min_cover: float = 0.002,
) -> list[Rule]:
    """Learn an ordered list of rejecting rules from labelled documents."""
    rows = labelled(docs, labels, id_col=id_col, text_col=text_col, max_labelled=max_labelled)
    names = list(features(F.col("_stats")))
    shares = [i / (bins + 1) for i in range(1, bins + 1)]
    quantiles = rows.groupBy("bad").agg(*[F.percentile(n, F.array(*[F.lit(s) for s in shares])).alias(n) for n in names]).collect()
    cuts = {n: sorted({x for q in quantiles for x in q[n]}) for n in names}
    if not any(cuts.values()):
        return []
    digit = {n: sum(((F.col(n) >= c).cast("int") for c in cuts[n]), F.lit(0)).alias(n) for n in names}
    cells = rows.select("bad", "held", *digit.values()).groupBy("held", *names).agg(
        F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")
    )
    return cover(
        [(r["held"], tuple(r[n] for n in names), r["bad"], r["good"]) for r in cells.collect()],
        names, cuts, max_rules=max_rules, max_terms=max_terms, min_precision=min_precision, min_cover=min_cover,
    )


def cover(cells, names, cuts, *, max_rules, max_terms, min_precision, min_cover) -> list[Rule]:
    """Sequential covering over cells (held out?, bins, bad, good)."""
    import numpy as np

    if not cells:
        return []
    held = np.array([c[0] for c in cells])
    bins = np.array([c[1] for c in cells]).reshape(len(cells), len(names))
    bad, good = np.array([c[2] for c in cells], float), np.array([c[3] for c in cells], float)
    left, total = np.ones(len(cells), bool), bad.sum() + good.sum()
    tests = [(j, op, i) for j, n in enumerate(names) for i in range(len(cuts[n])) for op in (">=", "<")]
    hits = np.array([bins[:, j] > i if op == ">=" else bins[:, j] <= i for j, op, i in tests])
    rules: list[Rule] = []

    def precision(mask, prior: float = 1.0) -> float:  # Laplace: few rows prove little
        b, g = bad[mask].sum(), good[mask].sum()
        return (b + prior) / max(b + g + 2 * prior, 1)

    while len(rules) < max_rules:
        mask, terms = left & ~held, []
        while len(terms) < max_terms:
            b0, g0 = bad[mask].sum(), good[mask].sum()
            if b0 == 0 or g0 == 0:
                break
            live = hits & mask
            b, g = live @ bad, live @ good
            # information gain of FOIL: bad rows kept, times the bits by which they grew purer
            gain = b * (np.log2((b + 1) / (b + g + 2)) - np.log2((b0 + 1) / (b0 + g0 + 2)))
            best = int(np.argmax(gain))
            if gain[best] <= 1e-9:
                break
            terms.append(best)
            mask = mask & hits[best]
        if not terms:
            break
        # drop the last terms while that doesn't hurt on held-out rows
        full = lambda ts: left & np.logical_and.reduce(hits[ts])
        while len(terms) > 1 and precision(full(terms[:-1]) & held) >= precision(full(terms) & held):
            terms = terms[:-1]
        covered = full(terms)
        if precision(covered & ~held, 0) < min_precision or precision(covered) < 0.8 or precision(covered & held) < 0.5:
            break
        if bad[covered].sum() < max(5, min_cover * total):
            break
        rules.append(Rule(tuple((names[tests[t][0]], tests[t][1], float(cuts[names[tests[t][0]]][tests[t][2]])) for t in terms)))
        left &= ~covered
    return rules


def judge(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """``docs`` with ``_stats``, ``_failed`` and ``_kept``."""
    out = measure(docs, text_col)
    return out.withColumn("_failed", base_failed(F.col("_stats"))).withColumn(
        "_kept", ~F.col("_failed") & rules_column(rules, F.col("_stats"))
    )


def filter_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the base rule and the learned list keep, columns unchanged."""
    names = docs.columns
    rules = learn(docs, labels, **options)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(options.get("text_col", "text")).alias("_t"))
    return judge(row, rules, "_t").where("_kept").select(*[F.col("_row")[c].alias(c) for c in names])


def op6_decision_list(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rules = learn(docs, labels)
    out = judge(docs.select("doc_id", "text"), rules)
    counts = [F.col("_stats")[c].alias(c) for c in COUNTS[:5]]
    return out.select("doc_id", *counts, F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"))
