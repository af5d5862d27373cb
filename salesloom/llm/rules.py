"""Quality rules: text statistics in Spark SQL, and a decision list learned from labelled ones by sequential covering.

Each rule is a conjunction of thresholds on statistics that rejects documents. A rule grows condition by condition on
two thirds of the labelled rows and is pruned on the last third; the rows it covers leave, and the next rule is grown.
The list becomes one CASE expression. Every count is an aggregate; the driver sees only counts by bin.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.llm.common import SPACE_CHARS, let, quoted, staged, whole_text, words_of

#: Fixed value: characters counted as symbols.
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: What rules may test, by name; each is a share or a mean, so that it doesn't grow with the text.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "bangs_per_word": "n_bangs / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
}


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(_without(text, chars))).cast("long")


def repeat_words(words: Column) -> Column:
    """Words inside a three-word window that occurs again in the text.

    Windows are told apart by 64-bit hashes; only texts with equal hashes are sorted. Along the sorted positions of
    the repeated windows each adds the words that the one before doesn't reach.
    """

    def hashed(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(w) - 2)
        return F.transform(at, lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))

    def placed(h: Column) -> Column:
        return F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        def twin(x: Column, j: Column) -> Column:
            return (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])

        places = F.sort_array(F.transform(F.filter(s, lambda x, j: F.coalesce(twin(x, j), F.lit(False))), lambda x: x["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            places,
            start,
            lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )

    def of_hashes(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(placed(h), covered))

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(hashed(words), of_hashes))


def text_statistics(docs: DataFrame, carry: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what rules test.

    ``carry`` adds the row itself as the struct ``row``, so that it can be kept without another look-up.
    """
    row = F.struct(*[docs[quoted(c)].alias(c) for c in docs.columns]) if carry else F.lit(None)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text(docs).alias("text"), row.alias("row"))
    rows = rows.withColumn("words", words_of(F.col("text")))
    with_word = F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(SPACE_CHARS)) != "")
    lines = let(
        with_word,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")
        ),
    )
    counted = rows.select(
        "doc_id",
        *(["row"] if carry else []),
        F.size("words").cast("long").alias("n_words"),
        F.length(_without(F.col("text"), SPACE_CHARS)).cast("long").alias("word_chars"),
        _count_of(F.col("text"), SYMBOLS).alias("n_symbols"),
        lines.alias("lines"),
        let(F.col("words"), repeat_words).alias("n_repeat_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        _count_of(F.col("text"), UPPER).alias("n_upper"),
        _count_of(F.col("text"), "!").alias("n_bangs"),
        _count_of(F.col("text"), "0123456789").alias("n_digits"),
    )
    counted = counted.withColumn("n_lines", F.col("lines")["n"]).withColumn("n_dup_lines", F.col("lines")["dup"])
    return counted.drop("lines").withColumns({name: F.expr(e).cast("double") for name, e in FEATURES.items()})


def base_failed() -> Column:
    """Too few words, or over half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Learning:
    """``sample`` bounds the labelled rows learned from. Of the rows a rule covers, ``precision`` must be bad, and
    ``least_rows`` of those it grew on, with at least one of those it was pruned on."""

    sample: int = 20_000
    bins: int = 24
    most_rules: int = 6
    most_conditions: int = 3
    precision: float = 0.97
    least_rows: int = 3


@dataclass(frozen=True)
class Rule:
    """Rejects where every (feature, above, threshold) holds."""

    conditions: tuple[tuple[str, bool, float], ...] = field(default=())

    def expression(self) -> Column:
        held = F.lit(True)
        for name, above, threshold in self.conditions:
            held = held & ((F.col(name) > threshold) if above else (F.col(name) <= threshold))
        return held


def decision(rules: list[Rule]) -> Column:
    """The list as a conditional expression: the first rule that holds rejects, else the document is kept."""
    if not rules:
        return F.lit(True)
    case = F.when(rules[0].expression(), F.lit(False))
    for rule in rules[1:]:
        case = case.when(rule.expression(), F.lit(False))
    return case.otherwise(F.lit(True))


def _cuts(sample: DataFrame, bins: int) -> dict[str, list[float]]:
    """Thresholds of each feature: midway between the values at even quantiles of the bad rows and of the good ones."""
    steps = [k / bins for k in range(bins + 1)]
    sums = []
    for name in FEATURES:
        for label in (0, 1):
            of = F.when(F.col("label") == label, F.col(name))
            sums.append(F.percentile_approx(of, steps, 10_000).alias(f"{name}_{label}"))
    row = sample.agg(*sums).first()
    cuts = {}
    for name in FEATURES:
        values = sorted({*(row[f"{name}_0"] or []), *(row[f"{name}_1"] or [])})
        cuts[name] = [(a + b) / 2 for a, b in zip(values, values[1:])]
    return cuts


def _histogram(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[tuple[str, int, int], dict[int, int]]:
    """Rows by feature, label and part (0 to grow, 1 to prune): counts by the number of thresholds below the value."""
    if not any(cuts.values()):
        return {}

    def binned(name: str, at: list[float]) -> Column:
        below = F.filter(F.array(*map(F.lit, at)), lambda c: c < F.col(name))
        return F.struct(F.lit(name).alias("name"), F.size(below).alias("bin"))

    stacked = F.explode(F.array(*[binned(name, at) for name, at in cuts.items() if at]))
    counts = rows.select("label", "part", stacked.alias("x")).groupBy("x.name", "label", "part", "x.bin").count()
    out: dict[tuple[str, int, int], dict[int, int]] = {}
    for r in counts.collect():  # features x labels x parts x bins
        out.setdefault((r["name"], r["label"], r["part"]), {})[r["bin"]] = r["count"]
    return out


def _sides(hist, cuts, part: int):
    """(feature, above, threshold, bad, good) for every condition."""
    for name, at in cuts.items():
        counts = [hist.get((name, label, part), {}) for label in (0, 1)]
        total = [sum(c.values()) for c in counts]
        for k, threshold in enumerate(at):
            over = [sum(n for b, n in c.items() if b > k) for c in counts]
            yield name, True, threshold, over[0], over[1]
            yield name, False, threshold, total[0] - over[0], total[1] - over[1]


def _worth(bad: int, good: int) -> float:
    """Laplace's estimate of the share of bad rows."""
    return (bad + 1) / (bad + good + 2)


def _grow(rows: DataFrame, cuts, how: Learning) -> tuple[Rule, list[list[tuple[int, int]]]]:
    """A rule and, after each of its conditions, the (bad, good) rows to grow and to prune on that it covers."""
    rule, seen = Rule(), []
    while len(rule.conditions) < how.most_conditions:
        hist = _histogram(rows.where(rule.expression()), cuts)
        if not hist:
            break
        any_name = next(iter(hist))[0]
        bad0, good0 = (sum(hist.get((any_name, label, 0), {}).values()) for label in (0, 1))
        if bad0 < how.least_rows or good0 == 0:
            break
        base = math.log2(bad0 / (bad0 + good0))
        best, gain = None, 0.0
        for name, above, threshold, bad, good in _sides(hist, cuts, 0):
            if bad >= how.least_rows and (g := bad * (math.log2(bad / (bad + good)) - base)) > gain + 1e-9:
                best, gain = (name, above, threshold), g
        if best is None:
            break
        rule = Rule((*rule.conditions, best))
        seen.append(
            [next((b, g) for n, a, t, b, g in _sides(hist, cuts, part) if (n, a, t) == best) for part in (0, 1)]
        )
    return rule, seen


def _prune(rule: Rule, seen: list[list[tuple[int, int]]], how: Learning) -> Rule | None:
    """The shortest beginning of the rule that is worth most on rows it wasn't grown on, if it is good enough."""
    if not seen:
        return None
    best = max(range(len(seen)), key=lambda k: (_worth(*seen[k][1]), -k))
    (bad, good), (bad_pruned, good_pruned) = seen[best]
    rows = bad + good + bad_pruned + good_pruned
    if bad < how.least_rows or bad_pruned < 1 or bad + bad_pruned < how.precision * rows:
        return None
    return Rule(rule.conditions[: best + 1])


def learn(statistics: DataFrame, labels: DataFrame, how: Learning = Learning()) -> list[Rule]:
    """Rules from the statistics of labelled documents that pass the base rules; none if there are no labels.

    The sample is the labelled rows with the smallest hashes of their id. A document labelled twice counts as bad if
    one label is 0; a null label counts for nothing.
    """
    marked = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").cast("int").alias("label")
    )
    drawn = F.xxhash64("doc_id", F.lit(6))
    sample = staged(
        statistics.where(~base_failed())
        .select("doc_id", *FEATURES)
        .join(marked, "doc_id")
        .withColumn("part", (F.pmod(F.xxhash64("doc_id", F.lit(61)), F.lit(3)) == 0).cast("int"))
        .orderBy(drawn, "doc_id")
        .limit(how.sample),
        "labelled",
    )
    cuts = _cuts(sample, how.bins)
    rules: list[Rule] = []
    rest = sample
    while len(rules) < how.most_rules:
        rule = _prune(*_grow(rest, cuts, how), how)
        if rule is None:
            break
        rules.append(rule)
        rest = rest.where(~rule.expression())
    return rules


def judge(docs: DataFrame, labels: DataFrame, how: Learning = Learning()) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A null text has no words and fails the base rules. Without labels the base rules alone decide. Repeated rows give
    repeated rows; an empty table gives an empty one.
    """
    statistics = staged(text_statistics(docs), "statistics")
    rules = learn(statistics, labels, how)
    return statistics.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & decision(rules)).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, how: Learning = Learning()) -> DataFrame:
    """The documents that are kept, with all their columns.

    The rows are written beside their statistics, which the rules are learned from and tested on: no text shuffles.
    """
    statistics = staged(text_statistics(docs, carry=True), "statistics")
    kept = ~base_failed() & decision(learn(statistics, labels, how))
    return statistics.where(kept).select("row.*")
