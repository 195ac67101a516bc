"""Quality rules: a decision list over text statistics, learned by sequential covering and emitted as Spark conditions.

The statistics and the verdict are DataFrame expressions on the row itself: no shuffle and no Python on executors.
Learning sees at most ``max_rows`` labelled rows (a bounded sample, the ones with the smallest hash) as a table of
numbers on the driver; it grows a conjunction of thresholds on one part of the rows and prunes it on the other.

The list has at most ``max_rules`` (12) rules of at most ``max_tests`` (4) thresholds, each from ``bins`` - 1 (63) quantiles of
the rows that are left: parameters of ``learn`` that keep the list readable. They bound the model, not the rows it judges.

Null and empty texts have no words, so their statistics are 0 and they fail the base rule. Texts are whole however long.
Repeated rows and ids are judged row by row; of an id's differing labels the lowest counts. A value that ties with a
threshold is below it. Without labelled rows of both classes (an empty table too) the list is empty and its default
verdict is "keep".
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

#: What counts as a symbol.
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _count(text: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{kept}]+", ""))


def _repeat_words(w: Column) -> Column:
    """Words covered by three-word windows that occur twice or more: equal windows meet in a sorted array of
    (window hash, place); only texts with a repeated window pay for the sort."""
    n = F.size(w)
    windows = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))

    def union(order: Column) -> Column:
        near = F.filter(
            order,
            lambda x, k: (x["h"] == F.get(order, k - 1)["h"]) | (x["h"] == F.get(order, k + 1)["h"]),
        )
        places = F.array_sort(F.transform(near, lambda x: x["i"]))
        # each place covers three words; what the place before covers too counts once
        steps = F.aggregate(
            places,
            F.struct(F.lit(-3).alias("last"), F.lit(0).alias("sum")),
            lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(3), p - a["last"])).alias("sum")),
        )
        return steps["sum"].cast("long")

    def covered(tri: Column) -> Column:
        return let(F.array_sort(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), union)

    held = let(windows, lambda t: F.when(F.size(F.array_distinct(t)) < F.size(t), covered(t)).otherwise(F.lit(0).cast("long")))
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(held)


def statistics(text: Column) -> Column:
    """A struct of the base statistics and of the ratios that the rules test; ratios of an empty text are 0.

    Words and lines are found once: a filter on the statistics may be pushed below the projection that makes them."""
    t = F.coalesce(text, F.lit(""))

    def base(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _count(t, "#*$%&|<>").cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x)).cast("long").alias("n_lines"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            _count(t, r"\p{Lu}").cast("long").alias("n_upper"),
            _count(t, "!?").cast("long").alias("n_stops"),
        )

    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0)).cast("double")

    def with_ratios(s: Column) -> Column:
        return F.struct(
            *[s[k].alias(k) for k in BASE],
            ratio(s["n_symbols"], s["n_words"]).alias("r_symbols"),
            ratio(s["n_repeat_words"], s["n_words"]).alias("r_repeat"),
            ratio(s["n_dup_lines"], s["n_lines"]).alias("r_dup_lines"),
            ratio(s["n_distinct"], s["n_words"]).alias("r_distinct"),
            ratio(s["word_chars"], s["n_words"]).alias("r_length"),
            ratio(s["n_upper"], s["word_chars"]).alias("r_upper"),
            ratio(s["n_stops"], s["n_words"]).alias("r_stops"),
        )

    return let(let(words(text), base), with_ratios)


#: What the thresholds test, and nothing else.
FEATURES = ("n_words", "r_symbols", "r_repeat", "r_dup_lines", "r_distinct", "r_length", "r_upper", "r_stops")


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


@dataclass
class Rule:
    """All of ``tests`` (feature, "<=" or ">", threshold) hold: the verdict is ``keep``."""

    tests: list[tuple[str, str, float]]
    keep: bool


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)
    default_keep: bool = True

    def verdict(self, s: Column) -> Column:
        """The first rule whose conjunction holds for the statistics decides; one ordered CASE expression."""
        out = None
        for rule in self.rules:
            cond = F.lit(True)
            for name, op, bound in rule.tests:
                x = s[name]
                cond = cond & (x <= F.lit(bound) if op == "<=" else x > F.lit(bound))
            out = (F if out is None else out).when(cond, F.lit(rule.keep))
        return F.lit(self.default_keep) if out is None else out.otherwise(F.lit(self.default_keep))

    def text(self) -> str:
        said = [f"if {' and '.join(f'{n} {o} {b:.6g}' for n, o, b in r.tests)}: {'keep' if r.keep else 'drop'}" for r in self.rules]
        return "\n".join([*said, f"else: {'keep' if self.default_keep else 'drop'}"])


def _holds(x: np.ndarray, tests: list[tuple[int, str, float]]) -> np.ndarray:
    m = np.ones(len(x), bool)
    for f, op, b in tests:
        m &= x[:, f] <= b if op == "<=" else x[:, f] > b
    return m


def _grow(x: np.ndarray, y: np.ndarray, bins: int, max_tests: int) -> list[tuple[int, str, float]]:
    """Adds the threshold with the largest information gain until no good row (y = 1: to be covered) shares the rule."""
    tests: list[tuple[int, str, float]] = []
    m = np.ones(len(y), bool)
    while len(tests) < max_tests and m.any() and y[m].min() == 0:
        p, n = int(y[m].sum()), int(m.sum())
        best = (1e-9, None)
        for f in range(x.shape[1]):
            v = x[m, f]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1]))
            if not len(cuts):
                continue
            at = np.searchsorted(cuts, v, "left")  # v <= cuts[k] for k >= at
            all_le = np.cumsum(np.bincount(at, minlength=len(cuts) + 1))[:-1]
            pos_le = np.cumsum(np.bincount(at, weights=y[m], minlength=len(cuts) + 1))[:-1]
            for op, pp, nn in (("<=", pos_le, all_le), (">", p - pos_le, n - all_le)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = pp * (np.log2(pp / nn) - np.log2(p / n))
                gain = np.where((pp > 0) & (nn < n), gain, -1.0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), (f, op, float(cuts[k])))
        if best[1] is None:
            break
        f, op, cut = best[1]
        v, y_m = x[m, f], y[m]
        # the threshold goes midway between the covered rows to be found and the nearest row outside
        inner, outer = (v[(v > cut) & (y_m == 1)], v[v <= cut]) if op == ">" else (v[(v <= cut) & (y_m == 1)], v[v > cut])
        edge = (inner.min() + outer.max()) / 2 if op == ">" else (inner.max() + outer.min()) / 2
        tests.append((f, op, float(edge)))
        m &= _holds(x, tests[-1:])
    return tests


def learn(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = FEATURES, seed: int = 7, bins: int = 64, max_rules: int = 12, max_tests: int = 4, least_precision: float = 0.8) -> DecisionList:
    """Sequential covering of the rows with y = 0 (poor quality): grow on two thirds, prune on the rest, take the rule
    while it is precise enough there, remove what it covers, go on. The rest is kept."""
    x, y = np.asarray(x, float), np.asarray(y, int)
    out = DecisionList(default_keep=True)
    if not len(y) or y.min() == y.max():
        return out
    bad = 1 - y
    left = np.arange(len(y))
    rng = np.random.default_rng(seed)
    while len(out.rules) < max_rules and bad[left].sum() >= 5:
        order = rng.permutation(left)
        grow, prune = order[: len(order) * 2 // 3], order[len(order) * 2 // 3 :]
        tests = _grow(x[grow], bad[grow], bins, max_tests)
        if not tests:
            break

        def worth(t, rows=prune):
            m = _holds(x[rows], t)
            p, n = bad[rows][m].sum(), m.sum()
            return ((p - (n - p)) / n if n else -1.0), (p / n if n else 0.0)

        while len(tests) > 1 and worth(tests[:-1])[0] >= worth(tests)[0]:
            tests = tests[:-1]
        if worth(tests)[1] < least_precision:
            break
        out.rules.append(Rule([(names[f], op, b) for f, op, b in tests], False))
        left = left[~_holds(x[left], tests)]
    return out


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DecisionList:
    """Learns from the statistics of at most ``max_rows`` labelled documents, those whose ids hash lowest."""
    some = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    # at most max_rows rows of two numbers: a proven bound
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("quality", statistics(F.col("text")).alias("s"))
    got = sorted(rows.select("quality", *[F.col(f"s.{k}") for k in FEATURES]).collect())
    x = np.array([[r[k] for k in FEATURES] for r in got], float).reshape(-1, len(FEATURES))
    return learn(x, np.array([int(r["quality"] > 0) for r in got], int))


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """One row per document: statistics, base_failed and kept."""
    s = F.col("s")
    df = docs.select("doc_id", statistics(F.col("text")).alias("s"))
    return df.select("doc_id", *[s[k].alias(k) for k in BASE], base_failed(s).alias("base_failed"), (~base_failed(s) & rules.verdict(s)).alias("kept"))


def keep_good(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    return docs.where(let(statistics(F.col("text")), lambda s: ~base_failed(s) & rules.verdict(s)))
