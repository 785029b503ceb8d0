"""Quality rules: fixed base rules, then a decision list learned by sequential covering, in DataFrame operations only.

Statistics of a text are column expressions. A bounded sample of labelled rows (the `sample` rows with the least hashes of
their keys) goes to the driver as a few numbers each. There, rules for the bad class are grown one after another: threshold
conditions are added to a conjunction by information gain on two thirds of the rows, and trailing conditions pruned by
precision on the last third; covered rows leave, and a rule too imprecise on the pruning rows ends the list. The list
becomes one ordered conditional expression, applied to every row.

Defined results: null and empty texts have no words and fail the base rules; labels may be missing for any row, absent
altogether (then no rules are learned) or doubled (a row is bad if any of its labels says so); a null doc_id has no label;
ties between conditions go to the first statistic and the lower threshold; repeated rows are judged alike; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import WORD, documents

#: Labelled rows that rules are learned from.
SAMPLE = 10_000
SYMBOLS = "#*$%&|<>"
#: Rules must be this precise on the pruning rows, lest they throw clean texts out.
PRECISE = 0.95
WINDOW = 8

Rule = list[tuple[str, str, float]]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column, width: int = WINDOW) -> Column:
    """Words that lie in windows of `width` words found twice or more."""

    def with_hashes(h: Column) -> Column:
        # Windows by hash and place; those whose hash a neighbour shares; then their places in order, each counted up to the next one.
        sorted_ = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twins(s: Column) -> Column:
            same = lambda x, y: F.coalesce(x["h"] == F.get(s, y)["h"], F.lit(False))
            marked = F.transform(s, lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"]))
            return F.array_sort(F.filter(marked, lambda x: x.isNotNull()))

        covered = lambda at: F.aggregate(
            at, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, i: F.struct((a["n"] + i + width - F.greatest(i, a["end"])).alias("n"), (i + width).alias("end")), lambda a: a["n"]
        )
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(let(sorted_, twins), covered))

    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + d) for d in range(width)]))
    hashed = F.transform(words, lambda x: F.xxhash64(x))
    return F.when(F.size(words) < width, 0).otherwise(let(let(hashed, hashes), with_hashes))


def statistics(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc key `key` and the base statistics, with some that only the learned rules use."""
    base = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.select("key", "text", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("words"))
    without = lambda chars: F.length("text") - F.length(F.translate("text", chars, ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    return base.select(
        "key",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        without(SYMBOLS).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_capitals"),
        without("!?").cast("long").alias("n_marks"),
        without("\n").cast("long").alias("n_breaks"),
    )


def features() -> dict[str, Column]:
    """What rules may test."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "dup_lines_per_line": F.col("n_dup_lines") / (F.col("n_breaks") + 1),
        "repeat_share": F.col("n_repeat_words") / n,
        "capital_share": F.col("n_capitals") / chars,
        "marks_per_word": F.col("n_marks") / n,
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _holds(x: np.ndarray, names: list[str], rule: Rule) -> np.ndarray:
    ok = np.ones(len(x), dtype=bool)
    for name, sign, cut in rule:
        value = x[:, names.index(name)]
        ok &= value > cut if sign == ">" else value <= cut
    return ok


def learn(x: np.ndarray, bad: np.ndarray, prune: np.ndarray, names: list[str], precise: float = PRECISE, most_rules: int = 12, most_conditions: int = 4) -> list[Rule]:
    """A decision list of at most most_rules rules of most_conditions tests each for the bad class: x has a column for each name; prune marks the pruning rows."""
    rules: list[Rule] = []
    left = np.ones(len(x), dtype=bool)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 50))) if len(x) else np.zeros(0) for j in range(len(names))]
    while len(rules) < most_rules and (left & bad & ~prune).sum() >= 5:
        rule: Rule = []
        here = left & ~prune
        while len(rule) < most_conditions and (here & ~bad).any():
            p0, n0 = (here & bad).sum(), (here & ~bad).sum()
            best, pick = 1e-9, None
            for j, name in enumerate(names):
                for cut in cuts[j]:
                    for sign, hit in ((">", x[:, j] > cut), ("<=", x[:, j] <= cut)):
                        p = (here & hit & bad).sum()
                        if p:
                            n = (here & hit & ~bad).sum()
                            gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                            if gain > best:
                                best, pick = gain, (name, sign, float(cut))
            if pick is None:
                break
            rule.append(pick)
            here &= _holds(x, names, [pick])
        worth = lambda r: (lambda p, n: (p / (p + n) if p + n else 0.0, p))(*((_holds(x, names, r) & left & prune & b).sum() for b in (bad, ~bad)))
        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=lambda r: (round(worth(r)[0], 2), worth(r)[1]), default=[])
        if not rule or worth(rule)[0] < precise:
            break
        rules.append(rule)
        left &= ~_holds(x, names, rule)
    return rules


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality", sample: int = SAMPLE) -> list[Rule]:
    """Rules from labelled statistics of at most `sample` rows."""
    named = labels.filter(F.col(key).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(quality).alias("quality"))
    chosen = named.orderBy(F.xxhash64("key"), "key").limit(sample)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")  # at most `sample` keys
    rows = rows.groupBy("key").agg(F.max(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select("key", "x.text")  # one row a key
    stats = statistics(rows, "key", "text").join(F.broadcast(chosen), "key")
    got = stats.select("key", "quality", base_failed().alias("failed"), F.pmod(F.xxhash64(F.lit(7), "key"), F.lit(3)).alias("part"), *[v.alias(k) for k, v in features().items()]).collect()
    # Sorted out here: as a filter, the base rules would be computed below the join, for every row of df.
    got = sorted((r for r in got if not r.failed), key=lambda r: r.key)
    names = list(features())
    x = np.array([[r[k] for k in names] for r in got], dtype=float).reshape(len(got), len(names))
    return learn(x, np.array([r.quality == 0 for r in got], dtype=bool), np.array([r.part == 0 for r in got], dtype=bool), names)


def first_rule(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; null if none does. An ordered conditional expression."""
    known, out = features(), F.lit(None).cast("int")
    for i in range(len(rules), 0, -1):
        test = F.lit(True)
        for name, sign, cut in rules[i - 1]:
            test &= known[name] > cut if sign == ">" else known[name] <= cut
        out = F.when(test, F.lit(i)).otherwise(out)
    return out


def rate(df: DataFrame, rules: list[Rule], key: str = "doc_id", text: str = "text") -> DataFrame:
    stats = statistics(df, key, text)
    out = stats.select("*", base_failed().alias("base_failed"), first_rule(rules).alias("rule"))
    return out.select(
        F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule"
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return rate(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
