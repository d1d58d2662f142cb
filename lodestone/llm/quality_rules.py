"""Quality rules: statistics of each text in Spark expressions, and a decision list learned by sequential covering.

A rule is a conjunction of thresholds on the statistics. Rules for bad texts are grown literal by literal (FOIL's
gain) on two thirds of a bounded labelled sample, pruned on the rest, and kept while they are precise there; the rows
that a rule covers leave the sample before the next one. The list becomes one ordered CASE expression.

Edge cases: a null text is an empty one (no words: it fails the base rule); without labelled rows the list is empty
and the base rule alone decides; rows repeat as they come; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, fold

SPACE = "[\\x20\\x09-\\x0D]+"
WINDOW = 8

#: Statistics that rules may test, as expressions over the base statistics.
FEATURES: dict[str, str] = {
    "n_words": "n_words",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


def repeated_words(words: Column) -> Column:
    """How many words stand in windows of 8 words that occur twice or more in the array, the first occurrence included."""
    # Every array is bound to a lambda's variable: however the optimiser inlines this, nothing is computed once per element.
    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))

    def places(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        again = bind(ordered, lambda s: F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1))))
        return F.sort_array(F.transform(again, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)

    def found(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) < F.size(h), bind(places(h), covered)).otherwise(0)

    return bind(words, lambda w: F.when(F.size(w) > WINDOW, bind(hashes(w), found)).otherwise(0))


def statistics(df: DataFrame) -> DataFrame:
    """doc_id and the statistics of each text."""
    count = lambda pattern: F.regexp_count("t", F.lit(pattern))
    cut = df.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).select(
        "doc_id",
        "t",
        F.filter(F.split("t", SPACE, -1), lambda x: x != "").alias("words"),  # blanks at the ends leave empty pieces
        F.filter(F.split("t", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
    )
    stats = cut.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        count("[#*$%&|<>]").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        count("[A-Z]").cast("long").alias("n_upper"),
        count("[0-9]").cast("long").alias("n_digits"),
        count("[!?#*$%&|<>@~^_=+]").cast("long").alias("n_marks"),
    )
    return stats.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words"))


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.threshold!r}D"


def rule_sql(rule: tuple[Literal, ...]) -> str:
    return " and ".join(x.sql() for x in rule)


def verdict(rules: list[tuple[Literal, ...]]) -> Column:
    """The position of the first rule that fires, from 1; 0 if none does."""
    out = "0" if not rules else "case " + " ".join(f"when {rule_sql(r)} then {k}" for k, r in enumerate(rules, 1)) + " else 0 end"
    return F.expr(f"cast({out} as int)")


def cover(rows: list[dict[str, float]], bad: list[bool], cuts: int = 24, max_rules: int = 16, max_literals: int = 4, precision: float = 0.95, support: int = 5) -> list[tuple[Literal, ...]]:
    """Sequential covering of the bad rows; sets of rows are the bits of integers."""
    n = len(rows)
    if not n or not any(bad):
        return []
    masks: dict[Literal, int] = {}
    for name in FEATURES:
        values = sorted({float(r[name]) for r in rows})
        at = sorted({values[k * (len(values) - 1) // cuts] for k in range(1, cuts)} | {values[k * (len(values) - 1) // 400] for k in (1, 2, 4, 396, 398, 399)})
        for v in at:
            up = sum(1 << k for k, r in enumerate(rows) if r[name] > v) if n < 64 else int("".join("1" if r[name] > v else "0" for r in reversed(rows)), 2)
            masks[Literal(name, True, v)], masks[Literal(name, False, v)] = up, ((1 << n) - 1) & ~up
    positive = int("".join("1" if b else "0" for b in reversed(bad)), 2)
    prune = sum(1 << k for k in range(2, n, 3))
    left, rules = (1 << n) - 1, []
    while len(rules) < max_rules:
        rule, now = [], left & ~prune
        while len(rule) < max_literals:
            p0, n0 = (now & positive).bit_count(), (now & ~positive).bit_count()
            if not p0 or not n0:
                break
            best = (0.0, None)
            for lit, m in masks.items():
                p1 = (now & m & positive).bit_count()
                if p1 >= support:
                    gain = p1 * (log2(p1 / (now & m).bit_count()) - log2(p0 / (p0 + n0)))
                    if gain > best[0] + 1e-9:
                        best = (gain, lit)
            if best[1] is None:
                break
            rule.append(best[1])
            now &= masks[best[1]]

        def worth(k: int, of: int) -> float:
            m = of
            for lit in rule[:k]:
                m &= masks[lit]
            p, q = (m & positive).bit_count(), m.bit_count()
            return (2 * p - q) / q if q else -1.0

        if not rule:
            break
        size = max(range(1, len(rule) + 1), key=lambda k: (worth(k, left & prune), -k))
        rule = rule[:size]
        covered = left
        for lit in rule:
            covered &= masks[lit]
        if (covered & positive).bit_count() < support or (covered & positive).bit_count() < precision * covered.bit_count() or worth(size, left & prune) < 2 * precision - 1.1:
            break
        rules.append(tuple(rule))
        left &= ~covered
    return rules


def learn_rules(df: DataFrame, labels: DataFrame, sample: int = 12000) -> list[tuple[Literal, ...]]:
    """Learns from at most `sample` labelled rows outside the held-out fold, chosen by a hash of the id; the base rule's failures are left out."""
    seen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", 5) != 0)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = seen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = statistics(df.select("doc_id", "text").join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi"))  # at most `sample` ids
    found = rows.join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").select(*(F.expr(e).cast("double").alias(k) for k, e in FEATURES.items()), (F.col("quality") == 0).alias("bad"), "base_failed").collect()
    found = [r for r in found if not r["base_failed"]]
    return cover([r.asDict() for r in found], [r["bad"] for r in found])


def quality_rules(df: DataFrame, rules: list[tuple[Literal, ...]]) -> DataFrame:
    """One row per document: the base statistics, base_failed, the rule that fired (0: none), and kept."""
    out = statistics(df).withColumn("rule", verdict(rules))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule")
