"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A sample gives each rule's cost and the share of rows it rejects. The rules
then run in the order of rejections per cost, as one nested conditional: a row
that a rule rejects never reaches the rules behind it.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from . import common as C

#: Rows on which costs and selectivities are estimated; they set the order of the rules, never a verdict.
SAMPLE_ROWS = 400
BLANK = rf"[{C.SPACE}]+"


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column
    #: Characters it reads of a text, beside the counts.
    reads: Column | None = None


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda s: s.rlike(C.WORD))


def window_hashes(w: Column) -> Column:
    at = F.when(F.size(w) > 2, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))


def n_repeat_words(h: Column) -> Column:
    """Words in 3-word windows found twice or more, from the windows' hashes.

    Sorting makes equal windows neighbours; the union of their positions, three
    words each, is counted. Texts without a repeat skip that.
    """
    keyed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    like = lambda a, i, x: F.coalesce(F.get(a, i)["h"] == x["h"], F.lit(False))
    repeated = _let(keyed, lambda a: F.transform(F.filter(a, lambda x, i: like(a, i - 1, x) | like(a, i + 1, x)), lambda x: x["i"]))
    steps = _let(F.sort_array(repeated), lambda a: F.transform(a, lambda x, i: F.least(F.lit(3), F.coalesce(x - F.get(a, i - 1), F.lit(3)))))
    total = F.aggregate(steps, F.lit(0), lambda s, x: s + x)
    return F.when(F.size(F.array_distinct(h)) < F.size(h), total).otherwise(F.lit(0)).cast("long")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def features(docs: DataFrame) -> DataFrame:
    """Add the counts that the rules use, over the whole text; a null text has none of anything."""
    text = F.coalesce("text", F.lit(""))
    w, l, h = (C.free(n, docs) for n in ("_w", "_l", "_h"))
    base = docs.withColumns({w: words(text), l: lines_with_words(text)}).withColumn(h, window_hashes(F.col(w)))
    return base.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": (F.length(F.regexp_replace(text, BLANK, ""))).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).cast("long"),
            "n_dup_lines": (F.size(l) - F.size(F.array_distinct(l))).cast("long"),
            "n_repeat_words": n_repeat_words(F.col(h)),
        }
    ).drop(w, l, h)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def default_rules() -> tuple[Rule, ...]:
    """Each rejects a text that is clearly not prose."""
    text = F.coalesce("text", F.lit(""))
    upper = F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))
    letters = F.length(text) - F.length(F.regexp_replace(text, r"\p{L}+", ""))
    n_lines = F.size(F.split(text, "\n"))
    return (
        Rule("symbols", F.col("n_symbols") * 20 > F.col("word_chars")),
        Rule("word_length", (F.col("word_chars") > F.col("n_words") * 20) | (F.col("word_chars") < F.col("n_words") * 2)),
        Rule("repeats", F.col("n_repeat_words") * 10 > F.col("n_words") * 3),
        Rule("duplicate_lines", F.col("n_dup_lines") * 10 > n_lines * 3, F.length(text)),
        Rule("capitals", upper * 2 > letters, F.length(text) * 2),
        Rule("few_letters", letters * 2 < F.col("word_chars"), F.length(text)),
    )


def ordered(sample: DataFrame, rules: tuple[Rule, ...]) -> list[tuple[Rule, float, float]]:
    """Rules by rejections per cost on the sample, with (selectivity, cost); ties keep their order.

    A rule's cost is one for the counts that it compares and the mean of the
    characters that it reads. It depends on the texts only, not on a clock, so
    that equal inputs give equal orders.
    """
    hits = [F.avg(F.coalesce(r.rejects, F.lit(False)).cast("int")).alias(f"h{i}") for i, r in enumerate(rules)]
    costs = [F.avg(F.lit(1.0) if r.reads is None else 1.0 + r.reads).alias(f"c{i}") for i, r in enumerate(rules)]
    got = sample.agg(*hits, *costs).first() if rules else ()
    found = [(r, got[i] or 0.0, got[len(rules) + i] or 1.0) for i, r in enumerate(rules)]
    return sorted(found, key=lambda x: -x[1] / x[2])


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects the row, in this order; null if none does."""
    verdict = F.lit(None).cast("string")
    for r in reversed(rules):
        verdict = F.when(F.coalesce(r.rejects, F.lit(False)), F.lit(r.name)).otherwise(verdict)
    return verdict


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Add the counts, ``base_failed``, ``rejected_by`` and ``kept``.

    Empty and null texts fail the base rule. The verdict ``kept`` does not
    depend on the order of the rules; ``rejected_by`` names the first one in the
    order that the sample gave: the first rows by a hash of the id, from all of the input.
    """
    docs = docs.drop("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", "kept")
    rules = default_rules() if rules is None else rules
    order = ordered(features(C.sample(docs, sample_rows)), rules)
    out = features(docs).withColumn("base_failed", base_failed())
    first = F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade([r for r, _, _ in order]))
    return out.withColumn("rejected_by", first).withColumn("kept", F.col("rejected_by").isNull())


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
