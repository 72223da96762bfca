"""Quality rules whose cutoffs carry a risk guarantee, with DataFrame operations only.

Each rule rejects a document whose metric exceeds a cutoff. On labelled holdout rows of
a stratum (language) a cutoff is certified if the exact binomial (Clopper-Pearson) upper
bound of its false-rejection rate, the rate among documents of good quality, is at most
the rule's share of ``risk``. The cutoffs of a rule are tested from the mildest to the
strictest and testing stops at the first failure (fixed sequence: no correction within a
rule); over rules and strata ``delta`` is divided (Bonferroni). So with probability
1 - delta every stratum loses at most ``risk`` of its good documents to all rules
together. A stratum with too few labelled rows certifies nothing and loses nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder

BLANK = "\\x20\\x09-\\x0D"
#: Strata of their own; rows of rarer languages share one more.
MAX_STRATA = 63
POOLED = "(other)"

#: Cutoffs of each rule from mild to strict: fixed before any label is seen.
SHARE = [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01]
RULES: dict[str, list[float]] = {
    "symbol_share": SHARE,
    "mark_share": SHARE,
    "upper_share": SHARE,
    "dup_line_share": SHARE,
    "repeat_share": SHARE,
    "bare_line_share": SHARE,
    "mean_word": [40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 13.0, 12.0, 11.0, 10.0, 9.0, 8.5, 8.0, 7.5],
}


def text_metrics(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` and the counts of the rules, computed within each row.

    3-word windows are compared by 64-bit hashes. Null texts count as empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    base = docs.withColumn("_t", text).withColumn("_w", F.when(trimmed != "", F.split(trimmed, f"[{BLANK}]+")).otherwise(F.array().cast("array<string>")))
    base = base.withColumn("_l", F.filter(F.split("_t", "\n"), lambda line: line.rlike(f"[^{BLANK}]")))
    base = base.withColumn("n_words", F.size("_w").cast("bigint"))
    grams = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 3), lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))
    base = base.withColumn("_h", F.when(F.col("n_words") > 3, grams).otherwise(F.array().cast("array<bigint>")))
    base = base.withColumn("_dup", F.size(F.array_distinct("_h")) < F.size("_h"))
    # windows found twice or more: equal neighbours in sorted order; only texts that have some are sorted
    ranked = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    base = base.withColumn("_r", F.when(F.col("_dup"), ranked).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    again = F.filter("_r", lambda x, i: (x.h == F.get("_r", i - 1).h) | (x.h == F.get("_r", i + 1).h))
    base = base.withColumn("_p", F.sort_array(F.transform(again, lambda x: x.i)))
    covered = F.aggregate(F.transform("_p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    count = lambda pattern: F.regexp_count("_t", F.lit(pattern)).cast("bigint")
    return base.select(
        *[docs[c] for c in docs.columns], "n_words",
        F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        count("[#*$%&|<>]").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        covered.cast("bigint").alias("n_repeat_words"),
        count("[!?]").alias("n_marks"), count("[A-Z]").alias("n_upper"), F.size("_l").cast("bigint").alias("n_lines"),
        F.size(F.filter("_l", lambda line: ~line.rlike("[.!?:;,\"')\\]]\\s*$"))).cast("bigint").alias("n_bare_lines"))


def rule_metrics() -> dict[str, Column]:
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return {"symbol_share": part("n_symbols", "word_chars"), "mark_share": part("n_marks", "word_chars"), "upper_share": part("n_upper", "word_chars"),
            "dup_line_share": part("n_dup_lines", "n_lines"), "repeat_share": part("n_repeat_words", "n_words"),
            "bare_line_share": part("n_bare_lines", "n_lines"), "mean_word": part("word_chars", "n_words")}


def tail(n: Column, k: Column, p: float) -> Column:
    """P(a binomial of n trials and rate p is at most k), exactly: the sum of its terms, in logarithms.

    Only called for k <= n p, so it takes at most n p steps.
    """
    first = n * math.log1p(-p)
    step = lambda acc, i: F.struct(
        (acc.term + F.log((n - i + 1) / i) + math.log(p / (1 - p))).alias("term"),
        (F.greatest(acc.total, acc.term + F.log((n - i + 1) / i) + math.log(p / (1 - p)))
         + F.log1p(F.exp(-F.abs(acc.total - (acc.term + F.log((n - i + 1) / i) + math.log(p / (1 - p))))))).alias("total"))
    steps = F.when(k > 0, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.exp(F.aggregate(steps, F.struct(first.alias("term"), first.alias("total")), step, lambda acc: acc.total))


def certified_cutoffs(labelled: DataFrame, risk: float, delta: float, rules: dict[str, list[float]]) -> DataFrame:
    """stratum, rule, cutoff (certified ones only), n, k from rows (stratum, good, one column per rule)."""
    good = labelled.where("good")
    strata = good.select("stratum").distinct().count()  # at most MAX_STRATA + 1
    per_rule, per_test = risk / len(rules), delta / (len(rules) * max(strata, 1))
    exceeded = [F.struct(F.lit(r).alias("rule"), sum((F.col(r) > c).cast("int") for c in cuts).alias("_m")) for r, cuts in rules.items()]
    counts = good.select("stratum", F.explode(F.array(*exceeded)).alias("x")).groupBy("stratum", "x.rule", "x._m").agg(F.count(F.lit(1)).alias("n"))
    # cutoffs are exceeded from the strict end: a row over m cutoffs is over the last m
    grid = F.create_map(*[x for r, cuts in rules.items() for x in (F.lit(r), F.array(*map(F.lit, cuts)))])
    spread = counts.groupBy("stratum", "rule").agg(F.sum("n").alias("n"), F.collect_list(F.struct("_m", F.col("n").alias("_n"))).alias("_over"))  # a row a cutoff
    spread = spread.withColumn("_cuts", grid[F.col("rule")])
    tests = spread.select("stratum", "rule", "n", "_over", F.posexplode("_cuts").alias("j", "cutoff"), F.size("_cuts").alias("m"))
    tests = tests.withColumn("k", F.aggregate("_over", F.lit(0).cast("bigint"), lambda a, x: a + F.when(x["_m"] >= F.col("m") - F.col("j"), x["_n"]).otherwise(F.lit(0))))
    passed = (F.col("k") <= F.col("n") * per_rule) & (tail(F.col("n"), F.when(F.col("k") <= F.col("n") * per_rule, F.col("k")).otherwise(F.lit(0)), per_rule) <= per_test)
    tests = tests.withColumn("passed", passed)
    stop = F.min(F.when(~F.col("passed"), F.col("j"))).over(Window.partitionBy("stratum", "rule"))
    kept = tests.withColumn("_stop", F.coalesce(stop, F.col("m"))).where(F.col("j") < F.col("_stop"))
    return kept.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"), F.max("n").alias("n"), F.max("k").alias("k"))


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05, rules: dict[str, list[float]] | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by.

    ``labels`` (doc_id, quality) are the holdout. One row per input row; null texts have
    no words and fail the base rules, null ids have no label, repeated rows are judged
    alike (a document labelled more than once counts for each label), other columns are
    ignored; a missing ``lang`` column is one stratum. Without labels nothing but the base
    rules rejects.
    """
    shared_folder(docs.sparkSession)
    rules = RULES if rules is None else rules
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(POOLED)) if "lang" in docs.columns else F.lit(POOLED)
    counted = text_metrics(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", lang.alias("_lang"))).drop("text")
    counted = counted.withColumns({k: v for k, v in rule_metrics().items() if k in rules}).withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).checkpoint()  # texts are read once
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("quality") == 1).alias("good")).where("good IS NOT NULL")
    labelled = counted.join(marks, "doc_id").where("NOT base_failed")
    named = [r["_lang"] for r in labelled.where("good").groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(MAX_STRATA).collect()]
    stratum = F.when(F.col("_lang").isin(named), F.col("_lang")).otherwise(F.lit(POOLED)).alias("stratum") if named else F.lit(POOLED).alias("stratum")
    certified = certified_cutoffs(labelled.select(stratum, "good", *rules), risk, delta, rules)
    # at most (MAX_STRATA + 1) rows
    table = certified.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cutoffs"))
    judged = counted.withColumn("stratum", stratum).join(F.broadcast(table), "stratum", "left")
    over = F.concat(*[F.when(F.col(r) > F.col("_cutoffs")[r], F.array(F.lit(r))).otherwise(F.array().cast("array<string>")) for r in rules])
    return judged.withColumn("rejected_by", F.array_join(over, ",")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("rejected_by") == "")).alias("kept"), "rejected_by")
