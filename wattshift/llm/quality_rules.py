"""Quality rules whose cutoffs carry a guarantee against rejecting good documents.

Every rule compares one measure of a text with a cutoff. Cutoffs come from labelled rows. The candidates are joint settings
of all rules, fixed beforehand: each setting tightens one rule by one step, the rules in turn. For a stratum (language) the
settings are tested from the laxest on; one passes if the exact binomial tail says that the share of good documents that any
rule rejects is at most ``risk``. Testing stops at the first failure, so the order itself guards against testing many
settings, and the error probability ``error`` is divided by the number of strata and the pool (Bonferroni). With
probability at least ``1 - error`` the rules together reject at most ``risk`` of the good documents of every stratum with a
setting of its own.

A stratum needs about ``log(error / (strata + 1)) / log(1 - risk)`` good labelled documents (228 at four strata) before its
first setting can pass. Strata that pass none take the strictest setting of the pool of all strata's labelled rows at which
no more than ``risk`` of their own good documents fall, if they have any; the promise of the pool is one over all languages together.

All work is built-in column functions and joins; the measures are the only thing that is kept between steps.

Defined cases: null text has no words (and fails the base rule); null language is a stratum of its own; repeated rows
are separate documents, a repeated label of one id counts once (the lower quality); labels without document and null
labels do not count; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattshift.llm.common import settle

# Rule: (measure, candidate cutoffs from lax to strict); a document above the cutoff is rejected.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("symbol_ratio", (2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1)),
    "upper": ("upper_ratio", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2)),
    "repeats": ("repeat_ratio", (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15)),
    "lines": ("dup_line_ratio", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)),
}


def settings() -> list[tuple[float, ...]]:
    """Joint settings from lax to strict, a cutoff per rule: the first takes every rule's first candidate, each next one
    tightens one rule, the rules in turn."""
    grids = [grid for _, grid in RULES.values()]
    turns = sorted((i, r) for r, grid in enumerate(grids) for i in range(1, len(grid)))
    out = [tuple(grid[0] for grid in grids)]
    for i, r in turns:
        out.append(out[-1][:r] + (grids[r][i],) + out[-1][r + 1:])
    return out


@dataclass(frozen=True)
class RiskParams:
    risk: float = 0.02       # share of a stratum's good documents that the rules may reject
    error: float = 0.05      # probability that the guarantee fails in any stratum
    min_words: int = 50      # base rule
    max_repeat: int = 50     # base rule: percent of words in repeated 3-word windows


def _gap_sum(starts: Column) -> Column:
    """Words covered by 3-word windows at the sorted starts."""
    follows = F.zip_with(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))),
                         F.slice(starts, 1, F.greatest(F.size(starts) - 1, F.lit(0))),
                         lambda b, a: F.least(b - a, F.lit(3)))
    total = F.aggregate(follows, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return F.when(F.size(starts) > 0, total + 3).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Counts of every text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper.

    A repeated window is found by sorting (hash of three words, place) inside the row; neighbours with one hash repeat.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = [F.col(c) for c in keep]
    words = docs.select(
        *kept,
        F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "").alias("w"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]")).alias("l"),
        (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long").alias("n_upper"),
    )
    hashed = words.select(
        *kept, "n_symbols", "n_upper",
        F.size("w").cast("long").alias("n_words"),
        F.aggregate("w", F.lit(0).cast("long"), lambda acc, w: acc + F.length(w)).alias("word_chars"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda w: F.xxhash64(w)).alias("h"),
    )
    windows = hashed.withColumn("g", F.transform(
        F.slice("h", 1, F.greatest(F.size("h") - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get("h", i + 1), F.get("h", i + 2))))
    packed = windows.withColumn("s", F.when(
        F.size(F.array_distinct("g")) < F.size("g"),
        F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
    ).otherwise(F.array().cast("array<struct<g:bigint,i:int>>")))
    at = lambda i: F.get("s", i)["g"]
    repeated = packed.withColumn("r", F.sort_array(F.transform(
        F.filter("s", lambda x, i: (x["g"] == at(i - 1)) | (x["g"] == at(i + 1))), lambda x: x["i"])))
    return repeated.select(*kept, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_upper",
                           _gap_sum(F.col("r")).alias("n_repeat_words"))


def with_ratios(counts: DataFrame, params: RiskParams) -> DataFrame:
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return counts.select(
        "*",
        ratio("n_symbols", "n_words").alias("symbol_ratio"),
        ratio("n_upper", "word_chars").alias("upper_ratio"),
        ratio("n_repeat_words", "n_words").alias("repeat_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ((F.col("n_words") < params.min_words)
         | (100 * F.col("n_repeat_words") > params.max_repeat * F.col("n_words"))).alias("base_failed"),
    )


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for n trials of probability p, summed in logarithms; 1 where k is at least the mean."""
    step = lambda acc, i: F.struct(
        (acc["t"] + F.log((n - i) / (i + 1)) + F.log(F.lit(p / (1 - p)))).alias("t"),
        (acc["s"] + F.exp(acc["t"])).alias("s"))
    start = F.struct((n * F.log(F.lit(1 - p))).alias("t"), F.lit(0.0).alias("s"))
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), k), start, step, lambda acc: acc["s"])
    return F.when(k < n * p, F.least(tail, F.lit(1.0))).otherwise(F.lit(1.0))


def cutoffs(scored: DataFrame, labels: DataFrame, params: RiskParams) -> DataFrame:
    """One row (stratum, one column per rule): the strictest certified setting; no row where none is.

    scored: doc_id, stratum, base_failed and the measures. The counts behind the tests are sums per stratum, taken
    before the shuffle; only labelled rows are joined, and only their few numbers move. A stratum without labelled rows
    is among them with n = 0, so that it can take the pool's setting.
    """
    good = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
            .groupBy("doc_id").agg(F.min("quality").alias("quality")).filter(F.col("quality") == 1).select("doc_id"))
    holdout = scored.filter(~F.col("base_failed")).join(good, "doc_id", "left_semi")
    steps = settings()
    measured = [m for m, _ in RULES.values()]
    fails = [reduce(lambda a, b: a | b, [F.col(m) > F.lit(float(c)) for m, c in zip(measured, step)]) for step in steps]
    own = holdout.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(f.cast("long")) for f in fails]).alias("k"))
    none = scored.select("stratum").distinct().select("stratum", F.lit(0).cast("long").alias("n"), F.array_repeat(F.lit(0).cast("long"), len(steps)).alias("k"))
    counted = own.unionByName(none).groupBy("stratum").agg(F.max_by("k", "n").alias("k"), F.max("n").alias("n"))
    tests = counted.select("stratum", "n", F.posexplode("k").alias("i", "k"))
    pooled = tests.groupBy("i").agg(F.sum("n").alias("all_n"), F.sum("k").alias("all_k"), F.sum((F.col("n") > 0).cast("long")).alias("strata"))
    level = F.lit(params.error) / (F.col("strata") + 1)
    tested = tests.join(pooled, "i").select(
        "stratum", "i", (binomial_tail(F.col("k"), F.col("n"), params.risk) <= level).alias("own"),
        ((binomial_tail(F.col("all_k"), F.col("all_n"), params.risk) <= level) & (F.col("k") <= params.risk * F.col("n"))).alias("pool"))
    order = Window.partitionBy("stratum").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    held = tested.select("stratum", "i", *[F.min(F.col(c).cast("int")).over(order).alias(c) for c in ("own", "pool")])
    reached = held.groupBy("stratum").agg(F.coalesce(F.max(F.when(F.col("own") == 1, F.col("i"))), F.max(F.when(F.col("pool") == 1, F.col("i")))).alias("i"))
    chosen = F.array(*[F.array(*[F.lit(float(c)) for c in step]) for step in steps])
    return reached.filter("i is not null").select("stratum", *[
        F.get(F.get(chosen, F.col("i")), F.lit(r)).alias(f"max_{rule}") for r, rule in enumerate(RULES)])


def quality_rules(docs: DataFrame, labels: DataFrame, params: RiskParams = RiskParams(),
                  carry: list[Column] | None = None) -> DataFrame:
    """One row per document: its counts, ``base_failed``, the rules that reject it, ``kept``.

    docs: doc_id, text, lang; labels: doc_id, quality (1 good, 0 bad). Other columns are read only for ``carry``,
    expressions that the result shall have besides.
    """
    base = docs.select("doc_id", F.col("lang").alias("stratum"), "text", *(carry or []))
    more = base.columns[3:]
    scored = with_ratios(settle(measures(base, ["doc_id", "stratum", *more])), params)
    chosen = cutoffs(scored, labels.select("doc_id", "quality"), params)
    s, c = scored.alias("s"), chosen.alias("c")
    joined = s.join(c, F.col("s.stratum").eqNullSafe(F.col("c.stratum")), "left")
    failed = [F.when(F.col(m) > F.col(f"max_{rule}"), F.lit(rule)) for rule, (m, _) in RULES.items()]
    rejected = reduce(lambda a, b: a | b, [f.isNotNull() for f in failed])
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~rejected).alias("kept"),
        F.concat_ws(",", *failed).alias("rejected_by"), *more)
