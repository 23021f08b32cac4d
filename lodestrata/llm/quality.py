"""Quality rules with risk-controlled thresholds.

Each rule rejects a text when a measure of it lies beyond a cutoff.  Cutoffs are chosen from labelled holdout rows: for
every stratum and rule, candidate cutoffs are tested from the mildest on, and the strictest one is taken for which the
exact (Clopper-Pearson) upper bound on the share of good texts that it rejects stays within the permitted risk.  The
tests of one rule run in a fixed order and stop at the first failure, so they need no correction among themselves; the
confidence is divided (Bonferroni) by the number of strata times rules, and so is the risk by the number of rules, so
that with the asked confidence no stratum loses more than ``risk`` of its good texts to all rules together.  A stratum
with too few labelled good texts to prove anything rejects nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import gram_hashes, map_slices, prepare, raw, texts, word_hashes, written

WINDOW = 8
#: Measures in steps of 1/STEPS; a rule rejects texts whose measure is at or above its cutoff.
STEPS = 200

_SPACES = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"
_CONTINUED = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(65, 91))

STATS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "n_lines": "long", "n_upper": "long"}

#: Measures between 0 and 1 of which high values speak against a text.
RULES: dict[str, Callable[[], Column]] = {
    "symbols": lambda: F.col("n_symbols") / F.greatest(F.lit(1), F.col("word_chars")),
    "duplicate_lines": lambda: F.col("n_dup_lines") / F.greatest(F.lit(1), F.col("n_lines")),
    "repeated_words": lambda: F.col("n_repeat_words") / F.greatest(F.lit(1), F.col("n_words")),
    "upper_case": lambda: F.col("n_upper") / F.greatest(F.lit(1), F.col("word_chars")),
    "long_words": lambda: F.least(F.lit(1.0), F.col("word_chars") / F.greatest(F.lit(1), F.col("n_words")) / 20),
}

BASE_FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


def repeated_words(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text (its words run from first[i] to first[i+1]), how many words lie in windows that stand twice or more in it."""
    grams, out = gram_hashes(words, WINDOW), np.zeros(len(first) - 1, np.int64)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        n = b - a - WINDOW + 1
        if n < 2:
            continue
        own = grams[a : a + n]
        order = np.argsort(own, kind="stable")
        same = own[order][1:] == own[order][:-1]
        if same.any():
            twice = np.zeros(n, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            cover = np.zeros(b - a + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + WINDOW, -1)
            out[i] = int((np.cumsum(cover)[:-1] > 0).sum())
    return out


def line_counts(data: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them equal to an earlier line."""
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return len(lines), len(lines) - len(set(lines))


def measure(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns to keep, and the counts of STATS of every text; null and empty texts count nothing."""

    def work(part):
        column = part.column("text")
        words, first = word_hashes(column)
        at, data = raw(column)
        whole = data.tobytes()
        out: dict[str, list] = {k: [] for k in STATS}
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            own = whole[a:b]
            points = len(own) - len(own.translate(None, _CONTINUED)) if not own.isascii() else 0
            bare = len(own.translate(None, _SPACES))
            lines, dup = line_counts(own)
            for k, v in (("word_chars", bare - points), ("n_symbols", len(own) - len(own.translate(None, _SYMBOLS))), ("n_dup_lines", dup), ("n_lines", lines), ("n_upper", len(own) - len(own.translate(None, _UPPER)))):
                out[k].append(v)
        out["n_words"] = np.diff(first)
        out["n_repeat_words"] = repeated_words(words, first)
        return {k: part.column(k) for k in part.schema.names if k != "text"} | out

    docs = texts(documents, id_col, text_col, *[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keep)])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    out = map_slices(docs, work, f"{kinds}, " + ", ".join(f"{k} {v}" for k, v in STATS.items()))
    return out.select(F.col("id").alias(id_col), *[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], *STATS)



def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (evaluated from the side where it settles
    fast)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    value, c, d = 1.0, 1.0, 0.0
    for i in range(100_000):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / ((1 + term * d) or tiny)
        c = (1 + term / c) or tiny
        value *= c * d
        if abs(c * d - 1) < 1e-14 and i > 2:
            break
    return front * (value - 1)


def at_most(bad: int, n: int, share: float) -> float:
    """The chance of ``bad`` or fewer of n at a given share."""
    return 1.0 if bad >= n else beta_share(n - bad, bad + 1, 1 - share)


def upper_bound(bad: int, n: int, confidence: float) -> float:
    """The exact binomial upper bound on a share of which ``bad`` of ``n`` were seen."""
    if bad >= n:
        return 1.0
    low, high = bad / n, 1.0
    for _ in range(50):
        p = (low + high) / 2
        low, high = (p, high) if at_most(bad, n, p) > 1 - confidence else (low, p)
    return high


def cutoff(steps: dict[int, int], risk: float, confidence: float) -> int | None:
    """The strictest proved cutoff of one stratum and rule, from how many good holdout texts have which step of it: the
    upper bound on their share beyond it is at most ``risk`` where so few would be seen with a chance of 1 - confidence at
    most, were it ``risk``."""
    n, bad, chosen = sum(steps.values()), 0, None
    for step in range(STEPS, 0, -1):
        bad += steps.get(step, 0)
        if at_most(bad, n, risk) > 1 - confidence:
            break
        chosen = step
    return chosen


def step_of(rule: str) -> Column:
    return F.least(F.lit(STEPS), F.floor(RULES[rule]() * STEPS)).cast("int")


def judge(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", risk: float = 0.05, confidence: float = 0.95) -> DataFrame:
    """id, the counts of STATS, base_failed, rejected_by (names of rules) and kept of every document.

    Good labelled texts that pass the base rule are the holdout.  Texts without a stratum form one of their own.  With no
    labels nothing but the base rule rejects.  Counts go to a table in the shared folder; the holdout is counted by
    stratum, rule and step, and cutoffs are chosen, in Spark, so there may be any number of strata.
    """
    stats = written(measure(documents, id_col=id_col, text_col=text_col, keep=(stratum_col,)), "quality").withColumn("stratum", F.coalesce(F.col(stratum_col).cast("string"), F.lit("")))
    good = labels.filter(F.col(label_col) == 1).select(F.col(id_col)).distinct()
    held = stats.filter(f"not ({BASE_FAILED})").join(good, id_col, "left_semi")
    per_rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), step_of(r).alias("step")) for r in RULES]))
    table = written(held.select("stratum", per_rule.alias("x")).groupBy("stratum", "x.rule", "x.step").agg(F.count("*").alias("n")), "holdout")
    strata = table.select("stratum").distinct().count()
    sure = 1 - (1 - confidence) / max(1, strata * len(RULES))

    def choose(own: pd.DataFrame) -> pd.DataFrame:
        """At most STEPS + 1 rows of one stratum and rule."""
        found = cutoff(dict(zip(own["step"].tolist(), own["n"].tolist(), strict=True)), risk / len(RULES), sure)
        return pd.DataFrame({"stratum": own["stratum"].iloc[:1], "rule": own["rule"].iloc[:1], "cutoff": pd.array([found], "Int32")})

    prepare(documents.sparkSession)
    chosen = written(table.groupBy("stratum", "rule").applyInPandas(choose, "stratum string, rule string, cutoff int"), "cutoffs")
    limits = chosen.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))
    stats = stats.join(limits, "stratum", "left")
    beyond = [F.when(step_of(rule) >= F.col(rule), F.lit(rule)) for rule in RULES]
    out = stats.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("rejected_by", F.array_compact(F.array(*beyond)))
    return out.select(id_col, *STATS, "base_failed", "rejected_by", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES: dict[str, Callable] = {"op6_quality_rules": query}
ORACLE_SQL: dict[str, str] = {}
