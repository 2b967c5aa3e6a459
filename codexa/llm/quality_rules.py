"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0). Expectation-maximisation over the counts of vote patterns (a table
bounded by 3 ** len(RULES) rows, whatever the corpus) estimates the share of good documents and, for both kinds of
document, how often each rule is right when it votes. A document is kept if its posterior probability of being good is
at least KEEP_FROM and it passes the base rules.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexa.llm.common import set_aside, written

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Posterior from which a document is kept.
KEEP_FROM = 0.25
START_GOOD, START_ON_GOOD, START_ON_BAD = 0.85, 0.97, 0.3
SYMBOLS = "#*$%&|<>"
WHITE = r"[\x20\x09-\x0D]+"
_MARKS = SYMBOLS + "!?.,;:"

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_capitals", "n_others", "n_runs", "n_bangs", "n_stops")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _rules() -> dict[str, Column]:
    words = F.col("n_words")
    length = _share("word_chars", "n_words")
    return {
        "symbols": _vote(_share("n_symbols", "n_words") >= 0.1, _share("n_symbols", "n_words") <= 0.02),
        "bangs": _vote(_share("n_bangs", "n_words") >= 0.1, _share("n_bangs", "n_words") <= 0.03),
        "capitals": _vote(_share("n_capitals", "word_chars") >= 0.35, _share("n_capitals", "word_chars") <= 0.15),
        "letters": _vote(_share("n_others", "word_chars") >= 0.12, _share("n_others", "word_chars") <= 0.07),
        "runs": _vote(_share("n_runs", "n_words") >= 0.1, _share("n_runs", "n_words") <= 0.02),
        "repeats": _vote(_share("n_repeat_words", "n_words") > 0.2, _share("n_repeat_words", "n_words") <= 0.05),
        "lines": _vote(_share("n_dup_lines", "n_lines") >= 0.3, (_share("n_dup_lines", "n_lines") <= 0.1) & (F.col("n_lines") > 1)),
        "word_length": _vote((length < 2.5) | (length > 12), (length >= 3.5) & (length <= 9)),
        "variety": _vote((words >= 50) & (_share("n_distinct", "n_words") < 0.1), _share("n_distinct", "n_words") >= 0.25),
        "sentences": _vote((words >= 40) & (F.col("n_stops") * 200 < words), (words >= 10) & (F.col("n_stops") * 60 >= words)),
    }


RULES = ("symbols", "bangs", "capitals", "letters", "runs", "repeats", "lines", "word_length", "variety", "sentences")


@dataclass(frozen=True)
class Accuracies:
    """The share of good documents; for each rule, how often it is right on good and on bad ones when it votes."""

    good: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> Accuracies:
    """Expectation-maximisation from (votes, documents) pairs.

    A rule looks for one defect, so it starts as right on nearly all good documents and on the few bad ones that have
    it. Each estimate holds ten pseudo-votes at its start; rules without votes, or an empty corpus, stay there.
    """
    n = len(RULES)
    model = Accuracies(START_GOOD, (START_ON_GOOD,) * n, (START_ON_BAD,) * n)
    for _ in range(rounds):
        weights = [(v, c, posterior(v, model)) for v, c in patterns]
        total = sum(c for _, c, _ in weights)
        good = sum(c * p for _, c, p in weights)
        on_good, on_bad = [], []
        for j in range(n):
            voted_good = sum(c * p for v, c, p in weights if v[j])
            right_good = sum(c * p for v, c, p in weights if v[j] > 0)
            voted_bad = sum(c * (1 - p) for v, c, p in weights if v[j])
            right_bad = sum(c * (1 - p) for v, c, p in weights if v[j] < 0)
            on_good.append(min(0.999, max(0.5, (right_good + 10 * START_ON_GOOD) / (voted_good + 10))))
            on_bad.append(min(0.999, (right_bad + 10 * START_ON_BAD) / (voted_bad + 10)))
        model = Accuracies(min(0.99, max(0.5, (good + 10 * START_GOOD) / (total + 10))), tuple(on_good), tuple(on_bad))
    return model


def _log_odds(model: Accuracies) -> tuple[float, list[float], list[float]]:
    """At no vote; added by a good and by a bad vote of each rule."""
    up = [math.log(a / (1 - b)) for a, b in zip(model.on_good, model.on_bad, strict=True)]
    down = [math.log((1 - a) / b) for a, b in zip(model.on_good, model.on_bad, strict=True)]
    return math.log(model.good / (1 - model.good)), up, down


def posterior(votes: tuple[int, ...], model: Accuracies) -> float:
    start, up, down = _log_odds(model)
    odds = start + sum(up[j] if v > 0 else down[j] for j, v in enumerate(votes) if v)
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def _removed(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _windows(words: str) -> Column:
    """A 64-bit hash for each window of WINDOW words."""
    return F.expr(f"CASE WHEN size({words}) >= {WINDOW} THEN transform(sequence(0, size({words}) - {WINDOW}), i -> xxhash64({', '.join(f'{words}[i + {k}]' for k in range(WINDOW))})) ELSE array() END")


def measured(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with the columns FEATURES (long), replacing any of these names; the text goes unless kept.

    _row is there so that a filter on what follows from the features isn't pushed below them, where each mention of a
    feature would be computed anew.
    """
    docs = docs.drop(*[c for c in docs.columns if c in (*FEATURES, "_t", "_w", "_h", "_lines", "_s", "_p", "_row")])
    df = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_w", F.array_remove(F.split("_t", WHITE), "")).withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "")) != ""))
    df = df.withColumn("_h", _windows("_w"))
    # Only texts in which some window recurs are sorted; "_p" has the places of windows found twice or more.
    df = df.withColumn("_s", F.expr("CASE WHEN size(array_distinct(_h)) < size(_h) THEN sort_array(transform(_h, (h, i) -> struct(h, i))) ELSE array() END"))
    df = df.withColumn("_p", F.expr("sort_array(transform(filter(_s, (x, k) -> (k > 0 AND _s[k - 1].h = x.h) OR (k < size(_s) - 1 AND _s[k + 1].h = x.h)), x -> x.i))"))
    joined = F.array_join("_w", "")
    df = df.select(
        *[F.col(f"`{c}`") for c in docs.columns if keep_text or c != text],
        F.size("_w").cast("long").alias("n_words"),
        F.length(joined).cast("long").alias("word_chars"),
        _removed(F.col("_t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"aggregate(transform(_p, (p, k) -> CASE WHEN k < size(_p) - 1 THEN least({WINDOW}, _p[k + 1] - p) ELSE {WINDOW} END), 0L, (a, x) -> a + x)").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        _removed(F.col("_t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_capitals"),
        _removed(F.col("_t"), _MARKS).cast("long").alias("n_others"),
        F.regexp_count("_t", F.lit(r"([!#*$%&])\1")).cast("long").alias("n_runs"),
        (F.length("_t") - F.length(F.replace("_t", F.lit("!"), F.lit("")))).cast("long").alias("n_bangs"),
        _removed(F.col("_t"), ".!?").cast("long").alias("n_stops"),
        F.monotonically_increasing_id().alias("_row"),
    )
    return df


def judge(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with their features, each rule's vote (vote_<rule>), quality (the posterior), base_failed and kept.

    Words are runs of characters outside U+0020 and U+0009 to U+000D. A null text has no words; then, as for any text of
    under MIN_WORDS words, the base rules fail. Repeated rows are judged each, alike. Columns of docs with the names
    of the results are replaced, all others stay. No rows give no rows. The model is fitted over all rows. Without the text, their
    features are written to the shared folder once; with it, they are measured again, as that moves no text.
    """
    rules = _rules()
    results = (*FEATURES, *[f"vote_{r}" for r in RULES], "quality", "base_failed", "kept")
    docs, back = set_aside(docs.drop(*[c for c in docs.columns if c in results and c != text]), text)
    voted = measured(docs, text, keep_text).withColumns({f"vote_{r}": rules[r] for r in RULES})
    table = voted if keep_text else written(voted, "rules")
    counts = table.groupBy(*[f"vote_{r}" for r in RULES]).count().collect()  # at most 3 ** len(RULES) rows
    model = fit([(tuple(r[:-1]), r[-1]) for r in sorted(counts)])
    start, up, down = _log_odds(model)
    odds = F.lit(start)
    for j, r in enumerate(RULES):
        odds = odds + F.when(F.col(f"vote_{r}") > 0, up[j]).when(F.col(f"vote_{r}") < 0, down[j]).otherwise(0.0)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = table.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    return back(judged.withColumn("kept", ~failed & (F.col("quality") >= KEEP_FROM) & (F.col("_row") >= 0)), *results)
