"""Quality rules as weak supervision.

Each rule looks at counts of the whole text and votes good, bad, or abstains.
Expectation-maximisation over the vote patterns estimates how often each rule
votes so on good and on bad documents, and a document's posterior probability
of being good decides, instead of passing every rule.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, let, materialise, words

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
KEEP_FROM = 0.5
ITERATIONS = 40
# Weight of the prior on each rule's table, as a share of the documents: rules are
# taken to be specific (seldom bad on good texts) until the votes say otherwise.
PRIOR_SHARE = 0.1
PRIOR_GOOD = 0.85
PRIOR_BAD_VOTE = {"good": 0.005, "bad": 0.25}
# Every rule is taken to be better than chance: it votes bad on at most this share of
# the good documents, and on at least that share of the bad ones.
BAD_VOTE_ON_GOOD, BAD_VOTE_ON_BAD = 0.01, 0.1
SHARE_GOOD = (0.5, 0.97)


def _repeat_words(ws: Column) -> Column:
    """Words that lie in an 8-word window found at least twice."""
    starts = F.when(F.size(ws) >= WINDOW, F.sequence(F.lit(1), F.size(ws) - (WINDOW - 1)))
    windows = F.transform(starts, lambda i: F.xxhash64(F.slice(ws, i, WINDOW)))

    def covered(hs: Column) -> Column:
        order = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def again(s: Column) -> Column:
            return F.filter(s, lambda e, i: F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False))
                            | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)))

        at = let(order, lambda s: F.array_sort(F.transform(again(s), lambda e: e["i"])))
        steps = let(at, lambda p: F.transform(p, lambda x, i: F.least(
            F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    # Most texts repeat no window; for those, counting distinct hashes is all.
    return F.coalesce(let(windows, lambda hs: F.when(
        F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(covered(hs))), F.lit(0))


def _count(text: Column, chars: str) -> Column:
    """Characters of a regular expression's class."""
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, f"{chars}+", ""))).cast("long")


def features(text: Column) -> Column:
    """Struct of counts of the whole text; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counts(ws: Column) -> Column:
        return F.struct(F.size(ws).cast("long").alias("n_words"),
                        F.char_length(F.array_join(ws, "")).cast("long").alias("word_chars"),
                        _repeat_words(ws).cast("long").alias("n_repeat_words"),
                        F.size(F.array_distinct(ws)).cast("long").alias("n_distinct"))

    def line_counts(ls: Column) -> Column:
        return F.struct(F.size(ls).cast("long").alias("n_lines"),
                        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"))

    return F.struct(let(words(text), counts).alias("w"), let(lines, line_counts).alias("l"),
                    _count(text, SYMBOLS).alias("n_symbols"), _count(text, "[A-Z]").alias("n_upper"),
                    _count(text, "[0-9]").alias("n_digits"), _count(text, "[!?]").alias("n_marks"))


def _vote(bad: Column, good: Column | None = None) -> Column:
    """0 bad, 1 good, 2 abstain."""
    v = F.when(bad, 0)
    return (v.when(good, 1) if good is not None else v).otherwise(2)


def votes() -> dict[str, Column]:
    """The rules, over the columns of ``measure``. Most come in two strengths, so that a
    text which is slightly odd in one way gets one bad vote and junk gets several."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    long = F.col("n_words") >= 50
    rules = {"length": _vote(F.col("n_words") < 25, F.col("n_words") >= 40),
             "word_length": _vote((chars < 2 * n) | (chars > 15 * n), (chars >= 3 * n) & (chars <= 10 * n))}
    for name, value, some, many in (
            ("symbols", F.col("n_symbols") / n, 0.1, 0.25),
            ("repeats", F.col("n_repeat_words") / n, 0.15, 0.25),
            ("lines", F.when(F.col("n_lines") >= 5, F.col("n_dup_lines") / F.col("n_lines")), 0.3, 0.5),
            ("capitals", F.col("n_upper") / chars, 0.25, 0.5),
            ("marks", F.col("n_marks") / n, 0.15, 0.4),
            ("sameness", F.when(long, 1 - F.col("n_distinct") / n), 0.85, 0.93),
            ("digits", F.col("n_digits") / chars, 0.2, 0.4)):
        rules[f"{name}_some"], rules[f"{name}_many"] = _vote(value > some), _vote(value > many)
    return rules


def estimate(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[list[list[float]]]]:
    """EM over (votes of each rule, number of documents): the share of good documents and
    table[rule][class][vote], class 0 bad, 1 good."""
    rules = len(patterns[0][0])
    total = sum(n for _, n in patterns)
    weight = max(1.0, PRIOR_SHARE * total)
    # The prior: bad votes by class as above, the rest shared as the votes are.
    prior = []
    for j in range(rules):
        seen = [sum(n for v, n in patterns if v[j] == k) for k in range(3)]
        rest = max(1, seen[1] + seen[2])
        prior.append([[b, (1 - b) * seen[1] / rest, (1 - b) * (seen[2] / rest if seen[1] + seen[2] else 1)]
                      for b in (PRIOR_BAD_VOTE["bad"], PRIOR_BAD_VOTE["good"])])
    share, table = PRIOR_GOOD, [[list(p) for p in q] for q in prior]
    for _ in range(ITERATIONS):
        mass = [0.0, 0.0]
        count = [[[0.0] * 3 for _ in range(2)] for _ in range(rules)]
        for v, n in patterns:
            g = posterior(share, table, v) * n
            for c, m in ((0, n - g), (1, g)):
                mass[c] += m
                for j in range(rules):
                    count[j][c][v[j]] += m
        share = min(max((mass[1] + weight * PRIOR_GOOD) / (total + weight), SHARE_GOOD[0]), SHARE_GOOD[1])
        table = [[[(count[j][c][k] + weight * prior[j][c][k]) / (mass[c] + weight) for k in range(3)]
                  for c in range(2)] for j in range(rules)]
        for bad, good in table:
            _hold(bad, max(bad[0], BAD_VOTE_ON_BAD))
            _hold(good, min(good[0], BAD_VOTE_ON_GOOD))
    return share, table


def _hold(p: list[float], first: float) -> None:
    """Set p[0] and scale the others so that the sum stays 1."""
    rest = max(p[1] + p[2], 1e-12)
    p[1:] = [x * (1 - first) / rest for x in p[1:]]
    p[0] = first


def _odds(p: list[list[float]], k: int) -> float:
    return math.log(max(p[1][k], 1e-9)) - math.log(max(p[0][k], 1e-9))


def posterior(share: float, table: list[list[list[float]]], v: tuple[int, ...]) -> float:
    z = math.log(share) - math.log(1 - share) + sum(_odds(table[j], k) for j, k in enumerate(v))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def measure(docs: DataFrame, carry: bool = False) -> DataFrame:
    """Per row: doc_id and the counts; with ``carry`` the whole row in ``__threadlens_row``."""
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW)] if carry else []
    f = docs.select(*own, "doc_id", features(F.col("text")).alias("f"))
    return f.select(*([ROW] if carry else []), "doc_id", "f.w.*", "f.l.*", "f.n_symbols",
                    "f.n_upper", "f.n_digits", "f.n_marks")


def judge(docs: DataFrame, carry: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, p_good, and each rule's vote.

    Counts are over whole texts of all documents; the vote patterns with their numbers go
    to the driver for EM: three outcomes for each of two rules and seven pairs of rules,
    so at most 3^9 = 19,683 rows whatever the input.
    A null or empty text has zero counts and fails the base. An empty table gives no
    rows. Rows are judged one by one, so repeated rows and null ids change nothing.
    """
    rules = votes()
    names = [f"vote_{k}" for k in rules]
    voted = lambda m: m.select("*", *[v.cast("tinyint").alias(f"vote_{k}") for k, v in rules.items()])
    seen = materialise(voted(measure(docs)), "quality")
    rows = seen.groupBy(*names).count().collect()
    share, table = estimate(sorted((tuple(r)[:-1], r["count"]) for r in rows)) if rows else (PRIOR_GOOD, [])
    z = F.lit(math.log(share) - math.log(1 - share))
    for name, p in zip(names, table):
        z = z + F.element_at(F.array(*[F.lit(_odds(p, k)) for k in range(3)]), F.col(name).cast("int") + 1)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    good = 1 / (1 + F.exp(-z))
    # With whole rows the counts are made again, which is cheaper than storing the texts.
    return (voted(measure(docs, carry=True)) if carry else seen).select(*([ROW] if carry else []), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                       "n_repeat_words", failed.alias("base_failed"),
                       (~failed & (good >= KEEP_FROM)).alias("kept"), good.alias("p_good"), *names)


def good_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their own columns."""
    return judge(docs, carry=True).where("kept").select(*[F.col(f"{ROW}.`{c}`") for c in docs.columns])
