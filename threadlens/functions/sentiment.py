"""Lexicon sentiment (I1) as Spark column expressions — no UDF, no shuffle.

The method follows the published rule-based approach of Hutto & Gilbert
(2014): a valence per known word, adjusted by booster words in the three
preceding tokens (damped by distance), flipped and scaled by a negation in the
three preceding tokens, weighted around the first "but", raised for a word in capitals
inside a text that isn't all capitals, plus emphasis for exclamation marks, then
normalised as s / sqrt(s² + alpha). Tokens are runs of letters of any script;
apostrophes inside words are dropped, so "isn't" is the negation "isnt".

The lexicon is a parameter (any ``{word: valence}`` dict, e.g. loaded from a
table of a few thousand rows); the built-in one below is a small self-written
list for tests and fixtures. Every step is a higher-order array function over
the row's own tokens, so scoring is a narrow, per-row projection.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions.numeric import r6

# Constants of the published method.
BOOST_INCR = 0.293
BOOST_DECR = -0.293
NEGATION_SCALAR = -0.74
ALPHA = 15.0
EXCLAIM_STEP = 0.292
EXCLAIM_MAX = 4
BUT_BEFORE = 0.5
BUT_AFTER = 1.5
BOOST_DAMPING = (1.0, 0.95, 0.9)
CAPS_INCR = 0.733

# Self-written lists of common words by strength; the valence is the strength.
_STRENGTH = {
    3.0: "great excellent love best awesome amazing wonderful perfect",
    2.0: "good happy nice better fun win beautiful glad enjoy helpful thanks",
    1.0: "like thank agree support fair well clean free hope interesting safe",
    -1.0: "problem poor boring annoying disagree junk secret",
    -2.0: "bad worse wrong sad angry awful fail failed broken ugly stupid fake lie fear spam attack toxic",
    -3.0: "worst hate terrible kill scam liar",
}
LEXICON = {w: v for v, ws in _STRENGTH.items() for w in ws.split()}
BOOSTERS = {
    "very": BOOST_INCR, "really": BOOST_INCR, "extremely": BOOST_INCR, "so": BOOST_INCR,
    "absolutely": BOOST_INCR, "totally": BOOST_INCR, "most": BOOST_INCR, "more": BOOST_INCR,
    "slightly": BOOST_DECR, "barely": BOOST_DECR, "somewhat": BOOST_DECR, "less": BOOST_DECR,
    "kind": BOOST_DECR, "little": BOOST_DECR,
}
NEGATIONS = ("not", "no", "never", "nothing", "nobody", "none", "neither", "nor", "without", "cannot",
             "isnt", "arent", "wasnt", "werent", "aint", "dont", "doesnt", "didnt", "wont", "wouldnt", "cant",
             "couldnt", "shouldnt", "hasnt", "havent", "hadnt")

APOSTROPHES = "'\u2019"
TOKEN_SPLIT = r"[^\p{L}]+"


def _plain(text: Column | str) -> Column:
    """The text, NULL as empty, without apostrophes."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    for a in APOSTROPHES:
        t = F.replace(t, F.lit(a), F.lit(""))
    return t


def raw_tokens(text: Column | str) -> Column:
    """Letter runs in their own case, apostrophes dropped."""
    return F.array_remove(F.split(_plain(text), TOKEN_SPLIT), "")


def tokens(text: Column | str) -> Column:
    """Lower-cased letter runs."""
    t = F.col(text) if isinstance(text, str) else text
    return raw_tokens(F.lower(t))


def raw_tokens_sql(expr: str) -> str:
    """The same split in DuckDB SQL."""
    return (f"list_filter(regexp_split_to_array(regexp_replace({expr}, '[''\u2019]', '', 'g'), "
            f"'{TOKEN_SPLIT}'), lambda x: x <> '')")


def _map(d: Mapping[str, float]) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(float(v)))])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _loud(w: Column) -> Column:
    return (w == F.upper(w)) & (w != F.lower(w))


def _score(t: Column, line: Column, toks: Column, lexicon: Mapping[str, float]) -> Column:
    """``line`` holds the raw tokens with a space between them, ``toks`` are the lower-cased ones;
    both must be cheap references.

    All tokens pass one hash-set probe (an IN list becomes InSet) that keeps the places of
    lexicon words; the rest is done for those. What a text has once (its raw tokens, its first
    "but", whether it is in mixed case, the sum) is bound once: a lambda's body is evaluated
    anew wherever it stands, so these would be a scan of all tokens for every lexicon word."""
    lex, boost, keys = _map(lexicon), _map(BOOSTERS), [w for w in lexicon if w]
    places = F.array_compact(F.transform(toks, lambda tok, i: F.when(tok.isin(*keys), i)))

    def val(raw, i, but_pos, mixed):
        # Each adjustment is a factor in a linear chain, keeping the expression small.
        def adjusted(v0):
            sgn = F.when(v0 < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
            v = v0 + F.when(mixed & _loud(F.get(raw, i)), sgn * F.lit(CAPS_INCR)).otherwise(F.lit(0.0))
            for d, damp in enumerate(BOOST_DAMPING, start=1):
                b = F.coalesce(F.try_element_at(boost, F.get(toks, i - d)), F.lit(0.0))
                v = v + sgn * b * F.lit(damp)
            return v
        negated = F.lit(False)
        for d in (1, 2, 3):
            negated = negated | F.coalesce(F.get(toks, i - d).isin(*NEGATIONS), F.lit(False))
        neg_f = F.when(negated, F.lit(NEGATION_SCALAR)).otherwise(F.lit(1.0))
        but_f = (F.when(but_pos < 0, F.lit(1.0)).when(i < but_pos, F.lit(BUT_BEFORE))
                 .when(i > but_pos, F.lit(BUT_AFTER)).otherwise(F.lit(1.0)))
        return _let(F.element_at(lex, F.get(toks, i)), adjusted) * neg_f * but_f

    def total(raw, p):
        mixed = (F.exists(p, lambda i: _loud(F.get(raw, i)))
                 & F.exists(raw, lambda w: ~_loud(w)))                     # a loud lexicon word among others that aren't
        once = F.struct((F.array_position(toks, "but") - 1).alias("but"), mixed.alias("mixed"))  # 0-based, -1 when absent
        return _let(once, lambda o: F.aggregate(
            p, F.lit(0.0), lambda acc, i: acc + val(raw, i, o["but"], o["mixed"])))

    def emphasised(s):
        bangs = F.least(F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit(""))), F.lit(EXCLAIM_MAX))
        emph = F.coalesce(bangs, F.lit(0)).cast("double") * F.lit(EXCLAIM_STEP)
        return F.when(s > 0, s + emph).when(s < 0, s - emph).otherwise(s)

    s = _let(places, lambda p: F.when(F.size(p) > 0, _let(_let(F.split(line, " "), lambda raw: total(raw, p)), emphasised))
             .otherwise(F.lit(0.0)))
    return _let(s, lambda s: r6(s / F.sqrt(s * s + F.lit(ALPHA))))


def with_compound(df, text: str, out: str = "compound",
                  lexicon: Mapping[str, float] | None = None):
    """Add the compound score of ``text`` as column ``out``."""
    return df.withColumn(out, compound(text, lexicon))


def compound(text: Column | str, lexicon: Mapping[str, float] | None = None) -> Column:
    """Compound score as a single expression; what the text is cut into is bound, so no array of
    tokens becomes a column of the rows."""
    t = F.col(text) if isinstance(text, str) else text
    line = F.trim(F.regexp_replace(_plain(t), TOKEN_SPLIT, " "))
    return _let(line, lambda x: _let(F.split(F.lower(x), " "), lambda toks: _score(t, x, toks, lexicon or LEXICON)))


def with_compound_table(df: DataFrame, key: str, text: str, lexicon: DataFrame, out: str = "compound") -> DataFrame:
    """As :func:`with_compound` with a lexicon table (word, val) of any size: one row a lower-case word; words
    that are NULL or repeated with other values count by their mean. ``key`` names the rows of ``df`` and
    must be unique; rows with a NULL key get NULL.

    Token positions become rows with what stands before them and meet the lexicon by word. Words that
    make up more than a 1,024th of all tokens, fewer than 1,024 words, are broadcast; all others are
    shuffled, so no word makes a task large. Texts are dealt over as many tasks as a shuffle has before
    they are cut, whatever files they come from; the lexicon is written once, as it is read twice.
    """
    from threadlens.session import written
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = df.select(F.col(key).alias("_id"), F.col(text).alias("_t")).where("_id is not null").repartition(tasks, "_id")
    x = x.withColumn("_raw", raw_tokens("_t")).withColumn("_toks", F.transform("_raw", lambda w: F.lower(w)))
    x = x.withColumn("_mixed", F.exists("_raw", _loud) & F.exists("_raw", lambda w: ~_loud(w)))
    x = x.withColumn("_but", F.array_position("_toks", "but") - 1)
    each = x.select("_id", "_toks", "_raw", "_mixed", "_but", F.posexplode("_toks").alias("i", "word"))
    boost = _map(BOOSTERS)
    before = [F.get("_toks", F.col("i") - d) for d in (1, 2, 3)]
    negated = F.lit(False)
    for b in before:
        negated = negated | F.coalesce(b.isin(*NEGATIONS), F.lit(False))
    lift = F.lit(0.0)
    for b, damp in zip(before, BOOST_DAMPING):
        lift = lift + F.coalesce(F.try_element_at(boost, b), F.lit(0.0)) * F.lit(damp)
    caps = F.when(_loud(F.get("_raw", "i")) & F.col("_mixed"), F.lit(CAPS_INCR)).otherwise(F.lit(0.0))
    at = F.when(F.col("_but") < 0, F.lit(1.0)).when(F.col("i") < F.col("_but"), F.lit(BUT_BEFORE)).when(
        F.col("i") > F.col("_but"), F.lit(BUT_AFTER)).otherwise(F.lit(1.0))
    tokens_ = written(each.select("_id", "word", (lift + caps).alias("_add"),
                                  (F.when(negated, F.lit(NEGATION_SCALAR)).otherwise(F.lit(1.0)) * at).alias("_by")), "tokens")
    lex = written(lexicon.where("word is not null").groupBy("word").agg(F.avg("val").alias("_v")), "lexicon")
    counts = tokens_.groupBy("word").agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.where(F.col("_n") * 1024 > tokens_.count()).select("word")
    hot = written(hot, "hot-words")
    found = tokens_.join(F.broadcast(hot), "word").join(F.broadcast(lex.join(hot, "word", "left_semi")), "word").unionByName(
        tokens_.join(F.broadcast(hot), "word", "left_anti").join(lex, "word"))
    sign = F.when(F.col("_v") < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    sums = found.groupBy("_id").agg(F.sum((F.col("_v") + sign * F.col("_add")) * F.col("_by")).alias("_s"))
    bangs = F.least(F.length(text) - F.length(F.regexp_replace(text, "!", "")), F.lit(EXCLAIM_MAX))
    emph = F.coalesce(bangs, F.lit(0)).cast("double") * F.lit(EXCLAIM_STEP)
    s = F.when(F.col("_s") > 0, F.col("_s") + emph).when(F.col("_s") < 0, F.col("_s") - emph).otherwise(F.lit(0.0))
    joined = df.join(sums.withColumnRenamed("_id", key), key, "left").withColumn("_s", s)
    known = F.when(F.col(key).isNotNull(), r6(F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + F.lit(ALPHA))))
    return joined.withColumn(out, known).drop("_s")


def with_scorer(df: DataFrame, text: str, scorer: Callable[[list[str]], list[float]], out: str = "compound") -> DataFrame:
    """A user's own scorer instead of a lexicon (M1): it gets the texts of an Arrow batch (NULL as empty) and
    returns a number for each. It must be picklable and is not called for empty batches."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(scorer(texts.fillna("").tolist()) if len(texts) else [], dtype="float64")

    return df.withColumn(out, score(F.col(text)))


def sentiment_sql(src: str, id_col: str, text_col: str, lexicon_sql: str | None = None) -> str:
    """The same rules as DuckDB SQL over ``src`` (rows of id, text): tokens as
    rows with their position, neighbours by ``lag``. Returns CTE text defining
    ``sent(<id_col>, compound)``; ids without lexicon words get 0."""
    lex = lexicon_sql or "SELECT * FROM (VALUES {}) t(word, val)".format(
        ", ".join(f"('{k}', {float(v)})" for k, v in LEXICON.items()))
    boo = ", ".join(f"('{k}', {float(v)})" for k, v in BOOSTERS.items())
    neg = ", ".join(f"'{w}'" for w in NEGATIONS)
    d1, d2, d3 = BOOST_DAMPING
    return f"""
s_src AS (SELECT {id_col} AS sid, coalesce({text_col}, '') AS stext FROM ({src})),
s_tl AS (SELECT sid, stext, {raw_tokens_sql('stext')} AS toks FROM s_src),
s_raw AS (SELECT sid, unnest(toks) AS w, generate_subscripts(toks, 1) - 1 AS pos FROM s_tl),
s_tok AS (SELECT sid, lower(w) AS tok, pos, w = upper(w) AND w <> lower(w) AS loud FROM s_raw),
s_caps AS (SELECT sid, bool_or(loud) AND bool_or(NOT loud) AS some_loud FROM s_tok GROUP BY sid),
s_lex AS ({lex}),
s_boo AS (SELECT * FROM (VALUES {boo}) t(word, val)),
s_but AS (SELECT sid, min(pos) AS bpos FROM s_tok WHERE tok = 'but' GROUP BY sid),
s_ctx AS (SELECT sid, pos, tok, loud, lag(tok, 1) OVER w AS p1, lag(tok, 2) OVER w AS p2, lag(tok, 3) OVER w AS p3
          FROM s_tok WINDOW w AS (PARTITION BY sid ORDER BY pos)),
s_val AS (
  SELECT c.sid, c.pos, l.val AS v0,
         l.val + (CASE WHEN c.loud AND cp.some_loud THEN (CASE WHEN l.val < 0 THEN -1.0 ELSE 1.0 END) * {CAPS_INCR} ELSE 0 END)
               + (CASE WHEN l.val < 0 THEN -1.0 ELSE 1.0 END) * coalesce(b1.val, 0) * {d1}
               + (CASE WHEN l.val < 0 THEN -1.0 ELSE 1.0 END) * coalesce(b2.val, 0) * {d2}
               + (CASE WHEN l.val < 0 THEN -1.0 ELSE 1.0 END) * coalesce(b3.val, 0) * {d3} AS vb,
         coalesce(c.p1 IN ({neg}), false) OR coalesce(c.p2 IN ({neg}), false)
           OR coalesce(c.p3 IN ({neg}), false) AS negated,
         bt.bpos
  FROM s_ctx c JOIN s_lex l ON l.word = c.tok JOIN s_caps cp ON cp.sid = c.sid
  LEFT JOIN s_boo b1 ON b1.word = c.p1 LEFT JOIN s_boo b2 ON b2.word = c.p2
  LEFT JOIN s_boo b3 ON b3.word = c.p3 LEFT JOIN s_but bt ON bt.sid = c.sid),
s_adj AS (SELECT sid, CASE WHEN bpos IS NULL THEN vn WHEN pos < bpos THEN vn * {BUT_BEFORE}
                           WHEN pos > bpos THEN vn * {BUT_AFTER} ELSE vn END AS v
          FROM (SELECT *, CASE WHEN negated THEN vb * {NEGATION_SCALAR} ELSE vb END AS vn FROM s_val)),
s_sum AS (SELECT s_src.sid, coalesce(sum(v), 0.0) AS s0,
                 least(length(any_value(stext)) - length(replace(any_value(stext), '!', '')), {EXCLAIM_MAX})
                   * {EXCLAIM_STEP} AS emph
          FROM s_src LEFT JOIN s_adj ON s_adj.sid = s_src.sid GROUP BY s_src.sid),
sent AS (SELECT sid AS {id_col},
                (floor((floor((s / sqrt(s * s + {ALPHA})) * 1e9 + 0.5) / 1e9) * 1e6 + 0.5) / 1e6) AS compound
         FROM (SELECT sid, CASE WHEN s0 > 0 THEN s0 + emph WHEN s0 < 0 THEN s0 - emph ELSE s0 END AS s FROM s_sum))"""
