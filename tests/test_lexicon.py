"""Sentiment by a lexicon table and by a user's scorer."""

from __future__ import annotations

from threadlens.functions.sentiment import LEXICON, with_compound, with_compound_table, with_scorer

TEXTS = ["good", "NOT good but very bad!!", "This is GREAT, really great!", "", None, "it was not very good", "nothing here",
         "good " * 3000, "bad but good", "hate hate LOVE", "isn't bad!"]


def test_table_equals_literal(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(None, "good")], "id long, t string")
    lexicon = spark.createDataFrame([*LEXICON.items(), (None, 1.0), ("unused", 3.0)], "word string, val double")
    want = {r.id: r.compound for r in with_compound(df, "t").collect()}
    got = {r.id: r.compound for r in with_compound_table(df, "id", "t", lexicon).collect()}
    assert got.pop(None) is None and want.pop(None) is not None
    assert got == want and len(set(got.values())) > 5


def test_user_scorer(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, t string")
    got = {r.id: r.s for r in with_scorer(df, "t", lambda texts: [float(len(t)) for t in texts], "s").collect()}
    assert got == {i: float(len(t or "")) for i, t in enumerate(TEXTS)}


def test_a_text_is_cut_and_summed_once(spark):
    """The plan holds one sum over a text's tokens and cuts no text for each lexicon word in it."""
    df = with_compound(spark.createDataFrame([(1, "good")], "id int, t string"), "t")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 1 and plan.count("element_at(map(keys: [great") <= 1 and len(plan) < 20_000


def test_scored_comments_are_written_without_texts(spark):
    from conftest import SF_SMALL
    from threadlens.plans.q_text import i1_comment_sentiment, scored_comments
    c = scored_comments(spark, SF_SMALL)
    assert "body" not in c.columns and c.inputFiles()
    assert c.select("comment_id", "compound").exceptAll(i1_comment_sentiment(spark, SF_SMALL)).isEmpty()
