"""Registered text and sentiment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.functions.numeric import r6, sql_r6
from threadlens.functions.predicates import content, sentiment_sign
from threadlens.functions.sentiment import raw_tokens, raw_tokens_sql, sentiment_sql, with_compound, with_compound_table
from threadlens.operators import text as T
from threadlens.operators import timeseries as TS
from threadlens.plans.catalog import EV_CTES, TEXT_CTES, register, sql
from threadlens.sources.roles import forum_with_text, read_table


def _clean_sql(col):
    """The clean tokens of a text column: links out, lower case, letter runs."""
    return raw_tokens_sql(f"lower(regexp_replace(coalesce({col}, ''), 'https?://\\S+', ' ', 'g'))")


def _sent_comments(spark, sf_dir):
    c = forum_with_text(spark, sf_dir).comments
    return with_compound(c, "body")


def scored_comments(spark, sf_dir):
    """The comments with their scores and without their texts, written once for what reads them several times."""
    from threadlens.session import written
    return written(_sent_comments(spark, sf_dir).drop("body"), "scored-comments")


_S_COMMENTS = sentiment_sql("SELECT comment_id, body FROM comments_t", "comment_id", "body")


@register("i1_comment_sentiment", sql(EV_CTES, TEXT_CTES, body=", " + _S_COMMENTS + """
SELECT comment_id, compound FROM sent"""))
def i1_comment_sentiment(spark, sf_dir):
    return _sent_comments(spark, sf_dir).select("comment_id", "compound")


@register("i1_document_sentiment", sql(
    "d0 AS (SELECT doc_id, text FROM documents)",
    body=", " + sentiment_sql("SELECT doc_id, text FROM d0", "doc_id", "text") + """
SELECT doc_id, compound FROM sent"""))
def i1_document_sentiment(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return with_compound(d, "text").select("doc_id", "compound")


_OWN_LEXICON = f"""SELECT word, ((length(word) * 7 + ascii(word)) % 9 - 4) / 2.0 AS val
    FROM (SELECT word, count(DISTINCT doc_id) AS n
          FROM (SELECT doc_id, unnest(list_transform({raw_tokens_sql("coalesce(text, '')")}, lambda w: lower(w))) AS word FROM documents)
          GROUP BY word HAVING n > 1) WHERE (length(word) * 7 + ascii(word)) % 9 <> 4"""


@register("i1_table_sentiment", sql(
    "d0 AS (SELECT doc_id, text FROM documents)",
    body=", " + sentiment_sql("SELECT doc_id, text FROM d0", "doc_id", "text", _OWN_LEXICON) + """
SELECT doc_id, compound FROM sent"""))
def i1_table_sentiment(spark, sf_dir):
    """Sentiment by a lexicon table: all words of two documents or more, with a value by their form."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    dealt = d.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    w = dealt.select("doc_id", F.explode(F.transform(raw_tokens("text"), lambda w: F.lower(w))).alias("word"))
    n = w.distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    lexicon = n.select("word", (((F.length("word") * 7 + F.ascii("word")) % 9 - 4) / F.lit(2.0)).alias("val")).where("val <> 0")
    return with_compound_table(d, "doc_id", "text", lexicon).select("doc_id", "compound")


@register("i2_sentiment_classes", sql(EV_CTES, TEXT_CTES, body=", " + _S_COMMENTS + """
SELECT CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END
         AS sentiment_class, count(*) AS n
FROM sent GROUP BY 1"""))
def i2_sentiment_classes(spark, sf_dir):
    s = _sent_comments(spark, sf_dir)
    return s.groupBy(sentiment_sign("compound").alias("sentiment_class")).agg(F.count(F.lit(1)).alias("n"))


@register("b17_negative_comments", sql(EV_CTES, TEXT_CTES, body=", " + _S_COMMENTS + """
SELECT c.comment_id, c.author, s.compound FROM comments c JOIN sent s ON s.comment_id = c.comment_id
WHERE s.compound <= -0.05"""))
def b17_negative_comments(spark, sf_dir):
    s = _sent_comments(spark, sf_dir)
    return s.filter(F.col("compound") <= -0.05).select("comment_id", "author", "compound")


@register("d9_comment_slot_sentiment", sql(EV_CTES, TEXT_CTES, body=", " + _S_COMMENTS + f"""
, x AS (SELECT date_trunc('day', c.created_utc) AS bucket, s.compound
        FROM comments c JOIN sent s ON s.comment_id = c.comment_id),
g AS (SELECT bucket, count(*) AS n, avg(compound) AS a FROM x GROUP BY 1),
sp AS (SELECT CAST(t AS TIMESTAMP) AS bucket FROM (SELECT min(bucket) lo, max(bucket) hi FROM g),
       generate_series(lo, hi, INTERVAL 1 DAY) u(t))
SELECT sp.bucket, CAST(coalesce(g.n, 0) AS BIGINT) AS n, {sql_r6('coalesce(g.a, 0.0)')} AS avg_sentiment
FROM sp LEFT JOIN g ON g.bucket = sp.bucket"""))
def d9_comment_slot_sentiment(spark, sf_dir):
    return TS.slot_sentiment(_sent_comments(spark, sf_dir), "created_utc", "1D")


def _slot_sql(label: str, spine: str) -> str:
    return sql(EV_CTES, TEXT_CTES, body=", " + _S_COMMENTS + f"""
, g AS (SELECT {label} AS bucket, count(*) AS n, avg(s.compound) AS a
        FROM comments c JOIN sent s ON s.comment_id = c.comment_id GROUP BY 1),
r AS (SELECT min(bucket) AS lo, max(bucket) AS hi FROM g),
sp AS ({spine})
SELECT sp.bucket, CAST(coalesce(g.n, 0) AS BIGINT) AS n, {sql_r6('coalesce(g.a, 0.0)')} AS avg_sentiment
FROM sp LEFT JOIN g ON g.bucket = sp.bucket""")


@register("d9_weekly_comment_sentiment", _slot_sql(
    "CAST(CAST(c.created_utc AS DATE) + CAST((7 - isodow(c.created_utc)) % 7 AS INTEGER) AS TIMESTAMP)",
    "SELECT CAST(g AS TIMESTAMP) AS bucket FROM r, generate_series(lo, hi, INTERVAL 7 DAY) t(g)"))
def d9_weekly_comment_sentiment(spark, sf_dir):
    return TS.slot_sentiment(_sent_comments(spark, sf_dir), "created_utc", "W")


@register("d9_monthly_comment_sentiment", _slot_sql(
    "CAST(last_day(CAST(c.created_utc AS DATE)) AS TIMESTAMP)",
    "SELECT CAST(last_day(CAST(lo AS DATE) + to_months(CAST(i AS INTEGER))) AS TIMESTAMP) AS bucket "
    "FROM r, range(0, (year(hi) - year(lo)) * 12 + month(hi) - month(lo) + 1) t(i)"))
def d9_monthly_comment_sentiment(spark, sf_dir):
    return TS.slot_sentiment(_sent_comments(spark, sf_dir), "created_utc", "M")


@register("e21_running_sentiment", sql(EV_CTES, TEXT_CTES, body=", " + _S_COMMENTS + f"""
SELECT c.comment_id, c.post_id, count(*) OVER w AS run_n, {sql_r6('avg(s.compound) OVER w')} AS run_mean
FROM comments c JOIN sent s ON s.comment_id = c.comment_id
WINDOW w AS (PARTITION BY c.post_id ORDER BY c.created_utc, c.comment_id ROWS UNBOUNDED PRECEDING)"""))
def e21_running_sentiment(spark, sf_dir):
    c = scored_comments(spark, sf_dir).select("comment_id", "post_id", "created_utc", "compound")
    return TS.chunked_running(c, "post_id", "created_utc", "compound", "comment_id").select(
        "comment_id", "post_id", "run_n", "run_mean")


@register("e22_daily_sentiment_shift", sql(EV_CTES, TEXT_CTES, body=", " + _S_COMMENTS + f"""
, d AS (SELECT date_trunc('day', c.created_utc) AS day, {sql_r6('avg(s.compound)')} AS avg_sentiment
        FROM comments c JOIN sent s ON s.comment_id = c.comment_id GROUP BY 1)
SELECT day, avg_sentiment, {sql_r6('avg_sentiment - lag(avg_sentiment) OVER (ORDER BY day)')} AS shift FROM d"""))
def e22_daily_sentiment_shift(spark, sf_dir):
    d = TS.daily_shift(_sent_comments(spark, sf_dir), "created_utc", "compound", "avg_sentiment")
    return d.select("day", "avg_sentiment", r6("shift").alias("shift"))


@register("d21_post_length", sql(EV_CTES, TEXT_CTES, body=f"""
SELECT subreddit, {sql_r6('avg(length(title))')} AS avg_post_length, count(*) AS n_posts
FROM posts_t GROUP BY subreddit"""))
def d21_post_length(spark, sf_dir):
    p = forum_with_text(spark, sf_dir).posts
    return p.groupBy("subreddit").agg(r6(F.avg(F.length("title"))).alias("avg_post_length"),
                                      F.count(F.lit(1)).alias("n_posts"))


@register("d9_post_slot_sentiment", sql(EV_CTES, TEXT_CTES, body=", " + _S_COMMENTS + f"""
, pb AS (SELECT post_id, date_trunc('day', created_utc) AS bucket FROM posts),
pc AS (SELECT bucket, count(*) AS post_count FROM pb GROUP BY 1),
sp AS (SELECT CAST(t AS TIMESTAMP) AS bucket FROM (SELECT min(bucket) lo, max(bucket) hi FROM pc),
       generate_series(lo, hi, INTERVAL 1 DAY) u(t)),
cs AS (SELECT pb.bucket, avg(s.compound) AS a FROM comments c JOIN sent s ON s.comment_id = c.comment_id
       JOIN pb ON pb.post_id = c.post_id GROUP BY 1)
SELECT sp.bucket, CAST(coalesce(pc.post_count, 0) AS BIGINT) AS post_count,
       {sql_r6('coalesce(cs.a, 0.0)')} AS avg_sentiment
FROM sp LEFT JOIN pc ON pc.bucket = sp.bucket LEFT JOIN cs ON cs.bucket = sp.bucket"""))
def d9_post_slot_sentiment(spark, sf_dir):
    f = forum_with_text(spark, sf_dir)
    c = with_compound(f.comments, "body")
    return TS.post_slot_sentiment(f.posts, c, "1D")


@register("d26_daily_title_sentiment", sql(EV_CTES, TEXT_CTES, body=", " + sentiment_sql(
    "SELECT post_id, title FROM posts_t", "post_id", "title") + f"""
, x AS (SELECT date_trunc('day', p.created_utc) AS bucket, s.compound FROM posts p JOIN sent s ON s.post_id = p.post_id),
g AS (SELECT bucket, count(*) AS n, avg(compound) AS a FROM x GROUP BY 1),
sp AS (SELECT CAST(t AS TIMESTAMP) AS bucket FROM (SELECT min(bucket) lo, max(bucket) hi FROM g),
       generate_series(lo, hi, INTERVAL 1 DAY) u(t))
SELECT sp.bucket, CAST(coalesce(g.n, 0) AS BIGINT) AS n, {sql_r6('coalesce(g.a, 0.0)')} AS avg_sentiment
FROM sp LEFT JOIN g ON g.bucket = sp.bucket"""))
def d26_daily_title_sentiment(spark, sf_dir):
    p = with_compound(forum_with_text(spark, sf_dir).posts, "title")
    return TS.slot_sentiment(p, "created_utc", "1D")


@register("d21_content_length", sql(EV_CTES, TEXT_CTES, body=f"""
SELECT p.subreddit, {sql_r6('avg(length(c.body))')} AS avg_comment_length, count(*) AS n_comments
FROM comments_t c JOIN posts p ON c.post_id = p.post_id GROUP BY p.subreddit"""))
def d21_content_length(spark, sf_dir):
    f = forum_with_text(spark, sf_dir)
    c = f.comments.join(f.posts.select("post_id", "subreddit"), "post_id")
    return c.groupBy("subreddit").agg(r6(F.avg(F.length("body"))).alias("avg_comment_length"),
                                      F.count(F.lit(1)).alias("n_comments"))


@register("d20_comments_per_post", sql(EV_CTES, body=f"""
, p AS (SELECT date_trunc('day', created_utc) AS day, count(*) AS np FROM posts GROUP BY 1),
c AS (SELECT date_trunc('day', created_utc) AS day, count(*) AS nc FROM comments GROUP BY 1)
SELECT coalesce(p.day, c.day) AS day, CAST(coalesce(np, 0) AS BIGINT) AS n_posts,
       CAST(coalesce(nc, 0) AS BIGINT) AS n_comments,
       {sql_r6('CAST(coalesce(nc, 0) AS DOUBLE) / CASE WHEN coalesce(np, 0) <> 0 THEN np END')} AS comments_per_post
FROM p FULL OUTER JOIN c ON p.day = c.day"""))
def d20_comments_per_post(spark, sf_dir):
    from threadlens.sources.roles import forum_from_events
    f = forum_from_events(spark, sf_dir)
    day = F.window("created_utc", "1 day").start.alias("day")
    p = f.posts.groupBy(day).agg(F.count(F.lit(1)).alias("n_posts"))
    c = f.comments.groupBy(day).agg(F.count(F.lit(1)).alias("n_comments"))
    j = p.join(c, "day", "full_outer").fillna(0, subset=["n_posts", "n_comments"])
    return j.withColumn("comments_per_post", r6(F.try_divide(F.col("n_comments").cast("double"),
                                                              F.col("n_posts"))))


@register("b10_post_content", sql(EV_CTES, TEXT_CTES, body="""
SELECT post_id, md5(coalesce(title, '') || ' ' || '') AS content_md5, length(coalesce(title, '') || ' ') AS content_length
FROM posts_t"""))
def b10_post_content(spark, sf_dir):
    p = forum_with_text(spark, sf_dir).posts
    c = content("title", "self_text")
    return p.select("post_id", F.md5(c).alias("content_md5"), F.length(c).alias("content_length"))


@register("i9_exact_repetition", sql(EV_CTES, TEXT_CTES, body="""
SELECT md5(trim(regexp_replace(lower(body), '\\s+', ' ', 'g'))) AS text_md5, count(DISTINCT author) AS n_users,
       count(*) AS n_posts
FROM comments_t WHERE body IS NOT NULL GROUP BY 1 HAVING count(DISTINCT author) >= 2"""))
def i9_exact_repetition(spark, sf_dir):
    return T.exact_repetition(forum_with_text(spark, sf_dir).comments, "body", "author", 2)


@register("e24_repeated_texts", sql(EV_CTES, TEXT_CTES, body=f"""
, x AS (SELECT author, md5(trim(regexp_replace(lower(body), '\\s+', ' ', 'g'))) AS d FROM comments_t WHERE body IS NOT NULL),
c AS (SELECT author, d, count(*) AS c FROM x GROUP BY 1, 2)
SELECT author, CAST(sum(c) AS BIGINT) AS n_texts, count(*) AS n_distinct,
       {sql_r6('coalesce(sum(c) FILTER (c > 1), 0) / sum(c)')} AS repeated_share FROM c GROUP BY author"""))
def e24_repeated_texts(spark, sf_dir):
    return T.repeated_text_share(forum_with_text(spark, sf_dir).comments, "body", "author")


@register("i7_keyword_repetition", sql(EV_CTES, TEXT_CTES, body=f"""
, t AS (SELECT author, unnest({_clean_sql('body')}) AS tok FROM comments_t)
SELECT author, count(*) AS n_tokens, count(DISTINCT tok) AS n_distinct,
       {sql_r6('1.0 - count(DISTINCT tok) / count(*)')} AS repetition
FROM t GROUP BY author"""))
def i7_keyword_repetition(spark, sf_dir):
    return T.keyword_repetition(forum_with_text(spark, sf_dir).comments, "body", "author")


@register("i7_repeated_ngrams", sql(EV_CTES, TEXT_CTES, body=f"""
, t AS (SELECT author, {_clean_sql('body')} AS toks FROM comments_t),
g AS (SELECT author, n, unnest(list_transform(range(1, len(toks) - n + 2), lambda i: array_to_string(toks[i:i + n - 1], ' '))) AS gram
      FROM t, range(1, 4) r(n)),
c AS (SELECT author, n, gram, count(*) AS c FROM g GROUP BY 1, 2, 3)
SELECT author, CAST(n AS INTEGER) AS n, CAST(sum(c) AS BIGINT) AS n_grams, count(*) AS n_distinct,
       arg_min(gram, (-c, gram)) AS top_gram, max(c) AS top_count,
       {sql_r6('coalesce(sum(c) FILTER (c > 1), 0) / sum(c)')} AS repeated_share
FROM c GROUP BY author, n"""))
def i7_repeated_ngrams(spark, sf_dir):
    return T.repeated_ngrams(forum_with_text(spark, sf_dir).comments, "body", "author", 3)


def _stop_words():
    return list(T.STOP_WORDS)


def _top_tokens_sql():
    sw = ", ".join("'" + w + "'" for w in _stop_words())
    return sql("d0 AS (SELECT lang, text FROM documents)", body=f"""
, t AS (SELECT lang, unnest(list_filter({_clean_sql('text')}, lambda x: x NOT IN ({sw}))) AS token FROM d0),
c AS (SELECT lang, token, count(*) AS n FROM t GROUP BY 1, 2)
SELECT lang, token, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS r FROM c)
WHERE r <= 25""")


@register("i10_top_tokens_by_language", _top_tokens_sql())
def i10_top_tokens_by_language(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return T.top_tokens(d, "text", "lang", 25, _stop_words())


@register("i4_topic_model")
def i4_topic_model(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return T.topic_model(d, "doc_id", "text", k=10, seed=42)


@register("i6_topic_share_by_day")
def i6_topic_share_by_day(spark, sf_dir):
    f = forum_with_text(spark, sf_dir)
    topics = T.topic_model(f.posts, "post_id", "title", k=10, seed=42)
    rows = topics.join(f.posts.select("post_id", F.window("created_utc", "1 day").start.alias("day")), "post_id")
    return T.topic_share_by_day(rows, "day")


_I8_SQL = sql("d0 AS (SELECT doc_id, text FROM documents)", body=f"""
, tk AS (SELECT doc_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS h,
                list_distinct({_clean_sql('text')}) AS toks FROM d0),
tk2 AS (SELECT * FROM tk WHERE len(toks) > 0),
rep AS (SELECT h, min(doc_id) AS rep FROM tk2 GROUP BY h),
copies AS (SELECT r.rep AS id_a, t.doc_id AS id_b, 1.0 AS jaccard, 'copy' AS kind
           FROM tk2 t JOIN rep r ON r.h = t.h WHERE t.doc_id <> r.rep),
uniq AS (SELECT t.doc_id, t.toks FROM tk2 t JOIN rep r ON r.rep = t.doc_id),
flat AS (SELECT doc_id, len(toks) AS n, unnest(toks) AS tok FROM uniq),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i, any_value(x.n) AS la, any_value(y.n) AS lb
          FROM flat x JOIN flat y ON x.tok = y.tok AND x.doc_id < y.doc_id GROUP BY 1, 2)
SELECT id_a, id_b, jaccard, kind FROM copies
UNION ALL
SELECT a, b, {sql_r6('i / (la + lb - i)')}, 'near' FROM pairs WHERE i / (la + lb - i) >= 0.8""")


@register("i8_near_duplicate_documents", _I8_SQL)
def i8_near_duplicate_documents(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return T.near_duplicates(d, "doc_id", "text", threshold=0.8)
