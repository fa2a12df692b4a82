"""Registered model and anomaly queries (K*, D24, D27–D29)."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.functions.numeric import r6, sql_r6
from threadlens.functions.sentiment import sentiment_sql, with_compound
from threadlens.operators import ml as M
from threadlens.operators import timeseries as TS
from threadlens.operators.engagement import percentile_features
from threadlens.plans.catalog import (EV_CTES, ORD_COMMUNITIES, ORD_CTES, ORD_END, ORD_START, TEXT_CTES,
                                      register, sql)
from threadlens.plans.q_engagement import DAILY_SQL, ev_daily
from threadlens.plans.q_graph import _DOM_SQL, dominant_community
from threadlens.plans.q_timeseries import _SERIES_SQL, ord_series
from threadlens.sources.roles import forum_from_events, forum_from_orders, forum_with_text, read_table


def _emb(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    return M.vectors(e, "embedding")


@register("k2_standardize", sql(EV_CTES, body=DAILY_SQL + f"""
, st AS (SELECT avg(total_posts) mp, stddev_pop(total_posts) sp, avg(total_comments) mc,
                stddev_pop(total_comments) sc FROM daily)
SELECT day, {sql_r6('(total_posts - mp) / CASE WHEN sp > 0 THEN sp ELSE 1 END')} AS total_posts,
       {sql_r6('(total_comments - mc) / CASE WHEN sc > 0 THEN sc ELSE 1 END')} AS total_comments
FROM daily, st"""))
def k2_standardize(spark, sf_dir):
    d = ev_daily(spark, sf_dir).select("day", "total_posts", "total_comments")
    z = M.standardize(d, ["total_posts", "total_comments"])
    return z.select("day", r6("total_posts").alias("total_posts"), r6("total_comments").alias("total_comments"))


def _clusters(spark, sf_dir):
    feats = percentile_features(forum_from_orders(spark, sf_dir), ORD_START, ORD_END, ORD_COMMUNITIES)
    return M.cluster_posts(feats, "post_id", k=5, dims=10, seed=42)


@register("k5_post_clustering")
def k5_post_clustering(spark, sf_dir):
    res, _m = _clusters(spark, sf_dir)
    return res.select("post_id", "score", "cluster")


@register("k17_silhouette")
def k17_silhouette(spark, sf_dir):
    res, _m = _clusters(spark, sf_dir)
    return spark.createDataFrame([(float(M.silhouette(res)),)], "silhouette double")


@register("k23_incremental_assignment")
def k23_incremental_assignment(spark, sf_dir):
    """Fit on the posts, save the pipeline with its scaler, and assign all posts
    by the loaded model."""
    from pyspark.ml import PipelineModel

    from threadlens.session import scratch_path
    feats = percentile_features(forum_from_orders(spark, sf_dir), ORD_START, ORD_END, ORD_COMMUNITIES)
    path = scratch_path(spark, "cluster-model")
    M.cluster_posts(feats, "post_id")[1].save(path)
    return M.assign_clusters(feats, PipelineModel.load(path))


@register("k12_pca_embeddings")
def k12_pca_embeddings(spark, sf_dir):
    m = M.pca_model(_emb(spark, sf_dir), "features", 10)
    ev = m.explainedVariance.toArray()
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(ev)], "component int, explained_variance double")


@register("k8_reconstruction_error")
def k8_reconstruction_error(spark, sf_dir):
    return M.reconstruction_error(_emb(spark, sf_dir), "features", 10).select("vec_id", "recon_error", "is_anomaly")


def _emb_cols(spark, sf_dir, d=64):
    e = read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(d)])


@register("k6_isolation_forest")
def k6_isolation_forest(spark, sf_dir):
    x = _emb_cols(spark, sf_dir)
    return M.isolation_forest(x, "vec_id", [f"f{i}" for i in range(64)], n_trees=50, sample=128)


@register("k7_isolation_forest_per_group")
def k7_isolation_forest_per_group(spark, sf_dir):
    x = _emb_cols(spark, sf_dir)
    return M.isolation_forest(x, "vec_id", [f"f{i}" for i in range(64)], n_trees=30, sample=16, group="label")


@register("k9_seasonal_residuals")
def k9_seasonal_residuals(spark, sf_dir):
    s = ord_series(spark, sf_dir).groupBy("day").agg(F.sum("n").alias("n"))
    return M.seasonal_residual_anomalies(s, "day", "n", 2.0)


@register("k11_correlation_matrix", sql(EV_CTES, body=DAILY_SQL + f"""
SELECT 'total_posts' AS a, 'total_comments' AS b, {sql_r6('corr(total_posts, total_comments)')} AS corr FROM daily
UNION ALL SELECT 'total_posts', 'active_users', {sql_r6('corr(total_posts, active_users)')} FROM daily
UNION ALL SELECT 'total_comments', 'active_users', {sql_r6('corr(total_comments, active_users)')} FROM daily"""))
def k11_correlation_matrix(spark, sf_dir):
    return M.correlation_long(ev_daily(spark, sf_dir), ["total_posts", "total_comments", "active_users"])


_RANKS = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}"
                   for c in ("total_posts", "total_comments", "active_users"))


@register("k11_spearman_matrix", sql(EV_CTES, body=DAILY_SQL + f"""
, rk AS (SELECT {_RANKS} FROM daily)
SELECT 'total_posts' AS a, 'total_comments' AS b, {sql_r6('corr(total_posts, total_comments)')} AS corr FROM rk
UNION ALL SELECT 'total_posts', 'active_users', {sql_r6('corr(total_posts, active_users)')} FROM rk
UNION ALL SELECT 'total_comments', 'active_users', {sql_r6('corr(total_comments, active_users)')} FROM rk"""))
def k11_spearman_matrix(spark, sf_dir):
    return M.correlation_long(ev_daily(spark, sf_dir), ["total_posts", "total_comments", "active_users"], "spearman")


@register("k13_feature_importance")
def k13_feature_importance(spark, sf_dir):
    return M.feature_importance(_emb(spark, sf_dir), "features", "label", "rf", n_trees=30)


@register("k15_gbt_importance")
def k15_gbt_importance(spark, sf_dir):
    e = _emb(spark, sf_dir).withColumn("bin", (F.col("label") < 5).cast("double"))
    return M.feature_importance(e, "features", "bin", "gbt")


@register("k14_cross_validated_elimination")
def k14_cross_validated_elimination(spark, sf_dir):
    return M.elimination_by_score(_emb(spark, sf_dir), "features", "label", "vec_id", least=16, n_trees=10)


@register("k14_recursive_elimination")
def k14_recursive_elimination(spark, sf_dir):
    kept = M.recursive_elimination(_emb(spark, sf_dir), "features", "label", keep=20)
    return spark.createDataFrame([(i,) for i in kept], "feature int")


@register("k16_ensemble_vote", sql(ORD_CTES, body=_SERIES_SQL + """
, st AS (SELECT subreddit, avg(n) AS mu, stddev_samp(n) AS sd FROM series GROUP BY 1),
z AS (SELECT s.subreddit, s.day, CAST(coalesce(abs(s.n - st.mu) / CASE WHEN st.sd <> 0 THEN st.sd END > 2.0, false)
             AS INTEGER) AS z_flag FROM series s JOIN st ON st.subreddit = s.subreddit),
b AS (SELECT subreddit, day,
             CASE WHEN count(n) OVER w = 7 AND n > avg(n) OVER w + 2.0 * stddev_samp(n) OVER w THEN 1 ELSE 0 END
               AS burst_flag
      FROM series WINDOW w AS (PARTITION BY subreddit ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
SELECT z.subreddit, z.day, z.z_flag + b.burst_flag AS votes
FROM z JOIN b ON b.subreddit = z.subreddit AND b.day = z.day WHERE z.z_flag + b.burst_flag >= 1"""))
def k16_ensemble_vote(spark, sf_dir):
    s = ord_series(spark, sf_dir)
    z = TS.zscore_flags(s, "n", 2.0, ["subreddit"]).select("subreddit", "day", F.col("is_anomaly").alias("z_flag"))
    b = TS.burst_flags(s, "day", "n", 2.0, 7, ["subreddit"]).select("subreddit", "day",
                                                                     F.col("is_burst").alias("burst_flag"))
    v = z.join(b, ["subreddit", "day"]).withColumn("votes", F.col("z_flag") + F.col("burst_flag"))
    return v.filter(F.col("votes") >= 1).select("subreddit", "day", "votes")


@register("k16_five_detector_vote")
def k16_five_detector_vote(spark, sf_dir):
    """E14, K6, K8, K9 and K10 vote on the days of one table: the comments of each
    community and of all."""
    per = [f"n{i}" for i in range(len(ORD_COMMUNITIES))]
    s = ord_series(spark, sf_dir).groupBy("day").agg(
        F.sum("n").alias("n"),
        *[F.sum(F.when(F.col("subreddit") == c, F.col("n")).otherwise(0)).cast("double").alias(a)
          for a, c in zip(per, ORD_COMMUNITIES)])
    return M.ensemble_vote(M.detector_flags(s, "day", "n", per), ["day"])


_DOC_SENT = sentiment_sql("SELECT doc_id, text FROM documents", "doc_id", "text")


@register("k18_precision_recall", sql("d0 AS (SELECT 1)", body=", " + _DOC_SENT + f"""
, j AS (SELECT l.toxic, CASE WHEN s.compound <= -0.05 THEN 1 ELSE 0 END AS pred
        FROM labels l JOIN sent s ON s.doc_id = l.doc_id),
c AS (SELECT sum(CASE WHEN pred = 1 AND toxic = 1 THEN 1 ELSE 0 END) tp,
             sum(CASE WHEN pred = 1 AND toxic = 0 THEN 1 ELSE 0 END) fp,
             sum(CASE WHEN pred = 0 AND toxic = 1 THEN 1 ELSE 0 END) fn FROM j)
SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
       {sql_r6('CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END')} AS precision,
       {sql_r6('CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END')} AS recall,
       {sql_r6('CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END')} AS f1
FROM c"""))
def k18_precision_recall(spark, sf_dir):
    d = with_compound(read_table(spark, sf_dir, "documents"), "text").select("doc_id", "compound")
    j = read_table(spark, sf_dir, "labels").join(d, "doc_id").withColumn(
        "pred", (F.col("compound") <= -0.05).cast("int"))
    c = j.agg(F.sum(((F.col("pred") == 1) & (F.col("toxic") == 1)).cast("int")).cast("bigint").alias("tp"),
              F.sum(((F.col("pred") == 1) & (F.col("toxic") == 0)).cast("int")).cast("bigint").alias("fp"),
              F.sum(((F.col("pred") == 0) & (F.col("toxic") == 1)).cast("int")).cast("bigint").alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("tp", "fp", "fn", r6(F.when(tp + fp > 0, tp / (tp + fp))).alias("precision"),
                    r6(F.when(tp + fn > 0, tp / (tp + fn))).alias("recall"),
                    r6(F.when(2 * tp + fp + fn > 0, 2.0 * tp / (2 * tp + fp + fn))).alias("f1"))


@register("k19_feedback_merge", sql("d0 AS (SELECT 1)", body=", " + _DOC_SENT + """
SELECT s.doc_id, CASE WHEN s.compound <= -0.05 THEN 1 ELSE 0 END AS flagged, l.toxic AS feedback,
       coalesce(l.toxic, CASE WHEN s.compound <= -0.05 THEN 1 ELSE 0 END) AS corrected
FROM sent s LEFT JOIN labels l ON l.doc_id = s.doc_id"""))
def k19_feedback_merge(spark, sf_dir):
    d = with_compound(read_table(spark, sf_dir, "documents"), "text").select("doc_id", "compound")
    fb = read_table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("feedback"))
    x = d.withColumn("flagged", (F.col("compound") <= -0.05).cast("int")).join(fb, "doc_id", "left")
    return x.select("doc_id", "flagged", "feedback", F.coalesce("feedback", "flagged").alias("corrected"))


_FEEDBACK = """
flags AS (SELECT event_id, user_id, ts, CAST(value > 100 AS INTEGER) AS flagged FROM events WHERE event_type = 'click'),
fb AS (SELECT user_id, ts, arg_max(CAST(value > 50 AS INTEGER), event_id) AS feedback FROM events
       WHERE event_type = 'purchase' GROUP BY user_id, ts)"""


def _feedback(spark, sf_dir):
    """Flags on users (clicks) and later feedback on them (purchases), both with their times."""
    e = read_table(spark, sf_dir, "events")
    flags = e.filter("event_type = 'click'").select("event_id", "user_id", "ts", (F.col("value") > 100).cast("int").alias("flagged"))
    fb = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts", (F.col("value") > 50).cast("int").alias("feedback"))
    return flags, fb


@register("k19_feedback_as_of", f"""
WITH {_FEEDBACK}
SELECT f.event_id, f.user_id, f.ts, f.flagged, b.feedback, coalesce(b.feedback, f.flagged) AS corrected
FROM flags f ASOF LEFT JOIN fb b ON f.user_id = b.user_id AND f.ts >= b.ts""")
def k19_feedback_as_of(spark, sf_dir):
    """Every flag with the latest feedback known at its time."""
    from threadlens.operators.asof import latest_before
    flags, fb = _feedback(spark, sf_dir)
    x = latest_before(flags, fb, "user_id", "ts", ["feedback"], "event_id")
    return x.withColumn("corrected", F.coalesce("feedback", "flagged"))


@register("k19_retraining_set", f"""
WITH {_FEEDBACK},
l AS (SELECT user_id, arg_max(feedback, ts) AS label, max(ts) AS labelled_at FROM fb GROUP BY user_id)
SELECT f.user_id, l.label, l.labelled_at, count(*) AS n_flags, CAST(sum(f.flagged) AS BIGINT) AS n_flagged,
       CAST(sum(CASE WHEN f.flagged <> l.label THEN 1 ELSE 0 END) AS BIGINT) AS n_wrong
FROM flags f JOIN l ON f.user_id = l.user_id GROUP BY 1, 2, 3""")
def k19_retraining_set(spark, sf_dir):
    """Users with feedback: their latest label and how the flags on them agree with it."""
    flags, fb = _feedback(spark, sf_dir)
    last = fb.groupBy("user_id").agg(F.max_by("feedback", F.struct("ts", "event_id")).alias("label"), F.max("ts").alias("labelled_at"))
    return flags.join(last, "user_id").groupBy("user_id", "label", "labelled_at").agg(
        F.count(F.lit(1)).alias("n_flags"), F.sum("flagged").alias("n_flagged"),
        F.sum((F.col("flagged") != F.col("label")).cast("int")).alias("n_wrong"))


@register("k20_daily_feature_table", sql(EV_CTES, body=DAILY_SQL + f"""
, f AS (SELECT *,
        CASE WHEN count(total_posts) OVER w = 7 THEN {sql_r6('avg(total_posts) OVER w')} END AS ma_7_total_posts,
        CASE WHEN count(total_posts) OVER w = 7 THEN {sql_r6('stddev_samp(total_posts) OVER w')} END AS std_7_total_posts,
        CASE WHEN count(total_comments) OVER w = 7 THEN {sql_r6('avg(total_comments) OVER w')} END
          AS ma_7_total_comments,
        CASE WHEN count(total_comments) OVER w = 7 THEN {sql_r6('stddev_samp(total_comments) OVER w')} END
          AS std_7_total_comments
        FROM daily WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
st AS (SELECT avg(total_comments) mu, stddev_samp(total_comments) sd FROM daily)
SELECT f.*, {sql_r6('abs(total_comments - mu) / CASE WHEN sd <> 0 THEN sd END')} AS z_total_comments,
       CAST(coalesce(abs(total_comments - mu) / CASE WHEN sd <> 0 THEN sd END > 2.0, false) AS INTEGER) AS is_anomaly
FROM f, st"""))
def k20_daily_feature_table(spark, sf_dir):
    d = TS.rolling(ev_daily(spark, sf_dir), "day", ["total_posts", "total_comments"], 7)
    return TS.zscore_flags(d, "total_comments", 2.0)


@register("d24_cluster_engagement", sql(EV_CTES, body=_DOM_SQL + """
, p AS (SELECT date_trunc('day', created_utc) AS day, d.cluster, count(*) AS posts, sum(score) AS post_score
        FROM posts JOIN dom d ON d.username = posts.author GROUP BY 1, 2),
c AS (SELECT date_trunc('day', created_utc) AS day, d.cluster, count(*) AS comments, sum(score) AS comment_score
      FROM comments JOIN dom d ON d.username = comments.author GROUP BY 1, 2)
SELECT coalesce(p.day, c.day) AS day, coalesce(p.cluster, c.cluster) AS cluster,
       CAST(coalesce(posts, 0) AS BIGINT) AS posts, coalesce(post_score, 0.0) AS post_score,
       CAST(coalesce(comments, 0) AS BIGINT) AS comments, coalesce(comment_score, 0.0) AS comment_score
FROM p FULL OUTER JOIN c ON p.day = c.day AND p.cluster = c.cluster"""))
def d24_cluster_engagement(spark, sf_dir):
    f = forum_from_events(spark, sf_dir)
    dom = dominant_community(spark, sf_dir).withColumnRenamed("username", "author")
    day = F.window("created_utc", "1 day").start.alias("day")
    p = f.posts.join(dom, "author").groupBy(day, "cluster").agg(F.count(F.lit(1)).alias("posts"),
                                                                F.sum("score").alias("post_score"))
    c = f.comments.join(dom, "author").groupBy(day, "cluster").agg(F.count(F.lit(1)).alias("comments"),
                                                                   F.sum("score").alias("comment_score"))
    return (p.join(c, ["day", "cluster"], "full_outer")
            .fillna(0, subset=["posts", "comments"]).fillna(0.0, subset=["post_score", "comment_score"]))


@register("k21_cluster_attributes", sql(EV_CTES, body=_DOM_SQL + f"""
, a AS (SELECT d.cluster, count(DISTINCT d.username) AS cluster_size, avg(c.score) AS cluster_avg_score
        FROM dom d JOIN comments c ON c.author = d.username GROUP BY d.cluster)
SELECT c.comment_id, d.cluster, a.cluster_size, {sql_r6('a.cluster_avg_score')} AS cluster_avg_score
FROM comments c JOIN dom d ON d.username = c.author JOIN a ON a.cluster = d.cluster"""))
def k21_cluster_attributes(spark, sf_dir):
    c = forum_from_events(spark, sf_dir).comments
    dom = dominant_community(spark, sf_dir).withColumnRenamed("username", "author")
    x = c.join(dom, "author")
    a = x.groupBy("cluster").agg(F.countDistinct("author").alias("cluster_size"),
                                 r6(F.avg("score")).alias("cluster_avg_score"))
    return x.join(a, "cluster").select("comment_id", "cluster", "cluster_size", "cluster_avg_score")


@register("k22_cluster_anomalies", sql(EV_CTES, body=_DOM_SQL + f"""
, s AS (SELECT d.cluster, date_trunc('day', c.created_utc) AS day, count(*) AS n
        FROM comments c JOIN dom d ON d.username = c.author GROUP BY 1, 2),
st AS (SELECT cluster, avg(n) mu, stddev_samp(n) sd FROM s GROUP BY 1)
SELECT s.cluster, s.day, s.n, {sql_r6('abs(s.n - st.mu) / CASE WHEN st.sd <> 0 THEN st.sd END')} AS z_n,
       CAST(coalesce(abs(s.n - st.mu) / CASE WHEN st.sd <> 0 THEN st.sd END > 2.0, false) AS INTEGER) AS is_anomaly
FROM s JOIN st ON st.cluster = s.cluster"""))
def k22_cluster_anomalies(spark, sf_dir):
    c = forum_from_events(spark, sf_dir).comments
    dom = dominant_community(spark, sf_dir).withColumnRenamed("username", "author")
    s = (c.join(dom, "author").groupBy("cluster", F.window("created_utc", "1 day").start.alias("day"))
         .agg(F.count(F.lit(1)).alias("n")))
    return TS.zscore_flags(s, "n", 2.0, ["cluster"])


_S_COMMENTS = sentiment_sql("SELECT comment_id, body FROM comments_t", "comment_id", "body")


@register("d27_engager_profile", sql(EV_CTES, TEXT_CTES, body=", " + _S_COMMENTS + f"""
, x AS (SELECT c.author, s.compound, date_diff('microsecond', p.created_utc, c.created_utc) / 1e6 AS rt
        FROM comments c JOIN sent s ON s.comment_id = c.comment_id JOIN posts p ON p.post_id = c.post_id)
SELECT author, count(*) AS engagements, {sql_r6('avg(compound)')} AS avg_sentiment,
       {sql_r6('avg(rt)')} AS avg_response_seconds
FROM x GROUP BY author"""))
def d27_engager_profile(spark, sf_dir):
    from threadlens.operators.engagement import elapsed_seconds
    f = forum_with_text(spark, sf_dir)
    c = with_compound(f.comments, "body").join(f.posts.select("post_id", F.col("created_utc").alias("pt")), "post_id")
    c = c.withColumn("rt", elapsed_seconds("created_utc", "pt"))
    return c.groupBy("author").agg(F.count(F.lit(1)).alias("engagements"), r6(F.avg("compound")).alias("avg_sentiment"),
                                   r6(F.avg("rt")).alias("avg_response_seconds"))


@register("d28_user_sentiment_distribution", sql(EV_CTES, TEXT_CTES, body=", " + _S_COMMENTS + f"""
SELECT c.author, {sql_r6('avg(CASE WHEN abs(s.compound) >= 0.5 THEN 1.0 ELSE 0.0 END)')} AS extreme_share,
       {sql_r6('quantile_cont(s.compound, 0.5)')} AS median_sentiment
FROM comments c JOIN sent s ON s.comment_id = c.comment_id GROUP BY c.author"""))
def d28_user_sentiment_distribution(spark, sf_dir):
    from threadlens.operators.quantiles import exact_quantiles
    from threadlens.plans.q_text import scored_comments
    c = scored_comments(spark, sf_dir)
    a = c.groupBy("author").agg(r6(F.avg(F.when(F.abs("compound") >= 0.5, 1.0).otherwise(0.0))).alias("extreme_share"))
    q = exact_quantiles(c, ["author"], "compound", [0.5], ["median_sentiment"])
    return a.join(q.select("author", r6("median_sentiment").alias("median_sentiment")), "author")


@register("k10_knn_distance", f"""
WITH d AS (SELECT a.vec_id, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding),
                  lambda p: pow(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2)))) AS d
           FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS rn FROM d)
SELECT vec_id, {sql_r6('d')} AS knn5_distance FROM r WHERE rn = 5""")
def k10_knn_distance(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    return M.knn_distance(e, "vec_id", "embedding", k=5, block=256)


@register("k10_author_outliers", sql(ORD_CTES, body=f"""
, f AS (SELECT author, [CAST(count(*) AS DOUBLE), ln(1 + avg(score)), ln(1 + max(score))] AS v FROM posts GROUP BY author),
d AS (SELECT a.author, sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda p: pow(p[1] - p[2], 2)))) AS d
      FROM f a JOIN f b ON a.author <> b.author),
r AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY d) AS rn FROM d),
k AS (SELECT author, d FROM r WHERE rn = 5)
SELECT author, {sql_r6('d')} AS knn5_distance,
       CAST(d > (SELECT quantile_cont(d, 0.95) FROM k) AS INTEGER) AS is_anomaly FROM k"""))
def k10_author_outliers(spark, sf_dir):
    """k-NN outliers among authors by few features, where the metric index leaves most pairs out."""
    from threadlens.operators.knn import nearest
    from threadlens.operators.quantiles import exact_quantiles
    from threadlens.session import written
    p = forum_from_orders(spark, sf_dir).posts
    f = p.groupBy("author").agg(F.array(
        F.count(F.lit(1)).cast("double"), F.log(1 + F.avg("score")), F.log(1 + F.max("score"))).alias("v"))
    d = written(nearest(f, "author", "v", k=5, block=64, pivots=64).select("author", F.get("distances", 4).alias("d")), "author-knn")
    cut = exact_quantiles(d, [], "d", [0.95], ["cut"]).select("cut").first()["cut"]
    return d.select("author", r6("d").alias("knn5_distance"), (F.col("d") > F.lit(cut)).cast("int").alias("is_anomaly"))
