"""Registered graph queries (J*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.operators import graph as G
from threadlens.plans.catalog import (EV_COMMUNITIES, EV_CTES, EV_END, EV_START, register, sql)
from threadlens.sources.roles import forum_from_events

# On events, k has 100 values at every sf, so threads get denser with sf:
# 30 shared threads keeps a real threshold (see FIXTURES.md).
EV_MIN_SHARED = 20



def _pairs_sql(keep: str = "true") -> str:
    """CTE ``pairs``: the users of a thread as a list, each unnested against the
    later names of the same list, and the threads of every pair counted."""
    return f"""
, crowd AS (
    SELECT post_id, list_distinct(list(author)) AS people
    FROM (SELECT post_id, author, created_utc FROM posts UNION ALL SELECT post_id, author, created_utc FROM comments)
    WHERE created_utc BETWEEN TIMESTAMP '{EV_START}' AND TIMESTAMP '{EV_END}'
      AND post_id IN (SELECT post_id FROM posts) AND author IS NOT NULL AND {keep}
    GROUP BY post_id),
each AS (SELECT people, unnest(people) AS user1 FROM crowd),
meets AS (SELECT user1, unnest(list_filter(people, lambda x: x > user1)) AS user2 FROM each),
pairs AS (SELECT user1, user2, count(*) AS shared_interactions FROM meets GROUP BY ALL
          HAVING count(*) >= {EV_MIN_SHARED})"""


@register("j1_user_pairs", sql(EV_CTES, body=_pairs_sql() + "\nSELECT * FROM pairs"))
def j1_user_pairs(spark, sf_dir):
    f = forum_from_events(spark, sf_dir)
    return G.find_user_pairs(f, EV_START, EV_END, None, EV_MIN_SHARED)

from threadlens.functions.numeric import r6, sql_r6  # noqa: E402
from threadlens.functions.predicates import pair_authors_ok  # noqa: E402
from threadlens.operators import louvain as L  # noqa: E402
from threadlens.operators.engagement import top_per_group  # noqa: E402
from threadlens.plans.catalog import FLAG_CTES, REPLY_CTES  # noqa: E402
from threadlens.sources.lists import DATA_DIR, flagged_users  # noqa: E402
from threadlens.sources.roles import flagged_interactions, replies  # noqa: E402

_PAIRS_BODY = _pairs_sql("author <> 'None' AND author NOT ILIKE '%moderator%' AND author <> 'autotldr'")


def _clean_pairs(spark, sf_dir):
    f = forum_from_events(spark, sf_dir)
    p = G.find_user_pairs(f, EV_START, EV_END, None, EV_MIN_SHARED, clean_authors=True)
    return p.filter(pair_authors_ok("user1", "user2"))


@register("j2_user_pairs_clean", sql(EV_CTES, body=_PAIRS_BODY + "\nSELECT * FROM pairs"))
def j2_user_pairs_clean(spark, sf_dir):
    return _clean_pairs(spark, sf_dir)


_TOT_BODY = f"""
, acts AS (SELECT author, score, created_utc, post_id FROM posts
           UNION ALL SELECT author, score, created_utc, post_id FROM comments),
nodes AS (SELECT author AS username, sum(score) AS user_score FROM acts
          WHERE created_utc BETWEEN TIMESTAMP '{EV_START}' AND TIMESTAMP '{EV_END}'
            AND post_id IN (SELECT post_id FROM posts)
          GROUP BY author HAVING sum(score) >= {{min_score}})"""

MIN_SCORE = 2000.0


def _weighted(spark, sf_dir):
    f = forum_from_events(spark, sf_dir)
    pairs = G.find_user_pairs(f, EV_START, EV_END, None, EV_MIN_SHARED)
    totals = G.user_totals(f, EV_START, EV_END, None)
    return G.weighted_graph(pairs, totals, MIN_SCORE)


@register("j3_graph_nodes", sql(EV_CTES, body=_TOT_BODY.format(min_score=MIN_SCORE) + "\nSELECT * FROM nodes"))
def j3_graph_nodes(spark, sf_dir):
    return _weighted(spark, sf_dir)[0]


_J3E = sql(EV_CTES, body=_pairs_sql() + _TOT_BODY.format(min_score=MIN_SCORE) + """
, edges AS (SELECT user1, user2, shared_interactions AS weight FROM pairs
            WHERE user1 IN (SELECT username FROM nodes) AND user2 IN (SELECT username FROM nodes))""")


@register("j3_graph_edges", _J3E + "\nSELECT * FROM edges")
def j3_graph_edges(spark, sf_dir):
    return _weighted(spark, sf_dir)[1]


@register("j4_edge_scaling", _J3E + f"""
, mm AS (SELECT min(weight) AS lo, max(weight) AS hi FROM edges)
SELECT user1, user2, weight,
       {sql_r6('(weight - lo) / CAST(CASE WHEN hi = lo THEN 1 ELSE hi - lo END AS DOUBLE)')} AS scaled_weight
FROM edges, mm""")
def j4_edge_scaling(spark, sf_dir):
    e = G.scale_edges(_weighted(spark, sf_dir)[1])
    return e.withColumn("scaled_weight", r6("scaled_weight"))


@register("j5_node_scaling", sql(EV_CTES, body=_TOT_BODY.format(min_score=MIN_SCORE) + f"""
, mm AS (SELECT min(user_score) AS lo, max(user_score) AS hi FROM nodes)
SELECT username, user_score,
       {sql_r6('(user_score - lo) / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END')} AS scaled_score,
       {sql_r6('CASE WHEN hi > 0 THEN 10.0 + user_score / hi * 40.0 ELSE 10.0 END')} AS node_size
FROM nodes, mm"""))
def j5_node_scaling(spark, sf_dir):
    n = G.scale_nodes(_weighted(spark, sf_dir)[0])
    return n.withColumn("scaled_score", r6("scaled_score")).withColumn("node_size", r6("node_size"))


# ---------------------------------------------------------------- J6 flagged
_DEDUP = """
, dedup AS (SELECT * FROM flagged WHERE id IN (
    SELECT min(id) FROM flagged GROUP BY username, subreddit, post_id, created_utc, interaction_type))"""


def _flag_dedup(spark, sf_dir):
    from threadlens.operators.engagement import keep_first
    cols = ["id", "username", "interaction_type", "subreddit", "post_id", "parent_id", "created_utc", "score"]
    return keep_first(flagged_interactions(spark, sf_dir).select(*cols))


@register("j6_flagged_network_edges", sql(EV_CTES, FLAG_CTES, body=_DEDUP + """
SELECT DISTINCT username, post_id FROM dedup WHERE interaction_type = 'comment'"""))
def j6_flagged_network_edges(spark, sf_dir):
    return G.bipartite_edges(_flag_dedup(spark, sf_dir))


@register("j6_flagged_network_nodes", sql(EV_CTES, FLAG_CTES, body=_DEDUP + """
, e AS (SELECT DISTINCT username, post_id FROM dedup WHERE interaction_type = 'comment'),
pl AS (SELECT post_id, arg_min(username, id) AS author FROM dedup WHERE interaction_type = 'post' GROUP BY post_id),
cl AS (SELECT post_id, arg_min(username, id) AS first_commenter FROM dedup WHERE interaction_type = 'comment'
       GROUP BY post_id)
SELECT username AS node, 'user' AS node_type, username AS label FROM (SELECT DISTINCT username FROM e)
UNION ALL
SELECT CAST(p.post_id AS VARCHAR), 'post', coalesce(pl.author, cl.first_commenter)
FROM (SELECT DISTINCT post_id FROM e) p LEFT JOIN pl ON pl.post_id = p.post_id LEFT JOIN cl ON cl.post_id = p.post_id"""))
def j6_flagged_network_nodes(spark, sf_dir):
    return G.bipartite_nodes(_flag_dedup(spark, sf_dir))


# ------------------------------------------------------------ J7–J10 Louvain
_LOUVAIN_MEMO: dict = {}


def _louvain_parts(spark, sf_dir):
    """Edges and Louvain membership (written tables), shared by the J7–J10 and J23 queries of one
    session as long as the edges are the same: they are made anew and compared by their count and
    the sum of their hashes."""
    from threadlens.session import written
    e = written(_clean_pairs(spark, sf_dir).withColumnRenamed("shared_interactions", "weight"), "pairs")
    state = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("user1", "user2", "weight").cast("decimal(38,0)"))).first())
    key = (spark.sparkContext.applicationId, state)
    if key not in _LOUVAIN_MEMO:
        _LOUVAIN_MEMO[key] = written(L.louvain(e, "user1", "user2", "weight"), "communities")
    return e, _LOUVAIN_MEMO[key]


@register("j7_louvain_communities")
def j7_louvain_communities(spark, sf_dir):
    return _louvain_parts(spark, sf_dir)[1]


@register("j8_network_node_table")
def j8_network_node_table(spark, sf_dir):
    e, m = _louvain_parts(spark, sf_dir)
    return m.select(F.col("node").alias("username"), "community")


@register("j9_community_summary")
def j9_community_summary(spark, sf_dir):
    _e, m = _louvain_parts(spark, sf_dir)
    return m.groupBy("community").agg(F.count(F.lit(1)).alias("n_users"))


@register("j23_sub_communities")
def j23_sub_communities(spark, sf_dir):
    """The refined communities inside each cluster of users with one dominant community."""
    from threadlens.session import written
    e = written(_clean_pairs(spark, sf_dir).withColumnRenamed("shared_interactions", "weight"), "pairs")
    m = dominant_community(spark, sf_dir).select(F.col("username").alias("node"), F.col("cluster").alias("community"))
    return L.sub_communities(e, written(m, "clusters"))


@register("j10_louvain_modularity")
def j10_louvain_modularity(spark, sf_dir):
    e, m = _louvain_parts(spark, sf_dir)
    return L.modularity(e, m, "user1", "user2", "weight").withColumn("modularity", r6("modularity"))


# dominant community of each user (most comments, ties by name) — a deterministic,
# SQL-expressible partition used by the cluster queries below
_DOM_SQL = """
, dom AS (SELECT author AS username, arg_max(src_type, n * 1000000 - rk) AS cluster FROM (
            SELECT author, src_type, count(*) AS n,
                   dense_rank() OVER (ORDER BY src_type) AS rk FROM comments GROUP BY author, src_type)
          GROUP BY author)"""


def dominant_community(spark, sf_dir):
    c = forum_from_events(spark, sf_dir).comments
    n = c.groupBy("author", "src_type").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(F.col("author").alias("username")).agg(
        F.min_by("src_type", F.struct(-F.col("n"), F.col("src_type"))).alias("cluster"))


@register("j8_edge_table", sql(EV_CTES, body=_PAIRS_BODY + _DOM_SQL + """
SELECT p.user1, p.user2, p.shared_interactions AS weight, a.cluster AS community1, b.cluster AS community2
FROM pairs p LEFT JOIN dom a ON a.username = p.user1 LEFT JOIN dom b ON b.username = p.user2"""))
def j8_edge_table(spark, sf_dir):
    e = _clean_pairs(spark, sf_dir).withColumnRenamed("shared_interactions", "weight")
    return G.edge_table(e, dominant_community(spark, sf_dir), "cluster")


@register("j9_community_table", sql(EV_CTES, body=_PAIRS_BODY + _DOM_SQL + f"""
, ends AS (SELECT user1 AS username, shared_interactions AS w FROM pairs
           UNION ALL SELECT user2, shared_interactions FROM pairs),
k AS (SELECT username, sum(w) AS k FROM ends GROUP BY 1),
inner_w AS (SELECT a.cluster, sum(p.shared_interactions) AS w FROM pairs p JOIN dom a ON a.username = p.user1
            JOIN dom b ON b.username = p.user2 WHERE a.cluster = b.cluster GROUP BY 1)
SELECT d.cluster AS community, count(*) AS n_users, CAST(coalesce(sum(k.k), 0) AS BIGINT) AS total_weight,
       CAST(coalesce(any_value(i.w), 0) AS BIGINT) AS inner_weight
FROM dom d LEFT JOIN k ON k.username = d.username LEFT JOIN inner_w i ON i.cluster = d.cluster GROUP BY d.cluster"""))
def j9_community_table(spark, sf_dir):
    e = _clean_pairs(spark, sf_dir).withColumnRenamed("shared_interactions", "weight")
    return G.community_table(e, dominant_community(spark, sf_dir), "cluster").withColumnRenamed("cluster", "community")


@register("j14_reciprocity_by_role", sql(REPLY_CTES, body=f"""
, d AS (SELECT DISTINCT r.author AS src, p.author AS dst FROM replies r JOIN replies p ON p.msg_id = r.parent_msg_id
        WHERE r.author <> p.author),
x AS (SELECT regexp_replace(d.src, '[0-9]+$', '') AS src_group, regexp_replace(d.dst, '[0-9]+$', '') AS dst_group,
             e.src IS NOT NULL AS mutual
      FROM d LEFT JOIN d e ON e.src = d.dst AND e.dst = d.src)
SELECT src_group, dst_group, count(*) AS directed_edges, count(*) FILTER (mutual) AS mutual_edges,
       {sql_r6('count(*) FILTER (mutual) / count(*)')} AS reciprocity
FROM x GROUP BY 1, 2"""))
def j14_reciprocity_by_role(spark, sf_dir):
    d = G.reply_edges(replies(spark, sf_dir))
    who = d.select(F.col("src").alias("username")).union(d.select("dst")).distinct()
    groups = who.select("username", F.regexp_replace("username", "[0-9]+$", "").alias("grp"))
    return G.group_reciprocity(d, groups, "grp")


@register("j24_reciprocity_tiers", sql(REPLY_CTES, body=f"""
, d AS (SELECT DISTINCT r.author AS src, p.author AS dst FROM replies r JOIN replies p ON p.msg_id = r.parent_msg_id
        WHERE r.author <> p.author),
x AS (SELECT d.src, {sql_r6('count(e.src) / count(*)')} AS reciprocity
      FROM d LEFT JOIN d e ON e.src = d.dst AND e.dst = d.src GROUP BY 1)
SELECT src AS username, reciprocity, CASE WHEN reciprocity >= 0.75 THEN 'high_reciprocity'
         WHEN reciprocity >= 0.5 THEN 'medium_reciprocity' WHEN reciprocity >= 0.25 THEN 'low_reciprocity' END AS tier
FROM x"""))
def j24_reciprocity_tiers(spark, sf_dir):
    return G.reciprocity_tiers(G.reply_edges(replies(spark, sf_dir)))


@register("j10_modularity_dominant_partition", sql(EV_CTES, body=_PAIRS_BODY + _DOM_SQL + f"""
, adj AS (SELECT user1 AS i, user2 AS j, CAST(shared_interactions AS DOUBLE) AS a FROM pairs
          UNION ALL SELECT user2, user1, CAST(shared_interactions AS DOUBLE) FROM pairs),
x AS (SELECT adj.*, d1.cluster AS ci, d2.cluster AS cj FROM adj JOIN dom d1 ON d1.username = adj.i
      JOIN dom d2 ON d2.username = adj.j),
m2 AS (SELECT sum(a) AS m2 FROM adj),
pc AS (SELECT ci, sum(a) AS d_c, sum(CASE WHEN ci = cj THEN a ELSE 0 END) AS in_c FROM x GROUP BY ci)
SELECT {sql_r6('sum(in_c / m2 - pow(d_c / m2, 2))')} AS modularity FROM pc, m2"""))
def j10_modularity_dominant_partition(spark, sf_dir):
    e = _clean_pairs(spark, sf_dir).withColumnRenamed("shared_interactions", "weight")
    m = dominant_community(spark, sf_dir)
    return L.modularity(e, m, node="username", community="cluster").withColumn("modularity", r6("modularity"))


@register("j11_degree_centrality", sql(EV_CTES, body=_PAIRS_BODY + f"""
, ends AS (SELECT user1 AS u, shared_interactions AS w FROM pairs UNION ALL SELECT user2, shared_interactions FROM pairs),
n AS (SELECT count(DISTINCT u) AS n FROM ends)
SELECT u AS username, count(*) AS degree, CAST(sum(w) AS BIGINT) AS weighted_degree,
       {sql_r6('count(*) / (n.n - 1.0)')} AS degree_centrality
FROM ends, n GROUP BY u, n.n"""))
def j11_degree_centrality(spark, sf_dir):
    return G.degree_centrality(_clean_pairs(spark, sf_dir).withColumnRenamed("shared_interactions", "weight"))


# --------------------------------------------------------- J14 reciprocity
_RECIP_SQL = """
, d AS (SELECT DISTINCT r.author AS src, p.author AS dst FROM replies r JOIN replies p ON p.msg_id = r.parent_msg_id
        WHERE r.author <> p.author)"""


@register("j14_reciprocity", sql(REPLY_CTES, body=_RECIP_SQL + f"""
SELECT count(*) AS directed_edges, CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM d d2 WHERE d2.src = d.dst AND d2.dst = d.src)
                                     THEN 1 ELSE 0 END) AS BIGINT) AS mutual_edges,
       {sql_r6("sum(CASE WHEN EXISTS (SELECT 1 FROM d d2 WHERE d2.src = d.dst AND d2.dst = d.src) THEN 1 ELSE 0 END) / count(*)")}
         AS reciprocity
FROM d"""))
def j14_reciprocity(spark, sf_dir):
    return G.reciprocity(G.reply_edges(replies(spark, sf_dir)))


@register("c13_reply_pairs", sql(REPLY_CTES, body="""
SELECT r.author AS src, p.author AS dst, count(*) AS n FROM replies r JOIN replies p ON p.msg_id = r.parent_msg_id
GROUP BY 1, 2"""))
def c13_reply_pairs(spark, sf_dir):
    r = replies(spark, sf_dir)
    p = r.select(F.col("msg_id").alias("parent_msg_id"), F.col("author").alias("dst"))
    return r.join(p, "parent_msg_id").groupBy(F.col("author").alias("src"), "dst").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------- J15–J17, J21, J22, J25 (clusters)
@register("j15_intra_inter_cluster", sql(EV_CTES, body=_DOM_SQL + """
, x AS (SELECT date_trunc('day', c.created_utc) AS day, dc.cluster AS c_cluster, dp.cluster AS p_cluster
        FROM comments c JOIN posts p ON c.post_id = p.post_id
        JOIN dom dc ON dc.username = c.author JOIN dom dp ON dp.username = p.author)
SELECT day, CAST(sum(CASE WHEN c_cluster = p_cluster THEN 1 ELSE 0 END) AS BIGINT) AS intra_cluster,
       CAST(sum(CASE WHEN c_cluster <> p_cluster THEN 1 ELSE 0 END) AS BIGINT) AS inter_cluster
FROM x GROUP BY day"""))
def j15_intra_inter_cluster(spark, sf_dir):
    f = forum_from_events(spark, sf_dir)
    return G.intra_inter(f, dominant_community(spark, sf_dir))


@register("j16_community_growth", sql(EV_CTES, body=_DOM_SQL + """
, fs AS (SELECT d.cluster, c.author, min(date_trunc('day', c.created_utc)) AS day
         FROM comments c JOIN dom d ON d.username = c.author GROUP BY 1, 2),
g AS (SELECT cluster, day, count(*) AS new_members FROM fs GROUP BY 1, 2)
SELECT cluster, day, new_members,
       CAST(sum(new_members) OVER (PARTITION BY cluster ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS size,
       new_members - lag(new_members) OVER (PARTITION BY cluster ORDER BY day) AS change
FROM g"""))
def j16_community_growth(spark, sf_dir):
    f = forum_from_events(spark, sf_dir)
    return G.community_growth(f.comments, dominant_community(spark, sf_dir))


@register("j17_cluster_stability", sql(EV_CTES, body="""
, wk AS (SELECT DISTINCT CAST(CAST(created_utc AS DATE) + CAST((7 - isodow(created_utc)) % 7 AS INTEGER) AS TIMESTAMP)
                AS week, src_type AS cluster, author FROM comments),
sz AS (SELECT week, cluster, count(*) AS n FROM wk GROUP BY 1, 2),
ov AS (SELECT a.week, a.cluster, b.cluster AS next_cluster, count(*) AS inter
       FROM wk a JOIN wk b ON b.week = a.week + INTERVAL 7 DAY AND b.author = a.author GROUP BY 1, 2, 3),
j AS (SELECT ov.week, ov.cluster, ov.next_cluster, ov.inter * 1.0 / (s1.n + s2.n - ov.inter) AS jac
      FROM ov JOIN sz s1 ON s1.week = ov.week AND s1.cluster = ov.cluster
      JOIN sz s2 ON s2.week = ov.week + INTERVAL 7 DAY AND s2.cluster = ov.next_cluster)
SELECT week, cluster, arg_max(next_cluster, jac * 1000 - rank_tb) AS best_match,
       (floor((floor((max(jac)) * 1e9 + 0.5) / 1e9) * 1e6 + 0.5) / 1e6) AS jaccard
FROM (SELECT *, dense_rank() OVER (ORDER BY next_cluster) * 1e-9 AS rank_tb FROM j) GROUP BY week, cluster"""))
def j17_cluster_stability(spark, sf_dir):
    from threadlens.functions.timebuckets import bucket
    c = forum_from_events(spark, sf_dir).comments
    m = c.select(bucket("created_utc", "W").alias("window"), F.col("src_type").alias("cluster"), "author").distinct()
    return G.cluster_stability(m, "window", 7)


_TOP_POSTS_SQL = """
, pe AS (SELECT p.post_id, count(c.post_id) AS n FROM posts p LEFT JOIN comments c ON c.post_id = p.post_id GROUP BY 1),
tp AS (SELECT post_id FROM (SELECT *, row_number() OVER (ORDER BY n DESC, post_id) AS r FROM pe)
       WHERE r <= CAST(ceil(0.3 * (SELECT count(*) FROM pe)) AS BIGINT))"""


def _top_posts(f, frac=0.3):
    return G.top_fraction_posts(f, frac)


@register("f3_top_posts", sql(EV_CTES, body=_TOP_POSTS_SQL + "\nSELECT post_id FROM tp"))
def f3_top_posts(spark, sf_dir):
    return _top_posts(forum_from_events(spark, sf_dir)).select("post_id")


@register("j21_commenter_overlap", sql(EV_CTES, body=_TOP_POSTS_SQL + """
SELECT author, count(DISTINCT post_id) AS top_posts FROM comments WHERE post_id IN (SELECT post_id FROM tp)
GROUP BY author HAVING count(DISTINCT post_id) >= 20"""))
def j21_commenter_overlap(spark, sf_dir):
    f = forum_from_events(spark, sf_dir)
    c = f.comments.join(_top_posts(f).select("post_id"), "post_id", "left_semi")
    return (c.groupBy("author").agg(F.countDistinct("post_id").alias("top_posts"))
            .filter(F.col("top_posts") >= 20))


@register("j22_top_influencers", sql(EV_CTES, body=_TOP_POSTS_SQL + f"""
, c AS (SELECT author, count(*) AS n, sum(score) AS s FROM comments WHERE post_id IN (SELECT post_id FROM tp)
        GROUP BY author),
t AS (SELECT sum(n) AS tn, sum(s) AS ts FROM c)
SELECT author, n AS comments_on_top, {sql_r6('n / tn')} AS comment_share, {sql_r6('s / ts')} AS score_share
FROM (SELECT * FROM c ORDER BY n DESC, author LIMIT 20), t"""))
def j22_top_influencers(spark, sf_dir):
    f = forum_from_events(spark, sf_dir)
    c = f.comments.join(_top_posts(f).select("post_id"), "post_id", "left_semi")
    a = c.groupBy("author").agg(F.count(F.lit(1)).alias("comments_on_top"), F.sum("score").alias("s"))
    tot = a.agg(F.sum("comments_on_top").alias("tn"), F.sum("s").alias("ts")).first()
    top = a.orderBy(F.desc("comments_on_top"), "author").limit(20)
    return top.select("author", "comments_on_top",
                      r6(F.col("comments_on_top") / F.lit(float(tot["tn"]))).alias("comment_share"),
                      r6(F.col("s") / F.lit(float(tot["ts"]))).alias("score_share"))


@register("j20_post_post_graph", sql(EV_CTES, body=_TOP_POSTS_SQL + """
, up AS (SELECT DISTINCT c.post_id, c.author FROM comments c WHERE c.post_id IN (SELECT post_id FROM tp))
SELECT a.post_id AS post1, b.post_id AS post2, count(*) AS shared_users
FROM up a JOIN up b ON a.author = b.author AND a.post_id < b.post_id GROUP BY 1, 2 HAVING count(*) >= 40"""))
def j20_post_post_graph(spark, sf_dir):
    f = forum_from_events(spark, sf_dir)
    c = f.comments.join(_top_posts(f).select("post_id"), "post_id", "left_semi")
    up = c.select(F.col("post_id").cast("string").alias("username"), F.col("author").alias("post_id")).distinct()
    p = G.shared_thread_pairs(up, 40)
    # node ids were cast to strings for the pair order; compare numerically
    return p.select(F.least(F.col("user1").cast("bigint"), F.col("user2").cast("bigint")).alias("post1"),
                    F.greatest(F.col("user1").cast("bigint"), F.col("user2").cast("bigint")).alias("post2"),
                    F.col("shared_interactions").alias("shared_users"))


@register("j25_cluster_description", sql(EV_CTES, body=_DOM_SQL + f"""
SELECT d.cluster, count(DISTINCT d.username) AS size, count(*) AS n_comments, {sql_r6('avg(c.score)')} AS avg_score
FROM dom d JOIN comments c ON c.author = d.username GROUP BY d.cluster"""))
def j25_cluster_description(spark, sf_dir):
    f = forum_from_events(spark, sf_dir)
    dom = dominant_community(spark, sf_dir)
    c = f.comments.join(dom.withColumnRenamed("username", "author"), "author")
    return c.groupBy("cluster").agg(F.countDistinct("author").alias("size"), F.count(F.lit(1)).alias("n_comments"),
                                    r6(F.avg("score")).alias("avg_score"))


_TIERS_JSON = f"read_json_auto('{DATA_DIR}/flagged_users.json')"


@register("a3_flagged_tier_activity", sql(EV_CTES, FLAG_CTES, body=_DEDUP + f"""
, tiers AS (SELECT unnest(manual) AS username, 'manual' AS tier FROM {_TIERS_JSON}
            UNION ALL SELECT unnest(high_reciprocity), 'high_reciprocity' FROM {_TIERS_JSON}
            UNION ALL SELECT unnest(medium_reciprocity), 'medium_reciprocity' FROM {_TIERS_JSON}
            UNION ALL SELECT unnest(low_reciprocity), 'low_reciprocity' FROM {_TIERS_JSON})
SELECT t.tier, t.username, count(d.id) AS interactions
FROM tiers t LEFT JOIN dedup d ON d.username = t.username GROUP BY 1, 2"""))
def a3_flagged_tier_activity(spark, sf_dir):
    tiers = flagged_users(spark)
    d = _flag_dedup(spark, sf_dir)
    return (tiers.join(d, "username", "left").groupBy("tier", "username")
            .agg(F.count("id").alias("interactions")))


@register("j18_windowed_communities")
def j18_windowed_communities(spark, sf_dir):
    """Louvain per week over the week's co-engagement pairs, all weeks in one job."""
    from threadlens.functions.timebuckets import bucket
    f = forum_from_events(spark, sf_dir)
    c = f.comments.select(F.col("author").alias("username"), "post_id", bucket("created_utc", "W").alias("week"))
    up = c.distinct()
    pairs = G.keyed_shared_thread_pairs(up, "week", 5)
    return L.louvain(pairs, "user1", "user2", "shared_interactions", group="week")


@register("j12_closeness_sampled")
def j12_closeness_sampled(spark, sf_dir):
    e = _clean_pairs(spark, sf_dir).withColumnRenamed("shared_interactions", "weight")
    return G.closeness_sampled(e, 16)


@register("j13_betweenness_sampled")
def j13_betweenness_sampled(spark, sf_dir):
    e = _clean_pairs(spark, sf_dir).withColumnRenamed("shared_interactions", "weight")
    return G.betweenness_sampled(e, 16)


@register("j26_merge_redundant_clusters", sql(EV_CTES, body="""
, m AS (SELECT DISTINCT CAST(CAST(created_utc AS DATE) + CAST((7 - isodow(created_utc)) % 7 AS INTEGER) AS TIMESTAMP) AS w,
               src_type AS cluster, author FROM comments),
n AS (SELECT w, cluster, count(*) AS n, strftime(w, '%Y-%m-%d %H:%M:%S') || '|' || cluster AS node FROM m GROUP BY 1, 2),
o AS (SELECT a.w, a.cluster AS c1, b.cluster AS c2, count(*) AS i
      FROM m a JOIN m b ON b.author = a.author AND b.w = a.w + INTERVAL 7 DAY GROUP BY 1, 2, 3),
l AS (SELECT x.node AS a, y.node AS b FROM o JOIN n x ON x.w = o.w AND x.cluster = o.c1
      JOIN n y ON y.w = o.w + INTERVAL 7 DAY AND y.cluster = o.c2 WHERE o.i >= 0.5 * (x.n + y.n - o.i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT node AS a, node AS b FROM n UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b)
SELECT n.w AS "window", n.cluster, min(reach.b) AS merged FROM n JOIN reach ON reach.a = n.node GROUP BY 1, 2""").replace(
    "WITH ", "WITH RECURSIVE ", 1))
def j26_merge_redundant_clusters(spark, sf_dir):
    from threadlens.functions.timebuckets import bucket
    c = forum_from_events(spark, sf_dir).comments
    m = c.select(bucket("created_utc", "W").alias("window"), F.col("src_type").alias("cluster"), "author").distinct()
    return G.merge_redundant_clusters(m, "window", 7, 0.5)


@register("j19_meta_clusters")
def j19_meta_clusters(spark, sf_dir):
    from threadlens.operators.ml import meta_clusters
    f = forum_from_events(spark, sf_dir)
    dom = dominant_community(spark, sf_dir)
    c = f.comments.join(dom.withColumnRenamed("username", "author"), "author")
    feats = c.groupBy("cluster").agg(F.countDistinct("author").cast("double").alias("size"),
                                     F.count(F.lit(1)).cast("double").alias("n_comments"),
                                     F.avg("score").alias("avg_score"))
    return meta_clusters(feats, "cluster", ["size", "n_comments", "avg_score"], k=2)


@register("j12_closeness_all", sql(EV_CTES, body=_PAIRS_BODY + f"""
, adj AS (SELECT user1 AS i, user2 AS j FROM pairs UNION SELECT user2, user1 FROM pairs),
walk AS (SELECT DISTINCT i AS a, i AS b, 0 AS d FROM adj
         UNION SELECT w.a, e.j, w.d + 1 FROM walk w JOIN adj e ON e.i = w.b WHERE w.d < 8),
near AS (SELECT a, b, min(d) AS d FROM walk GROUP BY a, b),
c AS (SELECT a AS username, count(*) - 1 AS reached, sum(d) AS hops FROM near GROUP BY a)
SELECT username, reached,
       {sql_r6('(CAST(reached AS DOUBLE) / hops) * (CAST(reached AS DOUBLE) / (SELECT count(*) - 1 FROM c))')} AS closeness
FROM c""").replace("WITH ", "WITH RECURSIVE ", 1))
def j12_closeness_all(spark, sf_dir):
    from threadlens.operators.sketches import closeness_all
    return closeness_all(_clean_pairs(spark, sf_dir))


@register("j16_cluster_events", sql(EV_CTES, body="""
, m AS (SELECT DISTINCT CAST(CAST(created_utc AS DATE) + CAST((7 - isodow(created_utc)) % 7 AS INTEGER) AS TIMESTAMP) AS w,
               post_id AS cluster, author FROM comments WHERE author IS NOT NULL),
n AS (SELECT w, cluster, count(*) AS n FROM m GROUP BY 1, 2),
o AS (SELECT a.w, a.cluster AS c1, b.cluster AS c2, count(*) AS i
      FROM m a JOIN m b ON b.author = a.author AND b.w = a.w + INTERVAL 7 DAY GROUP BY 1, 2, 3),
l AS (SELECT o.* FROM o JOIN n x ON x.w = o.w AND x.cluster = o.c1
      JOIN n y ON y.w = o.w + INTERVAL 7 DAY AND y.cluster = o.c2 WHERE o.i >= 0.3 * least(x.n, y.n)),
r AS (SELECT n.w, n.cluster, n.n, (SELECT count(*) FROM l WHERE l.w = n.w - INTERVAL 7 DAY AND l.c2 = n.cluster) AS n_before,
             (SELECT count(*) FROM l WHERE l.w = n.w AND l.c1 = n.cluster) AS n_after FROM n)
SELECT w AS "window", cluster, n, n_before, n_after,
       CASE WHEN w = (SELECT min(w) FROM n) THEN NULL WHEN n_before = 0 THEN 'birth' WHEN n_before > 1 THEN 'merge' ELSE 'goes on' END AS came,
       CASE WHEN w = (SELECT max(w) FROM n) THEN NULL WHEN n_after = 0 THEN 'death' WHEN n_after > 1 THEN 'split' ELSE 'goes on' END AS went
FROM r"""))
def j16_cluster_events(spark, sf_dir):
    """Births, deaths, merges and splits of the weekly groups of commenters of each thread."""
    from threadlens.functions.timebuckets import bucket
    c = forum_from_events(spark, sf_dir).comments
    m = c.select(bucket("created_utc", "W").alias("window"), F.col("post_id").alias("cluster"), "author")
    return G.cluster_events(m, "window", 7, 0.3)


@register("j19_overlap_clusters", sql(EV_CTES, body="""
, m AS (SELECT DISTINCT CAST(post_id AS VARCHAR) || '/' || strftime(created_utc, '%Y-%m-%d') AS c, author FROM comments
        WHERE author IS NOT NULL),
n AS (SELECT c, count(*) AS n FROM m GROUP BY c),
o AS (SELECT a.c AS a, b.c AS b, count(*) AS i FROM m a JOIN m b ON a.author = b.author AND a.c <> b.c GROUP BY 1, 2),
l AS (SELECT o.a, o.b FROM o JOIN n x ON x.c = o.a JOIN n y ON y.c = o.b WHERE o.i >= 0.8 * least(x.n, y.n) AND least(x.n, y.n) > 3),
reach AS (SELECT c AS a, c AS b FROM n WHERE n > 3 UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b)
SELECT n.c AS cluster, n.n, min(reach.b) AS meta FROM n JOIN reach ON reach.a = n.c GROUP BY 1, 2""").replace(
    "WITH ", "WITH RECURSIVE ", 1))
def j19_overlap_clusters(spark, sf_dir):
    """Daily groups of commenters of a thread (more than three), tied by shared members."""
    c = forum_from_events(spark, sf_dir).comments.where("author is not null")
    m = c.select(F.concat(F.col("post_id").cast("string"), F.lit("/"), F.date_format("created_utc", "yyyy-MM-dd")).alias("c"), "author").distinct()
    big = m.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("n > 3").select("c")
    return G.overlap_clusters(m.join(big, "c"), "c", "author", 0.8)
