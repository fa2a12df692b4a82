"""User co-engagement graphs (inventory J1–J6, J8–J11, J14, J20–J22).

A graph is two DataFrames: ``edges(user1, user2, weight)`` with user1 < user2
and ``nodes(username, ...)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from threadlens.functions.predicates import author_ok, date_range, in_communities
from threadlens.params import DEFAULT, Params
from threadlens.sources.roles import Forum


MAX_TILE_TASKS = 4096     # tasks for pairs of users; beyond it a task takes several tiles
DENSE = 0.25              # candidates a pair of users from which a tile counts by matrices
TILE_ENTRIES = 2_000_000  # users of threads in a block of such a tile
TILES_OF_TASK = 4         # such tiles one task takes
WIDE = 16                 # sources of a search whose values at a node are one row
SENT_NODES = 250_000      # such rows (about 40 MB) that go to the edges; more are met by a shuffle


def interactions(forum: Forum, start, end, communities: Sequence[str] | None = None,
                 clean_authors: bool = False) -> DataFrame:
    """G1: (username, post_id) of posts in range ∪ comments in range on posts of
    the selected communities (post date not filtered for comments, C1)."""
    p = forum.posts.filter(date_range("created_utc", start, end))
    p = in_communities(p, "subreddit", communities, empty="all")
    c = forum.comments.filter(date_range("created_utc", start, end))
    if clean_authors:
        p = p.filter(author_ok("author"))
        c = c.filter(author_ok("author"))
    parent = in_communities(forum.posts.select("post_id", "subreddit"), "subreddit",
                            communities, empty="all").select("post_id")
    c = c.join(parent, "post_id", "inner")
    return (p.select(F.col("author").alias("username"), "post_id")
            .unionByName(c.select(F.col("author").alias("username"), "post_id")))


def user_posts(inter: DataFrame) -> DataFrame:
    """G2 + B7: distinct (username, post_id) with a user and a post id."""
    return inter.filter(F.col("post_id").isNotNull() & F.col("username").isNotNull()).distinct()


def shared_thread_pairs(up: DataFrame, min_shared: int = 2,
                        chunk_users: int = DEFAULT.pair_chunk_users, keys: Sequence[str] = ()) -> DataFrame:
    """C2 + D4: pairs (user1 < user2) sharing at least ``min_shared`` threads,
    per value of ``keys`` (e.g. per week) when given.

    Same result as the self join ``up1.post_id = up2.post_id AND up1.u < up2.u``
    grouped by pair, with three changes for scale:

    * Pruning (exact): a user with fewer than ``min_shared`` threads cannot
      reach the threshold; a thread left with one user makes no pair.
    * Users are numbered and dealt over blocks, and a thread's users travel as
      one list per block, once to every block that its other users are in. A
      tile (two blocks) meets all its threads in one task, so candidate pairs are
      made and counted there and never shuffled: the shuffle grows with users times
      blocks, not with the pairs.
    * There are as many blocks as keep a tile at about chunk_users² / 4 pairs by
      the candidates there are, so neither a hot thread nor many threads make a
      tile large, and a few pairs make few tiles.
    * Where candidates come near to all pairs there are (few threads of very many users), a tile
      counts them as a product of its two membership matrices, and no candidate is a row.
    """
    import math

    from threadlens.session import written
    keys = list(keys)
    if min_shared > 1:
        active = (up.groupBy(*keys, "username").agg(F.count(F.lit(1)).alias("n_threads"))
                  .filter(F.col("n_threads") >= min_shared).select(*keys, "username"))
        up = up.join(active, keys + ["username"], "left_semi")
    names = written(up.select("username").distinct().withColumn("u", F.monotonically_increasing_id()), "pair-users")
    up = up.join(names, "username").select(*keys, "post_id", "u")
    deg = (up.groupBy(*keys, "post_id").agg(F.count(F.lit(1)).alias("deg"))
           .filter(F.col("deg") >= 2))
    up = written(up.join(deg, keys + ["post_id"], "inner"), "pair-threads")
    # every user of a thread of d makes d - 1 candidates; all users make no more pairs than there are
    each = up.groupBy(*keys).agg(F.sum(F.col("deg") - 1.0).alias("met"), F.count(F.lit(1)).alias("rows"),
                                 F.countDistinct("u").alias("users"))
    told = each.agg(F.sum("met"), F.sum(F.col("users") * (F.col("users") - 1.0)), F.max("users"), F.max("rows"), F.count(F.lit(1))).first()
    met, every = float(told[0] or 0) / 2, float(told[1] or 0) / 2
    if met >= DENSE * every > 0:
        blocks = max(1, math.ceil(told[2] * 2 / chunk_users), math.ceil(told[3] / TILE_ENTRIES))
        return _dense_pairs(up, names, blocks, min(told[4] * blocks * (blocks + 1) // 2, MAX_TILE_TASKS), min_shared, keys)
    n = names.count()
    most = met if keys else min(met, n * (n - 1) / 2)
    blocks = max(1, math.ceil(math.sqrt(2 * most) * 2 / chunk_users))
    lists = up.withColumn("at", F.pmod(F.xxhash64("u"), F.lit(blocks)).cast("int")).groupBy(*keys, "post_id", "at").agg(
        F.collect_list("u").alias("us"))
    lists = written(lists, "pair-lists")
    places = lists.groupBy(*keys, "post_id").agg(F.collect_list("at").alias("ats"))
    sent = lists.join(places, keys + ["post_id"]).select(*keys, "post_id", "at", "us", F.explode("ats").alias("other"))
    sent = sent.select(*keys, "post_id", F.least("at", "other").alias("a"), F.greatest("at", "other").alias("b"),
                       F.when(F.col("at") <= F.col("other"), F.col("us")).alias("one"),
                       F.when(F.col("at") >= F.col("other"), F.col("us")).alias("two"))
    tiles = min(blocks * (blocks + 1) // 2, MAX_TILE_TASKS)
    sent = sent.repartition(max(tiles, sent.sparkSession.sparkContext.defaultParallelism), *keys, "a", "b")
    met = sent.groupBy(*keys, "a", "b", "post_id").agg(F.max("one").alias("one"), F.max("two").alias("two"))
    cand = (met.select(*keys, "a", "b", F.explode("one").alias("u"), "two").select(*keys, "a", "b", "u", F.explode("two").alias("v"))
            .filter((F.col("a") < F.col("b")) | (F.col("u") < F.col("v"))))
    pairs = (cand.groupBy(*keys, "a", "b", "u", "v").agg(F.count(F.lit(1)).alias("shared_interactions"))
             .filter(F.col("shared_interactions") >= min_shared).drop("a", "b"))
    return _named(pairs, names, keys)


def _named(pairs: DataFrame, names: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, user1, user2, shared_interactions) of pairs of numbers (u, v)."""
    one, two = names.select("u", F.col("username").alias("a")), names.select(F.col("u").alias("v"), F.col("username").alias("b"))
    return pairs.join(one, "u").join(two, "v").select(
        *keys, F.least("a", "b").alias("user1"), F.greatest("a", "b").alias("user2"), "shared_interactions")


def _dense_pairs(up: DataFrame, names: DataFrame, blocks: int, tiles: int, min_shared: int, keys: Sequence[str]) -> DataFrame:
    """The pairs of ``up`` (keys, post_id, u), counted in every tile of two blocks by ``crowd.tile_pairs``."""
    from threadlens.operators.crowd import tile_pairs
    from threadlens.session import ship_package, written
    spark = up.sparkSession
    ship_package(spark)
    seats = names.withColumn("at", F.pmod(F.xxhash64("u"), F.lit(blocks)).cast("int"))
    seats = written(seats.withColumn("place", F.row_number().over(Window.partitionBy("at").orderBy("u")) - 1), "pair-seats")
    lists = up.join(seats.select("u", "at", "place"), "u").groupBy(*keys, "post_id", "at").agg(F.collect_list("place").alias("us"))
    lists = written(lists, "pair-lists")
    places = lists.groupBy(*keys, "post_id").agg(F.collect_list("at").alias("ats"))
    sent = lists.join(places, list(keys) + ["post_id"]).select(*keys, "post_id", "at", "us", F.explode("ats").alias("other"))
    sent = sent.select(*keys, F.least("at", "other").alias("a"), F.greatest("at", "other").alias("b"), "post_id", "at", "us")
    sent = sent.repartition(max(tiles // TILES_OF_TASK, spark.sparkContext.defaultParallelism), *keys, "a", "b")
    shape = StructType([up.schema[k] for k in keys] + [StructField(c, LongType()) for c in ("u", "v", "shared_interactions")])
    pairs = sent.groupBy(*keys, "a", "b").applyInArrow(tile_pairs(len(keys), max(1, min_shared)), shape)
    seat = (F.shiftleft(F.col("at").cast("long"), 32) + F.col("place")).alias("u")
    return _named(pairs, seats.select("username", seat), keys)


def keyed_shared_thread_pairs(up: DataFrame, key: str, min_shared: int = 2) -> DataFrame:
    """Pairs per value of ``key`` (J18 windows): (key, user1, user2, shared)."""
    return shared_thread_pairs(up, min_shared, keys=[key])


def find_user_pairs(forum: Forum, start, end, communities=None, min_shared: int = 2,
                    clean_authors: bool = False, params: Params = DEFAULT) -> DataFrame:
    """J1 (clean_authors=False) and J2 (True).

    The distinct (user, thread) table is written once to the shared folder:
    the pair job reads it three times (user pruning, thread degrees, the
    tiles), and it is much smaller than the interactions it comes from."""
    from threadlens.session import written
    up = written(user_posts(interactions(forum, start, end, communities, clean_authors)), "user-posts")
    return shared_thread_pairs(up, min_shared, params.pair_chunk_users)


def user_totals(forum: Forum, start, end, communities=None) -> DataFrame:
    """Per-author post totals ∪ comment totals, re-aggregated.
    (username, total_interactions, total_score)."""
    p = in_communities(forum.posts.filter(date_range("created_utc", start, end)),
                       "subreddit", communities, empty="all")
    pt = p.groupBy(F.col("author").alias("username")).agg(
        F.count(F.lit(1)).alias("interaction_count"), F.sum("score").alias("total_score"))
    parent = in_communities(forum.posts.select("post_id", "subreddit"), "subreddit",
                            communities, empty="all").select("post_id")
    c = forum.comments.filter(date_range("created_utc", start, end)).join(parent, "post_id")
    ct = c.groupBy(F.col("author").alias("username")).agg(
        F.count(F.lit(1)).alias("interaction_count"), F.sum("score").alias("total_score"))
    return (pt.unionByName(ct).groupBy("username")
            .agg(F.sum("interaction_count").alias("total_interactions"),
                 F.sum("total_score").alias("total_score")))


def weighted_graph(pairs: DataFrame, totals: DataFrame, min_score: float):
    """J3 with B13 and C3: nodes = users with total_score >= min_score (isolated
    kept); edges = pairs whose both ends are such users. Returns (nodes, edges). The nodes are
    written: their size is known then, and the pairs, many more, need not move to meet few of them."""
    from threadlens.session import written
    nodes = written(totals.filter(F.col("total_score") >= min_score).select(
        "username", F.col("total_score").alias("user_score")), "graph-nodes")
    keep = nodes.select("username")
    edges = (pairs.join(keep.withColumnRenamed("username", "user1"), "user1", "left_semi")
             .join(keep.withColumnRenamed("username", "user2"), "user2", "left_semi")
             .select("user1", "user2", F.col("shared_interactions").alias("weight")))
    return nodes, edges


def scale_edges(edges: DataFrame) -> DataFrame:
    """width = (w - min) / (max - min); equal weights → denominator 1.
    min/max are one scalar aggregate read back as literals, over edges that
    are written first: they are read twice."""
    from threadlens.session import written
    edges = written(edges, "edges")
    row = edges.agg(F.min("weight").alias("lo"), F.max("weight").alias("hi")).first()
    lo = row["lo"] if row["lo"] is not None else 0
    hi = row["hi"] if row["hi"] is not None else 1
    den = (hi - lo) if hi != lo else 1
    return edges.withColumn("scaled_weight", (F.col("weight") - F.lit(lo)) / F.lit(float(den)))


def scale_nodes(nodes: DataFrame, col: str = "user_score") -> DataFrame:
    """scaled = (s - min)/(max - min) (denominator 1 when equal);
    size = 10 + s / max * 40, or 10 when max <= 0."""
    row = nodes.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    lo = float(row["lo"]) if row["lo"] is not None else 0.0
    hi = float(row["hi"]) if row["hi"] is not None else 1.0
    den = (hi - lo) if hi != lo else 1.0
    size = (F.lit(10.0) + F.col(col) / F.lit(hi) * F.lit(40.0)) if hi > 0 else F.lit(10.0)
    return (nodes.withColumn("scaled_score", (F.col(col) - F.lit(lo)) / F.lit(den))
            .withColumn("node_size", size))


# ------------------------------------------------------------ flagged graph
def bipartite_edges(inter: DataFrame) -> DataFrame:
    """user–thread edges from comment interactions; duplicates collapse."""
    return inter.filter(F.col("interaction_type") == "comment").select("username", "post_id").distinct()


def bipartite_nodes(inter: DataFrame) -> DataFrame:
    """J6 nodes: users (label = name) and threads (label = the thread's author
    from its earliest 'post' interaction, else its earliest commenter)."""
    e = bipartite_edges(inter)
    users = e.select(F.col("username").alias("node")).distinct().select(
        "node", F.lit("user").alias("node_type"), F.col("node").alias("label"))
    pl = (inter.filter(F.col("interaction_type") == "post").groupBy("post_id")
          .agg(F.min_by("username", "id").alias("author")))
    cl = (inter.filter(F.col("interaction_type") == "comment").groupBy("post_id")
          .agg(F.min_by("username", "id").alias("first_commenter")))
    posts = (e.select("post_id").distinct().join(pl, "post_id", "left").join(cl, "post_id", "left")
             .select(F.col("post_id").cast("string").alias("node"), F.lit("post").alias("node_type"),
                     F.coalesce("author", "first_commenter").alias("label")))
    return users.unionByName(posts)


def degree_centrality(edges: DataFrame) -> DataFrame:
    """Degree, weighted degree and degree / (n − 1)."""
    from threadlens.functions.numeric import r6
    from threadlens.session import written
    ends = edges.select(F.explode(F.array("user1", "user2")).alias("username"), "weight")   # one pass over the edges
    d = ends.groupBy("username").agg(F.count(F.lit(1)).alias("degree"),
                                      F.sum("weight").cast("bigint").alias("weighted_degree"))
    d = written(d, "degrees")     # counted and returned
    n = d.count()
    cen = r6(F.col("degree") / F.lit(float(n - 1))) if n > 1 else F.lit(None).cast("double")
    return d.withColumn("degree_centrality", cen)


def reply_edges(rep: DataFrame) -> DataFrame:
    """C13 → distinct directed reply edges (src replied to dst), no self replies."""
    p = rep.select(F.col("msg_id").alias("parent_msg_id"), F.col("author").alias("dst"))
    return (rep.join(p, "parent_msg_id").select(F.col("author").alias("src"), "dst")
            .filter(F.col("src") != F.col("dst")).distinct())


def reciprocity(d: DataFrame) -> DataFrame:
    """Share of directed edges whose reverse edge also exists."""
    from threadlens.functions.numeric import r6
    rev = d.select(F.col("dst").alias("src"), F.col("src").alias("dst")).withColumn("m", F.lit(1))
    x = d.join(rev, ["src", "dst"], "left")
    return x.agg(F.count(F.lit(1)).alias("directed_edges"),
                 F.sum(F.coalesce("m", F.lit(0))).cast("bigint").alias("mutual_edges")).withColumn(
        "reciprocity", r6(F.col("mutual_edges") / F.col("directed_edges")))


def intra_inter(forum: Forum, clusters: DataFrame) -> DataFrame:
    """Per day, replies (comments) inside vs across the clusters of the
    commenter and of the thread author."""
    cc = clusters.select(F.col("username").alias("author"), F.col("cluster").alias("c_cluster"))
    pc = clusters.select(F.col("username").alias("p_author"), F.col("cluster").alias("p_cluster"))
    x = (forum.comments.select("post_id", "author", "created_utc")
         .join(forum.posts.select("post_id", F.col("author").alias("p_author")), "post_id")
         .join(cc, "author").join(pc, "p_author"))
    same = (F.col("c_cluster") == F.col("p_cluster"))
    return x.groupBy(F.window("created_utc", "1 day").start.alias("day")).agg(
        F.sum(same.cast("int")).cast("bigint").alias("intra_cluster"),
        F.sum((~same).cast("int")).cast("bigint").alias("inter_cluster"))


def community_growth(acts: DataFrame, clusters: DataFrame) -> DataFrame:
    """Members joining each cluster per day (first activity), running
    size and day-over-day change."""
    x = acts.join(clusters.withColumnRenamed("username", "author"), "author")
    fs = x.groupBy("cluster", "author").agg(F.min(F.window("created_utc", "1 day").start).alias("day"))
    g = fs.groupBy("cluster", "day").agg(F.count(F.lit(1)).alias("new_members"))
    w = Window.partitionBy("cluster").orderBy("day")
    return (g.withColumn("size", F.sum("new_members").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("change", F.col("new_members") - F.lag("new_members").over(w)))


def cluster_stability(members: DataFrame, window: str, step_days: int) -> DataFrame:
    """For each (window, cluster), the cluster of the next window with the
    highest member Jaccard (ties → smallest id)."""
    from threadlens.functions.numeric import r6
    sz = members.groupBy(window, "cluster").agg(F.count(F.lit(1)).alias("n"))
    nxt = members.select((F.col(window) - F.make_dt_interval(days=F.lit(step_days))).alias(window),
                         F.col("cluster").alias("next_cluster"), "author")
    ov = members.join(nxt, [window, "author"]).groupBy(window, "cluster", "next_cluster").agg(
        F.count(F.lit(1)).alias("inter"))
    s2 = sz.select((F.col(window) - F.make_dt_interval(days=F.lit(step_days))).alias(window),
                   F.col("cluster").alias("next_cluster"), F.col("n").alias("n2"))
    j = ov.join(sz, [window, "cluster"]).join(s2, [window, "next_cluster"]).withColumn(
        "jac", F.col("inter") / (F.col("n") + F.col("n2") - F.col("inter")))
    return j.groupBy(F.col(window).alias("week"), "cluster").agg(
        F.min_by("next_cluster", F.struct(-F.col("jac"), F.col("next_cluster"))).alias("best_match"),
        r6(F.max("jac")).alias("jaccard"))


def top_fraction_posts(forum: Forum, frac: float) -> DataFrame:
    """the first ceil(frac·N) threads by comment count (desc), ties by id.

    No global window: the cut-off count and, inside the tied group, the cut-off
    id are found by exact rank selection (bucketed counting), then the threads
    are kept by a plain filter."""
    import math

    from threadlens.operators.quantiles import value_at_rank
    cnt = forum.comments.groupBy("post_id").agg(F.count(F.lit(1)).alias("n"))
    pe = forum.posts.select("post_id").join(cnt, "post_id", "left").fillna(0, subset=["n"])
    total = pe.count()
    k = int(math.ceil(frac * total))
    if k <= 0:
        return pe.limit(0)
    v = value_at_rank(pe, "n", total - k)     # rank k-1 from the top
    above = pe.filter(F.col("n") > F.lit(v))
    need = k - above.count()
    ties = pe.filter(F.col("n") == F.lit(v))
    idcut = value_at_rank(ties, "post_id", need - 1)
    return above.unionByName(ties.filter(F.col("post_id") <= F.lit(idcut)))


def edge_table(edges: DataFrame, membership: DataFrame, community: str) -> DataFrame:
    """The edge export: both ends with their communities (NULL if they have none). The membership is
    written, so its size is known and many edges need not move to meet few users."""
    from threadlens.session import written
    membership = written(membership.select("username", community), "membership")
    side = lambda i: membership.select(F.col("username").alias(f"user{i}"), F.col(community).alias(f"community{i}"))
    return edges.join(side(1), "user1", "left").join(side(2), "user2", "left").select(
        "user1", "user2", "weight", "community1", "community2")


def community_table(edges: DataFrame, membership: DataFrame, community: str) -> DataFrame:
    """Per community its users, the weight at their ends, and the weight of the
    edges inside. One pass over the edges with their communities."""
    e = edge_table(edges, membership, community)
    ends = e.select(F.explode(F.array(
        F.struct(F.col("community1").alias("c"), F.when(F.col("community1") == F.col("community2"), F.col("weight")).alias("inside"),
                 F.col("weight").alias("w")),
        F.struct(F.col("community2").alias("c"), F.lit(None).cast("long").alias("inside"), F.col("weight").alias("w")))).alias("x"))
    sums = ends.groupBy(F.col("x.c").alias(community)).agg(F.sum("x.w").alias("total_weight"),
                                                          F.sum("x.inside").alias("inner_weight"))
    n = membership.groupBy(community).agg(F.count(F.lit(1)).alias("n_users"))
    return n.join(sums, community, "left").select(
        community, "n_users", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("total_weight", "inner_weight")])


def _mutual(d: DataFrame) -> DataFrame:
    """Directed edges with ``mutual`` (0/1): whether the reverse edge is there."""
    rev = d.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("mutual"))
    return d.join(rev, ["src", "dst"], "left").withColumn("mutual", F.coalesce("mutual", F.lit(0)))


def group_reciprocity(d: DataFrame, membership: DataFrame, group: str) -> DataFrame:
    """J14 inside and across groups: reciprocity per (group of the source, group of
    the target)."""
    from threadlens.functions.numeric import r6
    x = (_mutual(d).join(membership.select(F.col("username").alias("src"), F.col(group).alias("src_group")), "src")
         .join(membership.select(F.col("username").alias("dst"), F.col(group).alias("dst_group")), "dst"))
    return x.groupBy("src_group", "dst_group").agg(
        F.count(F.lit(1)).alias("directed_edges"), F.sum("mutual").cast("bigint").alias("mutual_edges"),
        r6(F.avg("mutual")).alias("reciprocity"))


def reciprocity_tiers(d: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Per user the share of their targets that answer, and the tier by the
    thresholds of ``params``; below the lowest the tier is NULL."""
    from threadlens.functions.numeric import r6
    x = _mutual(d).groupBy(F.col("src").alias("username")).agg(r6(F.avg("mutual")).alias("reciprocity"))
    r = F.col("reciprocity")
    tier = (F.when(r >= params.high_reciprocity, "high_reciprocity")
            .when(r >= params.medium_reciprocity, "medium_reciprocity")
            .when(r >= params.low_reciprocity, "low_reciprocity"))
    return x.withColumn("tier", tier)


def _both_ways(edges: DataFrame) -> DataFrame:
    """Every edge as (a, b) and (b, a), written: each level of a search reads them, and making the
    edges (pairs of users) is most of the work."""
    from threadlens.session import written
    e = written(edges.select("user1", "user2"), "graph-edges")
    return e.select(F.col("user1").alias("a"), F.col("user2").alias("b")).unionByName(
        e.select(F.col("user2").alias("a"), F.col("user1").alias("b")))


def _sources(nodes: DataFrame, n_sources: int, seed: int) -> DataFrame:
    """(src, pos): the ``n_sources`` nodes with the smallest hash (deterministic) and their places from 0."""
    from threadlens.session import written
    src = nodes.withColumn("_h", F.xxhash64("node", F.lit(seed))).orderBy("_h", "node").limit(n_sources)
    place = F.row_number().over(Window.orderBy("_h", "node")) - 1
    return written(src.select(F.col("node").alias("src"), place.alias("pos")), "sources")


def _around(und: DataFrame, held: DataFrame) -> DataFrame:
    """(pos, node, value): for every source ``pos`` the sum of the values ``held`` (pos, node, value > 0) by a node's
    neighbours, where there is one. A node's values of ``WIDE`` sources are one row, so an edge is met once for all
    of them and not once a source; few such rows go to the edges."""
    from threadlens.session import written
    slot = F.pmod("pos", F.lit(WIDE))
    wide = written(held.groupBy("node", F.floor(F.col("pos") / WIDE).cast("int").alias("part")).agg(
        *[F.sum(F.when(slot == i, F.col("value"))).alias(f"v{i}") for i in range(WIDE)]), "values-at-nodes")
    if wide.count() <= SENT_NODES:
        wide = F.broadcast(wide)
    sums = und.join(wide, und["a"] == wide["node"]).groupBy("part", F.col("b").alias("node")).agg(
        *[F.sum(f"v{i}").alias(f"v{i}") for i in range(WIDE)])
    one = F.explode(F.array(*[F.struct((F.col("part") * WIDE + i).alias("pos"), F.col(f"v{i}").alias("value")) for i in range(WIDE)]))
    return sums.select("node", one.alias("x")).select("x.pos", "node", "x.value").where("value is not null")


def closeness_sampled(edges: DataFrame, n_sources: int = 16, seed: int = 7) -> DataFrame:
    """Closeness of the sampled source nodes (unweighted shortest paths):
    (reached − 1)/Σdist × (reached − 1)/(n − 1), the Wasserman–Faust form.

    Sources are the ``n_sources`` nodes with the smallest hash (deterministic).
    All sources advance together, one pass over the edges per BFS level, until no frontier is
    left (no depth cap) or every node is reached; the edges and every level are written once."""
    from threadlens.functions.numeric import r6
    from threadlens.session import written
    und = _both_ways(edges)
    nodes = written(und.select(F.col("a").alias("node")).distinct(), "graph-nodes")
    n = nodes.count()
    src = _sources(nodes, n_sources, seed)
    visited = written(src.select("pos", F.col("src").alias("node"), F.lit(0).alias("dist")), "closeness-level")
    frontier, found, level = visited, src.count(), 0
    every = n * found
    while found < every:
        level += 1
        nxt = _around(und, frontier.select("pos", "node", F.lit(1.0).alias("value"))).select("pos", "node").join(
            visited.select("pos", "node"), ["pos", "node"], "left_anti").withColumn("dist", F.lit(level))
        nxt = written(nxt, "closeness-level")
        new = nxt.count()
        if not new:
            break
        visited, found = visited.unionByName(nxt), found + new
        frontier = nxt
    agg = visited.groupBy("pos").agg(F.count(F.lit(1)).alias("reached"), F.sum("dist").alias("total_dist")).join(src, "pos")
    r = F.col("reached") - 1
    return agg.select(F.col("src").alias("username"), "reached", "total_dist",
                      r6(F.when(F.col("total_dist") > 0, r / F.col("total_dist") * r / F.lit(float(max(n - 1, 1))))
                         .otherwise(0.0)).alias("closeness"))


def betweenness_sampled(edges: DataFrame, n_sources: int = 16, seed: int = 7) -> DataFrame:
    """Betweenness from sampled sources (Brandes), unweighted.

    Forward: all sources advance one BFS level per pass over the edges, carrying σ (number of
    shortest paths). Backward: levels are processed from the deepest up,
    δ(v) = σ(v) · Σ_{w: v→w, d(w)=d(v)+1} (1 + δ(w))/σ(w). Betweenness(v) =
    Σ_sources δ(v); ``normalized`` = that · n/k / ((n−1)(n−2)) as networkx's
    sampled, normalized form. Exact when every node is a source."""
    from threadlens.functions.numeric import r6
    from threadlens.session import written
    und = _both_ways(edges)
    nodes = written(und.select(F.col("a").alias("node")).distinct(), "graph-nodes")
    n = nodes.count()
    src = _sources(nodes, n_sources, seed)
    k = src.count()
    lv = written(src.select("pos", F.col("src").alias("node"), F.lit(1.0).alias("sigma")), "betweenness-level")
    levels = [lv]
    visited, found = lv.select("pos", "node"), k
    while found < n * k:
        nxt = _around(und, levels[-1].withColumnRenamed("sigma", "value")).withColumnRenamed("value", "sigma")
        nxt = written(nxt.join(visited, ["pos", "node"], "left_anti").select("pos", "node", "sigma"), "betweenness-level")
        new = nxt.count()
        if not new:
            break
        levels.append(nxt)
        visited, found = visited.unionByName(nxt.select("pos", "node")), found + new
    delta = levels[-1].select("pos", "node", "sigma", F.lit(0.0).alias("delta"))
    parts = [delta]
    for L in range(len(levels) - 2, 0, -1):
        share = delta.select("pos", "node", ((1 + F.col("delta")) / F.col("sigma")).alias("value"))
        delta = written(levels[L].join(_around(und, share), ["pos", "node"], "left").select(
            "pos", "node", "sigma", F.coalesce(F.col("sigma") * F.col("value"), F.lit(0.0)).alias("delta")), "betweenness-delta")
        parts.append(delta)
    allp = parts[0]
    for p in parts[1:]:
        allp = allp.unionByName(p)
    bc = allp.groupBy(F.col("node").alias("username")).agg(F.sum("delta").alias("betweenness"))
    bc = nodes.withColumnRenamed("node", "username").join(bc, "username", "left").fillna(0.0, subset=["betweenness"])
    scale = (n / k) / ((n - 1) * (n - 2)) if n > 2 and k else 0.0
    return bc.select("username", r6("betweenness").alias("betweenness"),
                     r6(F.col("betweenness") * F.lit(scale)).alias("normalized"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node connected with each.

    Star contraction until nothing changes. A round ties every node's larger
    neighbours to the smallest node around it, then the smaller neighbours
    likewise; a chain of n nodes takes about log n rounds. Neighbours are
    aggregated (min), never gathered, so a hub costs one row per map task.
    """
    from threadlens.session import written
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
    ends = written(ends, "cc-input")
    nodes = ends.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    tied = written(ends.filter("x <> y").select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(),
                   "cc-ties")
    last = None
    while True:
        around = tied.unionAll(tied.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))   # (node, neighbour)
        centre = around.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        outer = (around.filter("lo > hi").join(centre, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                 .filter("hi <> lo").distinct())
        centre = outer.groupBy("hi").agg(F.min("lo").alias("m"))
        inner = (outer.join(centre, "hi").select(F.explode(F.array("hi", "lo")).alias("hi"), F.col("m").alias("lo"))
                 .filter("hi <> lo").distinct())
        tied = written(inner, "cc-ties")
        state = tied.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == last:
            return nodes.join(tied.select(F.col("hi").alias("node"), F.col("lo").alias("c")), "node", "left").select(
                "node", F.coalesce("c", "node").alias("component"))
        last = state


def merge_redundant_clusters(members: DataFrame, window: str, step_days: int, threshold: float) -> DataFrame:
    """Clusters of consecutive windows whose member Jaccard >= threshold
    are the same cluster; returns (window, cluster, merged) where ``merged``
    names the chain by its earliest (window, cluster)."""
    sz = members.groupBy(window, "cluster").agg(F.count(F.lit(1)).alias("n"))
    nxt = members.select((F.col(window) - F.make_dt_interval(days=F.lit(step_days))).alias(window),
                         F.col("cluster").alias("next_cluster"), "author")
    ov = members.join(nxt, [window, "author"]).groupBy(window, "cluster", "next_cluster").agg(
        F.count(F.lit(1)).alias("inter"))
    s2 = sz.select((F.col(window) - F.make_dt_interval(days=F.lit(step_days))).alias(window),
                   F.col("cluster").alias("next_cluster"), F.col("n").alias("n2"))
    j = (ov.join(sz, [window, "cluster"]).join(s2, [window, "next_cluster"])
         .withColumn("jac", F.col("inter") / (F.col("n") + F.col("n2") - F.col("inter")))
         .filter(F.col("jac") >= threshold))
    node = F.concat_ws("|", F.date_format(window, "yyyy-MM-dd HH:mm:ss"), "cluster")
    node2 = F.concat_ws("|", F.date_format(F.col(window) + F.make_dt_interval(days=F.lit(step_days)),
                                           "yyyy-MM-dd HH:mm:ss"), "next_cluster")
    e = j.select(node.alias("a"), node2.alias("b"))
    allnodes = sz.select(node.alias("node"), window, "cluster")
    cc = connected_components(e)
    out = allnodes.join(cc, "node", "left").withColumn("merged", F.coalesce("component", "node"))
    return out.select(window, "cluster", "merged")


def cluster_events(members: DataFrame, window: str, step_days: int, share: float) -> DataFrame:
    """J16 over time: what became of each cluster of (window, cluster, author) from one window to the next.

    Clusters of consecutive windows are the same line if they share at least ``share`` of the smaller
    one's members. Returns (window, cluster, n, n_before, n_after, came, went): how many lines lead to it
    and on from it; came is 'birth', 'merge' or 'goes on' (NULL in the first window), went 'death', 'split' or
    'goes on' (NULL in the last). NULL authors are no members; a gap of a window ends all lines."""
    m = members.select(window, "cluster", "author").where("author is not null").distinct()
    back = F.col(window) - F.make_dt_interval(days=F.lit(step_days))
    size = m.groupBy(window, "cluster").agg(F.count(F.lit(1)).alias("n"))
    later = m.select(back.alias(window), F.col("cluster").alias("next"), "author")
    both = m.join(later, [window, "author"]).groupBy(window, "cluster", "next").agg(F.count(F.lit(1)).alias("both"))
    sizes = size.select(back.alias(window), F.col("cluster").alias("next"), F.col("n").alias("n2"))
    lines = (both.join(size, [window, "cluster"]).join(sizes, [window, "next"])
             .where(F.col("both") >= F.lit(share) * F.least("n", "n2")))
    on = lines.groupBy(window, "cluster").agg(F.count(F.lit(1)).alias("n_after"))
    step = F.col(window) + F.make_dt_interval(days=F.lit(step_days))
    into = lines.groupBy(step.alias(window), F.col("next").alias("cluster")).agg(F.count(F.lit(1)).alias("n_before"))
    ends = size.agg(F.min(window).alias("a"), F.max(window).alias("b")).first()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    word = lambda c, none, many: F.when(F.col(c) == 0, none).when(F.col(c) > 1, many).otherwise("goes on")
    out = (size.join(into, [window, "cluster"], "left").join(on, [window, "cluster"], "left")
           .withColumn("n_before", zero("n_before")).withColumn("n_after", zero("n_after")))
    return out.select(window, "cluster", "n", "n_before", "n_after",
                      F.when(F.col(window) > F.lit(ends["a"]), word("n_before", "birth", "merge")).alias("came"),
                      F.when(F.col(window) < F.lit(ends["b"]), word("n_after", "death", "split")).alias("went"))


def overlap_clusters(members: DataFrame, cluster: str, member: str, share: float) -> DataFrame:
    """J19 by members: (cluster, n, meta). Two clusters are tied if they share at least ``share`` of the smaller
    one's members; meta names the tied ones by their smallest (as text). Pairs of clusters come from the tiled pair
    job with roles swapped, so a member of very many clusters is spread. NULLs are no members."""
    from threadlens.session import written
    m = written(members.select(F.col(cluster).cast("string").alias("username"), F.col(member).alias("post_id"))
                .where("username is not null and post_id is not null").distinct(), "overlap-members")
    size = m.groupBy("username").agg(F.count(F.lit(1)).alias("n"))
    pairs = shared_thread_pairs(m, 1)
    at = lambda c, n: size.select(F.col("username").alias(c), F.col("n").alias(n))
    ties = (pairs.join(at("user1", "n1"), "user1").join(at("user2", "n2"), "user2")
            .where(F.col("shared_interactions") >= F.lit(share) * F.least("n1", "n2")))
    found = connected_components(ties, "user1", "user2").select(F.col("node").alias("username"), "component")
    return size.join(found, "username", "left").select(
        F.col("username").alias("cluster"), "n", F.coalesce("component", "username").alias("meta"))
