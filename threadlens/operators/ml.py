"""Features, clustering and anomaly models (inventory K1–K23).

Spark ML estimators where Spark has them (PCA, KMeans, RandomForest, GBT,
LinearRegression, ClusteringEvaluator); the isolation forest, which Spark ML
lacks, is built from DataFrame pieces: each tree is grown from a bounded
sample (≤ 256 rows) in its own ``applyInPandas`` group, the forest (a few
thousand nodes) is broadcast, and rows are scored by an Arrow-batched pandas
UDF. Nothing grows with the data except the scoring pass, which is narrow.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.functions.numeric import r6
from threadlens.operators.knn import knn_distance


# ------------------------------------------------------------------ K2
def standardize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """K2: (x − mean) / population std per column; a zero-variance column is
    only centred (std treated as 1), as scikit-learn's StandardScaler."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    out = df
    for c in cols:
        m, s = row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 0.0
        out = out.withColumn(c, (F.col(c) - F.lit(m)) / F.lit(s if s > 0 else 1.0))
    return out


# ------------------------------------------------------------ K3–K5, K17
def cluster_posts(features: DataFrame, id_col: str = "post_id", k: int = 5, dims: int = 10,
                  seed: int = 42) -> tuple[DataFrame, PipelineModel]:
    """K5: standardise → PCA to min(dims, d) components (the linear form of the
    autoencoder's 10-d code) → KMeans(k, seed). Returns rows
    (id, code, cluster, score) and the fitted pipeline with its scaler (K23:
    saved, loaded and used on new rows)."""
    from threadlens.session import written
    feats = [c for c in features.columns if c != id_col]
    features = written(features.fillna(0.0, subset=feats), "cluster-features")   # iterative fits re-read their input
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=feats, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=True),
        PCA(k=min(dims, len(feats)), inputCol="x", outputCol="code"),
        KMeans(k=k, seed=seed, featuresCol="code", predictionCol="cluster"),
    ])
    model = pipe.fit(features)
    score = "score" if "score" in features.columns else feats[0]
    return model.transform(features).select(id_col, "code", "cluster", score), model


def assign_clusters(features: DataFrame, model: PipelineModel, id_col: str = "post_id") -> DataFrame:
    """(id, cluster) of rows by a fitted pipeline; scaling is the model's own."""
    feats = [c for c in features.columns if c != id_col]
    return model.transform(features.fillna(0.0, subset=feats)).select(id_col, "cluster")


def silhouette(clustered: DataFrame, features: str = "code", prediction: str = "cluster") -> float:
    """Squared-Euclidean silhouette of a clustering."""
    return ClusteringEvaluator(featuresCol=features, predictionCol=prediction).evaluate(clustered)


# ------------------------------------------------------------------ K12, K8
def pca_model(df: DataFrame, vec: str, k: int):
    return PCA(k=k, inputCol=vec, outputCol="pc").fit(df)


def reconstruction_error(df: DataFrame, vec: str, k: int, pct: float = 0.95) -> DataFrame:
    """K8: distance of each centred vector to its projection on the first k
    principal components; rows above the ``pct`` quantile are anomalies. The
    residual is a numpy product per Arrow batch (components broadcast, d × k).
    Rows whose vector is NULL or holds NaN or infinity have no error and are no anomalies."""
    from threadlens.operators.quantiles import exact_quantiles
    from threadlens.session import cut_lineage
    every = df.withColumn("_a", F.when(F.col(vec).isNotNull(), vector_to_array(F.col(vec))))
    fine = F.coalesce(F.forall("_a", lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    arr, rest = every.filter(fine), every.filter(~fine).drop("_a").select(
        "*", F.lit(None).cast("double").alias("recon_error"), F.lit(0).alias("is_anomaly"))
    if arr.isEmpty():
        return rest
    model = pca_model(arr, vec, k)
    comps = model.pc.toArray()
    d = comps.shape[0]
    mean = np.array(arr.agg(F.array(*[F.avg(F.col("_a")[i]) for i in range(d)])).first()[0], dtype=float)
    bc = df.sparkSession.sparkContext.broadcast((comps, mean))

    @F.pandas_udf(T.DoubleType())
    def resid(a: pd.Series) -> pd.Series:
        v, mu = bc.value
        x = np.vstack(a.to_numpy()).astype(float) - mu
        p = x @ v
        return pd.Series(np.sqrt(np.maximum((x * x).sum(axis=1) - (p * p).sum(axis=1), 0.0)))

    out = cut_lineage(arr.withColumn("recon_error", resid(F.col("_a"))).drop("_a"))
    cut = exact_quantiles(out, [], "recon_error", [pct], ["cut"]).first()["cut"]
    return out.withColumn("is_anomaly", (F.col("recon_error") > F.lit(cut)).cast("int")).unionByName(rest)


# --------------------------------------------------------- K6 / K7 forest
def _grow_tree(x: np.ndarray, rng: np.random.Generator, limit: int) -> list:
    """Isolation tree as a flat node list: (feature, split, left, right, size)."""
    nodes = []

    def build(rows, depth):
        idx = len(nodes)
        nodes.append(None)
        if depth >= limit or len(rows) <= 1:
            nodes[idx] = (-1, 0.0, -1, -1, len(rows))
            return idx
        lo, hi = rows.min(axis=0), rows.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if len(cand) == 0:
            nodes[idx] = (-1, 0.0, -1, -1, len(rows))
            return idx
        f = int(rng.choice(cand))
        s = float(rng.uniform(lo[f], hi[f]))
        left = build(rows[rows[:, f] < s], depth + 1)
        right = build(rows[rows[:, f] >= s], depth + 1)
        nodes[idx] = (f, s, left, right, len(rows))
        return idx

    build(x, 0)
    return nodes


def _c(n: float) -> float:
    """Average path length of an unsuccessful search in a BST of n nodes."""
    if n <= 1:
        return 0.0
    return 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n


def isolation_forest(df: DataFrame, id_col: str, features: Sequence[str], n_trees: int = 100,
                     sample: int = 256, contamination: float = 0.05, seed: int = 42,
                     group: str | None = None) -> DataFrame:
    """K6 (global) / K7 (per ``group``): anomaly score s = 2^(−E[h]/c(ψ)) and
    is_anomaly = 1 for the top ``contamination`` share of scores per group.

    Training sample per (group, tree): the ``sample`` rows with the smallest
    hash of (tree, id) — a WindowGroupLimit top-k, so each group sends at most
    ``sample`` rows per map task. Trees are grown in ``applyInPandas`` per
    (group, tree). Groups smaller than 2·sample keep their rows, with a NULL
    score and is_anomaly 0. Scoring meets each group's trees with slices of at
    most ~20,000 of its rows; nothing goes through the driver."""
    from threadlens.operators.quantiles import exact_quantiles
    from threadlens.session import ship_package, written
    ship_package(df.sparkSession)
    feats = list(features)
    # Groups by a text that is never NULL, so that rows without a group are one group.
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")) if group else F.lit("")
    named = df.select(g.alias("_g"), F.col(group).alias("_name")).distinct() if group else None
    x = df.select(g.alias("_g"), id_col, *feats)
    sizes = x.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    small = x.join(sizes.filter(F.col("_n") < 2 * sample).select("_g"), "_g", "left_semi")
    sizes = sizes.filter(F.col("_n") >= 2 * sample)
    # Row r enters tree t's candidate pool when u(t, r) < p_g, with u a hash
    # uniform in [0, 1) and p_g = min(1, 4·sample / n_g): about 4·sample
    # candidates per (group, tree), and each row is copied only for the few
    # trees that pick it. The `sample` smallest u per (group, tree) form the
    # tree's sample (a partial top-k before the shuffle).
    x = x.join(sizes.select("_g", F.least(F.lit(1.0), F.lit(4.0 * sample) / F.col("_n")).alias("_p"),
                            F.ceil(F.col("_n") / F.lit(20_000)).cast("int").alias("_k")), "_g")

    def u(t):
        h = F.xxhash64(t, F.col(id_col), F.lit(seed)).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))
        return h.cast("double") / F.lit(2.0 ** 63)

    picked = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)), lambda t: u(t) < F.col("_p"))
    cand = x.select("_g", id_col, *feats, F.explode(picked).alias("_t"))
    from threadlens.operators.engagement import top_per_group
    cand = cand.withColumn("_h", F.xxhash64(F.col("_t"), F.col(id_col), F.lit(seed)))
    smp = top_per_group(cand, ["_g", "_t"], [F.col("_h")], sample, "_r").drop("_r", "_h")
    limit = int(math.ceil(math.log2(sample)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["_t"].iloc[0])
        rng = np.random.default_rng(seed * 100003 + t)
        nodes = _grow_tree(pdf[feats].to_numpy(dtype=float), rng, limit)
        return pd.DataFrame({"_g": pdf["_g"].iloc[0], "_t": t, "node": list(range(len(nodes))),
                             "f": [n[0] for n in nodes], "s": [n[1] for n in nodes], "l": [n[2] for n in nodes],
                             "r": [n[3] for n in nodes], "size": [n[4] for n in nodes]})

    gtype = x.schema["_g"].dataType.simpleString()
    forest = smp.groupBy("_g", "_t").applyInPandas(
        grow, f"_g {gtype}, _t int, node int, f int, s double, l int, r int, size int")
    slices = x.select("_g", "_k").distinct().select("_g", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_s"))
    forest = forest.join(slices, "_g")
    x = x.withColumn("_s", F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.col("_k")).cast("int"))
    cpsi = _c(sample)

    def score(rows: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        xs = rows[feats].to_numpy(dtype=float)
        depth, at = np.zeros(len(xs)), np.arange(len(xs))
        for _, tp in trees.groupby("_t"):
            tp = tp.sort_values("node")
            f, s, l, r = (tp[c].to_numpy() for c in ("f", "s", "l", "r"))
            rest = np.array([_c(v) for v in tp["size"]])
            node = np.zeros(len(xs), dtype=int)
            while (f[node] >= 0).any():
                inner = f[node] >= 0
                go_left = xs[at, np.maximum(f[node], 0)] < s[node]
                node = np.where(inner, np.where(go_left, l[node], r[node]), node)
                depth += inner
            depth += rest[node]
        mean = depth / max(trees["_t"].nunique(), 1)
        return pd.DataFrame({"_g": rows["_g"], id_col: rows[id_col], "anomaly_score": np.power(2.0, -mean / cpsi)})

    idtype = x.schema[id_col].dataType.simpleString()
    scored = written(x.groupBy("_g", "_s").cogroup(forest.groupBy("_g", "_s")).applyInPandas(
        score, f"_g {gtype}, {id_col} {idtype}, anomaly_score double"), "forest-scores")
    cut = exact_quantiles(scored, ["_g"], "anomaly_score", [1.0 - contamination], ["_cut"])
    res = scored.join(cut.select("_g", "_cut"), "_g").withColumn(
        "is_anomaly", (F.col("anomaly_score") > F.col("_cut")).cast("int"))
    unscored = small.select("_g", id_col, F.lit(None).cast("double").alias("anomaly_score"), F.lit(0).alias("is_anomaly"))
    res = res.select(*unscored.columns).unionByName(unscored)
    if group:
        res = res.join(named, "_g")
    cols = ([F.col("_name").alias(group)] if group else []) + [id_col, r6("anomaly_score").alias("anomaly_score"),
                                                                "is_anomaly"]
    return res.select(*cols)


# ------------------------------------------------------------------ K9
def seasonal_residual_anomalies(series: DataFrame, day: str, col: str, k: float = 2.0) -> DataFrame:
    """K9: fit x ~ trend + weekly Fourier terms (LinearRegression), flag days
    whose |residual| exceeds k·σ of the residuals."""
    t = F.timestamp_diff("DAY", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(day)).cast("double")
    x = series.withColumn("_t", t)
    for h in (1, 2):
        x = (x.withColumn(f"_s{h}", F.sin(F.lit(2 * math.pi * h / 7) * F.col("_t")))
             .withColumn(f"_c{h}", F.cos(F.lit(2 * math.pi * h / 7) * F.col("_t"))))
    va = VectorAssembler(inputCols=["_t", "_s1", "_c1", "_s2", "_c2"], outputCol="_x")
    xa = va.transform(x.withColumn("_y", F.col(col).cast("double")))
    lr = LinearRegression(featuresCol="_x", labelCol="_y", predictionCol="_yhat").fit(xa)
    p = lr.transform(xa).withColumn("residual", F.col("_y") - F.col("_yhat"))
    sd = p.agg(F.stddev_samp("residual")).first()[0] or 0.0
    return (p.select(*series.columns, r6("_yhat").alias("expected"), r6("residual").alias("residual"))
            .withColumn("is_anomaly", (F.abs(F.col("residual")) > F.lit(k * sd)).cast("int")))


# ------------------------------------------------------------------ K16
def ensemble_vote(flags: Sequence[tuple[DataFrame, str]], key: Sequence[str], min_votes: int = 1) -> DataFrame:
    """(key, votes) of the keys with at least ``min_votes``, where votes is the sum
    of the 0/1 flags of any number of (table, flag column). A key that a table doesn't
    have, or has with a NULL flag, gets no vote from it."""
    key = list(key)
    each = [t.select(*key, F.coalesce(F.col(c).cast("int"), F.lit(0)).alias("_f")) for t, c in flags]
    votes = reduce(DataFrame.unionByName, each).groupBy(*key).agg(F.sum("_f").cast("int").alias("votes"))
    return votes.filter(F.col("votes") >= min_votes)


def detector_flags(features: DataFrame, day: str, total: str, cols: Sequence[str], dims: int = 2,
                   seed: int = 42) -> list[tuple[DataFrame, str]]:
    """The flags of E14, K6, K8, K9 and K10 on one feature table with a row per ``day``:
    z-score and seasonal residual of ``total``; isolation forest, reconstruction error by
    ``dims`` components and 5-nearest-neighbour distance (above its 95 % quantile) of ``cols``."""
    from threadlens.operators.quantiles import exact_quantiles
    from threadlens.operators.timeseries import zscore_flags
    from threadlens.session import written
    features = written(features, "vote-features")    # five detectors read it
    arr = features.withColumn("_x", F.array(*[F.col(c).cast("double") for c in cols]))
    knn = written(knn_distance(arr, day, "_x", k=5), "vote-knn")
    cut = exact_quantiles(knn, [], "knn5_distance", [0.95], ["cut"]).first()
    cut = F.lit(cut["cut"] if cut else None).cast("double")
    return [
        (zscore_flags(features, total, 2.0), "is_anomaly"),
        (isolation_forest(features, day, cols, n_trees=50, sample=128, seed=seed), "is_anomaly"),
        (reconstruction_error(vectors(arr, "_x"), "features", dims), "is_anomaly"),
        (seasonal_residual_anomalies(features, day, total, 2.0), "is_anomaly"),
        (knn.withColumn("is_anomaly", (F.col("knn5_distance") > cut).cast("int")), "is_anomaly"),
    ]


# ----------------------------------------------------------- K11, K13–K15
def average_ranks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Each column replaced by its rank; equal values share their mean rank."""
    from threadlens.operators.quantiles import ranked_values
    out = df
    for c in cols:
        r = ranked_values(df, [], c).select(F.col("_v").alias(c), (F.col("_first") + (F.col("_m") - 1) / 2).alias("_r"))
        out = out.join(r, c, "left").drop(c).withColumnRenamed("_r", c)
    return out


def correlation_long(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> DataFrame:
    """Pearson or Spearman (Pearson of the average ranks) correlation of every
    column pair in one aggregation pass, as long rows (a, b, corr)."""
    if method == "spearman":
        df = average_ranks(df.select(*cols), cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs]).first()
    spark = df.sparkSession
    return spark.createDataFrame([(a, b, None if row[f"{a}__{b}"] is None else float(row[f"{a}__{b}"]))
                                  for a, b in pairs], "a string, b string, corr double").withColumn(
        "corr", r6("corr"))


def feature_importance(df: DataFrame, vec: str, label: str, method: str = "rf", seed: int = 42,
                       n_trees: int = 50) -> DataFrame:
    """K13 (random forest) / K15 (gradient-boosted trees, binary labels):
    (feature index, importance)."""
    if method == "gbt":
        m = GBTClassifier(featuresCol=vec, labelCol=label, seed=seed, maxIter=20).fit(df)
    else:
        m = RandomForestClassifier(featuresCol=vec, labelCol=label, seed=seed, numTrees=n_trees).fit(df)
    imp = m.featureImportances.toArray()
    return df.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(imp)],
                                           "feature int, importance double")


def recursive_elimination(df: DataFrame, vec: str, label: str, keep: int = 20, step: float = 0.25,
                          seed: int = 42) -> list[int]:
    """Repeatedly fit a forest and drop the least important quarter of
    the remaining features until ``keep`` remain; returns kept indexes."""
    from pyspark.ml.feature import VectorSlicer
    idx = list(range(len(df.select(vec).first()[0])))
    while len(idx) > keep:
        sl = VectorSlicer(inputCol=vec, outputCol="_v", indices=idx).transform(df)
        imp = feature_importance(sl, "_v", label, seed=seed).orderBy("importance", "feature").collect()
        drop = max(1, min(len(idx) - keep, int(len(idx) * step)))
        gone = {idx[r["feature"]] for r in imp[:drop]}
        idx = [i for i in idx if i not in gone]
    return idx


def elimination_by_score(df: DataFrame, vec: str, label: str, id_col: str, folds: int = 3, step: float = 0.25,
                         least: int = 1, n_trees: int = 20, seed: int = 42) -> DataFrame:
    """K14 with cross-validation: (n_features, features, f1, chosen), one row for each set of features on the way
    from all to ``least`` by dropping the least important quarter. A set's score is the mean weighted F1 of a
    forest over ``folds`` folds (a hash of ``id_col``, so reruns agree); chosen is 1 for the smallest set
    whose score is the best. Importances come from a forest on all rows."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import VectorSlicer
    from threadlens.session import written
    rows = written(df.select(F.col(vec).alias("_all"), F.col(label).cast("double").alias("_y"),
                             F.xxhash64(F.col(id_col), F.lit(seed)).alias("_hash"))
                   .where("_all is not null and _y is not null")
                   .withColumn("_fold", F.pmod("_hash", F.lit(folds))), "elimination")
    # A forest draws rows by partition and place, and files come back in no fixed order, so rows get a place of their own.
    rows = rows.repartition(1 + rows.count() // 20_000, "_hash").sortWithinPartitions("_hash", "_y", F.hash("_all"))
    judge = MulticlassClassificationEvaluator(labelCol="_y", predictionCol="prediction", metricName="f1")
    idx, told = list(range(len(rows.select("_all").first()[0]))), []
    while True:
        x = VectorSlicer(inputCol="_all", outputCol="_v", indices=idx).transform(rows)
        forest = RandomForestClassifier(featuresCol="_v", labelCol="_y", seed=seed, numTrees=n_trees)
        scores = [judge.evaluate(forest.fit(x.where(F.col("_fold") != f)).transform(x.where(F.col("_fold") == f)))
                  for f in range(folds)]
        told.append((len(idx), list(idx), round(float(np.mean(scores)), 6)))
        if len(idx) <= least:
            break
        importance = forest.fit(x).featureImportances.toArray()
        order = sorted(range(len(idx)), key=lambda i: (importance[i], i))
        gone = {idx[i] for i in order[:max(1, min(len(idx) - least, int(len(idx) * step)))]}
        idx = [i for i in idx if i not in gone]
    best = min((t for t in told if t[2] == max(s for _, _, s in told)), key=lambda t: t[0])
    return df.sparkSession.createDataFrame([(n, f, s, int(n == best[0])) for n, f, s in told],
                                           "n_features int, features array<int>, f1 double, chosen int")


def vectors(df: DataFrame, arr: str, out: str = "features") -> DataFrame:
    """A vector column from an array; a NULL array stays NULL, NULL elements are NaN."""
    full = F.transform(F.col(arr).cast("array<double>"), lambda x: F.coalesce(x, F.lit(float("nan"))))
    return df.withColumn(out, F.when(F.col(arr).isNotNull(), array_to_vector(full)))


def meta_clusters(features: DataFrame, id_col: str, cols: Sequence[str], k: int = 2, seed: int = 42) -> DataFrame:
    """Cluster the clusters — standardised cluster features →
    BisectingKMeans(k) → (cluster id, meta_cluster)."""
    from pyspark.ml.clustering import BisectingKMeans
    x = VectorAssembler(inputCols=list(cols), outputCol="f").transform(standardize(features, cols))
    m = BisectingKMeans(k=k, seed=seed, featuresCol="f", predictionCol="meta_cluster").fit(x)
    return m.transform(x).select(id_col, "meta_cluster")
