"""Default models and their result tables.

Fits use ``pyspark.ml`` estimators (distributed gradient descent / tree
growing).  The split is a hash of the loan key, so it is reproducible, needs
no sort and is the same in SQL.  k-nearest-neighbours is exact but avoids
the all-pairs product: candidates come from an equi-join on the leaves of a
k-d tree whose bounding boxes lie within the k-th distance.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanpanel.operators.neighbors import tree_neighbors
from loanpanel.session import cut_lineage, ensure_checkpoint_dir

TEST_SIZE = 0.33
SEED = 7


# --------------------------------------------------------------------- K1

def hash_bucket(key: str | Column, seed: int = SEED) -> Column:
    """Stable 0..99 bucket of a key: first 32 bits of md5('<seed>-<key>') mod 100."""
    k = F.col(key) if isinstance(key, str) else key
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}-"), k.cast("string"))), 1, 8), 16, 10)
    return (h.cast("long") % 100).cast("int")


def train_test_split(df: DataFrame, key: str, test_size: float = TEST_SIZE, seed: int = SEED,
                     flag: str = "is_test") -> DataFrame:
    """K1: flag ``is_test`` for about ``test_size`` of the keys."""
    return df.withColumn(flag, hash_bucket(key, seed) < int(round(test_size * 100)))


# --------------------------------------------------------------------- K2-K4, K6, K7

def _assembled(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="skip").transform(df)


def fit_logistic(train: DataFrame, features: list[str], label: str, n_rows: int | None = None):
    """K2: logistic regression with the library defaults of the source
    (L2 penalty with C = 1, i.e. regParam = 1/n on Spark's mean loss)."""
    from pyspark.ml.classification import LogisticRegression
    data = _assembled(train, features).withColumn(label, F.col(label).cast("double"))
    n = n_rows or data.count()
    lr = LogisticRegression(featuresCol="features", labelCol=label, regParam=1.0 / max(n, 1),
                            elasticNetParam=0.0, standardization=False, maxIter=100)
    return lr.fit(data)


def fit_boosted(train: DataFrame, features: list[str], label: str, max_iter: int = 100,
                max_depth: int = 3, step_size: float = 0.1, seed: int = SEED):
    """K3: gradient-boosted trees (100 trees, depth 3, rate 0.1)."""
    from pyspark.ml.classification import GBTClassifier
    data = _assembled(train, features).withColumn(label, F.col(label).cast("double"))
    return GBTClassifier(featuresCol="features", labelCol=label, maxIter=max_iter, maxDepth=max_depth,
                         stepSize=step_size, seed=seed).fit(data)


def fit_forest(train: DataFrame, features: list[str], label: str, num_trees: int = 1000, seed: int = SEED):
    """K4: random forest of ``num_trees`` trees."""
    from pyspark.ml.classification import RandomForestClassifier
    data = _assembled(train, features).withColumn(label, F.col(label).cast("double"))
    return RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=num_trees,
                                  seed=seed).fit(data)


def _without_summary(model):
    """The fitted model without its training summary, read back as saved: the scoring function takes the whole
    model to the tasks, and the summary holds on to the training run (its tables, its session)."""
    if not getattr(model, "hasSummary", False):
        return model
    spark = _spark()
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    return type(model).load(path)


def predict(model, df: DataFrame, features: list[str], out: str = "Y_hat") -> DataFrame:
    """Predictions as an int column; the input columns are kept."""
    p = _without_summary(model).transform(_assembled(df, features))
    return p.withColumn(out, F.col("prediction").cast("int")) \
            .drop("features", "rawPrediction", "probability", "prediction")


def coefficient_table(model, features: list[str]) -> DataFrame:
    """K6: (feature, coefficient) plus the intercept."""
    spark = _spark()
    rows = [(f, float(c)) for f, c in zip(features, model.coefficients.toArray())]
    rows.append(("intercept", float(model.intercept)))
    return spark.createDataFrame(rows, "feature string, coefficient double")


def importance_table(model, features: list[str]) -> DataFrame:
    """K7: (feature, importance)."""
    spark = _spark()
    imp = model.featureImportances.toArray()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)],
                                 "feature string, importance double")


def _spark():
    from pyspark.sql import SparkSession
    return SparkSession.getActiveSession()


# --------------------------------------------------------------------- K8-K11

def residual_table(pred: DataFrame, label: str, y_hat: str = "Y_hat") -> DataFrame:
    """K8: ``falsePosPred``, ``falseNegPred``, ``match`` next to the prediction."""
    y, p = F.col(label), F.col(y_hat)
    return (pred.withColumn("falsePosPred", F.when((p == 1) & (y == 0), 1).otherwise(0))
                .withColumn("falseNegPred", F.when((p == 0) & (y == 1), 1).otherwise(0))
                .withColumn("match", p == y))


def result_shares(res: DataFrame, label: str, y_hat: str = "Y_hat") -> DataFrame:
    """K9: shares over all rows: match, true positive, false positive, false negative."""
    y, p = F.col(label), F.col(y_hat)
    return res.agg(F.avg(F.when(p == y, 1.0).otherwise(0.0)).alias("pct_match"),
                   F.avg(F.when((y == 1) & (p == 1), 1.0).otherwise(0.0)).alias("pct_true_pos"),
                   F.avg(F.col("falsePosPred").cast("double")).alias("pct_false_pos"),
                   F.avg(F.col("falseNegPred").cast("double")).alias("pct_false_neg"))


def confusion_counts(res: DataFrame, label: str, y_hat: str = "Y_hat") -> DataFrame:
    """K10 (F11): N, matches, TP, TN, FP, FN."""
    y, p = F.col(label), F.col(y_hat)
    return res.agg(F.count(F.lit(1)).alias("n"),
                   F.count(F.when(p == y, True)).alias("matches"),
                   F.count(F.when((y == 1) & (p == 1), True)).alias("tp"),
                   F.count(F.when((y == 0) & (p == 0), True)).alias("tn"),
                   F.count(F.when((y == 0) & (p == 1), True)).alias("fp"),
                   F.count(F.when((y == 1) & (p == 0), True)).alias("fn"))


def prediction_export(res: DataFrame, key: str, label: str, y_hat: str = "Y_hat") -> DataFrame:
    """Key, truth, prediction."""
    return res.select(key, F.col(label).alias("test_y"), F.col(y_hat).alias("predictedValue"))


# --------------------------------------------------------------------- K5: exact k-NN

def dedupe_for_knn(tr: DataFrame, feats: list[str], k: int, salts: int = 64) -> DataFrame:
    """Keep, for every distinct feature vector, its ``k`` smallest training keys.

    Identical points are tied for every query and ties go to the smaller key,
    so no other copy can ever enter a top-k: the reduction is exact.  It is a
    two-level top-k, first per (vector, salt) and then per vector over at
    most ``salts * k`` survivors, so a heavily duplicated vector is spread
    over many tasks."""
    salt = F.pmod(F.xxhash64("t_key"), F.lit(salts))
    w1 = Window.partitionBy(*feats, "__salt").orderBy("t_key")
    w2 = Window.partitionBy(*feats).orderBy("t_key")
    first = (tr.withColumn("__salt", salt).withColumn("__r", F.row_number().over(w1))
               .where(F.col("__r") <= k).drop("__salt", "__r"))
    return first.withColumn("__r", F.row_number().over(w2)).where(F.col("__r") <= k).drop("__r")


def knn_neighbors(train: DataFrame, test: DataFrame, key: str, features: list[str], label: str,
                  k: int = 10, per_bucket: int = 64) -> DataFrame:
    """Exact ``k`` nearest training rows (Euclidean, ties by training key) of
    every test row -> (test key, rank, neighbour key, neighbour label, sqdist).

    The training rows are dealt to the leaves (of about ``per_bucket`` rows) of a
    k-d tree; a test row only meets the leaves whose bounding box is within its
    k-th distance (see :mod:`loanpanel.operators.neighbors`).  Copies of a training
    point beyond its k smallest keys are dropped first (exactly; see
    :func:`dedupe_for_knn`).  Rows with a NULL or NaN feature take no part."""
    feats = list(features)
    tr = train.select(F.col(key).alias("t_key"), F.col(label).alias("t_label"),
                      *[F.col(f).cast("double").alias(f) for f in feats]).dropna()
    te = test.select(F.col(key).alias("q_key"), *[F.col(f).cast("double").alias(f) for f in feats]).dropna()
    return tree_neighbors(cut_lineage(dedupe_for_knn(tr, feats, k)), te, feats, k, per_bucket)


def knn_predictions(neigh: DataFrame, ks: Iterable[int] = range(1, 11)) -> DataFrame:
    """Majority vote of the first k neighbours for every k (ties -> the
    smaller class, 0) -> one row per test key with ``pred_<k>``."""
    ks = list(ks)
    agg = neigh.groupBy("q_key").agg(*[
        F.sum(F.when(F.col("rank") <= kk, F.col("t_label")).otherwise(0)).alias(f"ones_{kk}") for kk in ks])
    return agg.select("q_key", *[F.when(F.col(f"ones_{kk}") * 2 > kk, 1).otherwise(0).alias(f"pred_{kk}")
                                 for kk in ks])


def knn_accuracy(neigh: DataFrame, test: DataFrame, key: str, label: str,
                 ks: Iterable[int] = range(1, 11)) -> DataFrame:
    """K5: accuracy of the k-NN vote for every k -> (k, accuracy)."""
    ks = list(ks)
    pred = knn_predictions(neigh, ks).join(test.select(F.col(key).alias("q_key"), F.col(label).alias("y")),
                                           "q_key")
    wide = pred.agg(*[F.avg(F.when(F.col(f"pred_{kk}") == F.col("y"), 1.0).otherwise(0.0)).alias(f"a_{kk}")
                      for kk in ks])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(kk).alias("k"), F.col(f"a_{kk}").alias("accuracy"))
                                           for kk in ks])).alias("s")).select("s.k", "s.accuracy")
