"""Fitted models as SQL: scoring without the model object (K2-K4, K8).

A logistic model becomes its linear form, a tree a nested CASE, an ensemble the sum of its trees.  The text
uses only what Spark SQL and other engines share, so a table can be scored by ``F.expr`` in one projection
inside whole-stage codegen, or where no Spark runs.  The text grows with the model, not with the data.

A row with a NULL or NaN feature has no prediction (the fitted models leave such rows out).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanpanel.session import ensure_checkpoint_dir


def _number(x: float) -> str:
    """A double literal that reads back as the same double (a plain decimal would be a DECIMAL)."""
    return f"({float(x):.17e})"


def _quoted(name: str, quote: str) -> str:
    return f"cast({quote}{name.replace(quote, quote * 2)}{quote} as double)"


def _guarded(expr: str, columns: list[str]) -> str:
    missing = " or ".join(f"{c} is null or {c} = cast('NaN' as double)" for c in columns)
    return f"case when {missing} then null else {expr} end"


def _nodes(model) -> dict[int, dict[int, object]]:
    """Nodes of every tree of a fitted ensemble by tree and id, read from the model as it is saved."""
    from pyspark.sql import SparkSession
    spark = SparkSession.active()
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    trees: dict[int, dict[int, object]] = {}
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():   # the model's own size
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    return trees


def _tree(nodes: dict[int, object], leaf, columns: list[str], at: int = 0) -> str:
    n = nodes[at]
    if n["leftChild"] < 0:
        return _number(leaf(n))
    split = n["split"]
    if split["numCategories"] != -1:
        raise ValueError("categorical splits are not supported")
    test = f"{columns[split['featureIndex']]} <= {_number(split['leftCategoriesOrThreshold'][0])}"
    left, right = (_tree(nodes, leaf, columns, n[k]) for k in ("leftChild", "rightChild"))
    return f"case when {test} then {left} else {right} end"


def _share_of_one(node) -> float:
    """Share of label 1 among a leaf's training rows: its vote in a forest of two classes."""
    stats = node["impurityStats"]
    if len(stats) != 2:
        raise ValueError("a forest of two classes is expected")
    return stats[1] / sum(stats)


def margin_sql(model, features: Iterable[str], quote: str = "`") -> str:
    """The number a model decides by, as SQL over the feature columns: the linear form of a logistic model, the
    weighted sum of boosted trees, the mean vote for label 1 of a forest.  ``quote`` is the engine's sign
    around names."""
    columns = [_quoted(f, quote) for f in features]
    kind = type(model).__name__
    if kind == "LogisticRegressionModel":
        terms = [f"{_number(w)} * {c}" for w, c in zip(model.coefficients.toArray(), columns)]
        body = " + ".join([*terms, _number(model.intercept)])
    elif kind in ("GBTClassificationModel", "RandomForestClassificationModel"):
        boosted = kind.startswith("GBT")
        leaf = (lambda n: n["prediction"]) if boosted else _share_of_one
        trees, weights = _nodes(model), model.treeWeights
        terms = [f"{_number(weights[t])} * ({_tree(trees[t], leaf, columns)})" for t in sorted(trees)]
        body = " + ".join(terms)
        if not boosted:
            body = f"({body}) / {_number(sum(weights))}"
    else:
        raise ValueError(f"no SQL form for {kind}")
    return _guarded(body, columns)


def prediction_sql(model, features: Iterable[str], quote: str = "`") -> str:
    """The predicted label (0 or 1) as SQL."""
    least = 0.5 if type(model).__name__ == "RandomForestClassificationModel" else 0.0
    margin = margin_sql(model, list(features), quote)
    return f"case when ({margin}) > {_number(least)} then 1 when ({margin}) <= {_number(least)} then 0 end"


def predict_by_sql(model, df: DataFrame, features: Iterable[str], out: str = "Y_hat") -> DataFrame:
    """``df`` with the prediction as an int column, in one projection; rows without one (a NULL or NaN feature)
    are left out, as the fitted model does."""
    scored = df.withColumn(out, F.expr(prediction_sql(model, list(features))).cast("int"))
    return scored.where(F.col(out).isNotNull())
