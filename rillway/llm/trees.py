"""Decision trees trained by Spark ML, as nested tuples and as SQL expressions."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (feature, threshold, tree where value <= threshold, tree where it is larger), or the prediction of a leaf.
Tree = tuple | float


def nested(node) -> Tree:
    if not node.getClass().getSimpleName().startswith("Internal"):
        return float(node.prediction())
    split = node.split()
    left, right = nested(node.leftChild()), nested(node.rightChild())
    return left if left == right else (split.featureIndex(), split.threshold(), left, right)


def assembled(rows: DataFrame, features: list[str]) -> DataFrame:
    rows = rows.select(*[F.col(f).cast("double").alias(f) for f in features], F.col("label").cast("double").alias("label"))
    return VectorAssembler(inputCols=features, outputCol="features").transform(rows.coalesce(1)).select("features", "label")


def decision_tree(rows: DataFrame, features: list[str], depth: int) -> Tree:
    """A tree fitted to a small table of features and label (0 or 1)."""
    fit = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=3, maxBins=64, seed=1)
    return nested(fit.fit(assembled(rows, features))._java_obj.rootNode())


def boosted_trees(rows: DataFrame, features: list[str], rounds: int, depth: int) -> list[tuple[float, Tree]]:
    """(weight, tree) of a boosted ensemble fitted to a small table; the weighted sum of its trees is the margin."""
    fit = GBTClassifier(maxDepth=depth, maxIter=rounds, stepSize=0.3, maxBins=64, seed=1)
    model = fit.fit(assembled(rows, features))._java_obj
    return [(w, nested(t.rootNode())) for w, t in zip(list(model.treeWeights()), list(model.trees()))]


def decide(tree: Tree, values) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if values[tree[0]] <= tree[1] else tree[3]
    return tree


def tree_column(tree: Tree, columns: list[Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    feature, threshold, left, right = tree
    return F.when(columns[feature] <= threshold, tree_column(left, columns)).otherwise(tree_column(right, columns))


def margin(trees: list[tuple[float, Tree]], columns: list[Column]) -> Column:
    return sum((F.lit(w) * tree_column(t, columns) for w, t in trees), F.lit(0.0))
