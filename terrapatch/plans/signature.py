"""Spatial signatures: metrics of landscapes as a matrix, its components, and clusters of landscapes."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrapatch import settings
from terrapatch.operators.shared import written
from terrapatch.plans.landscape import Landscape


def matrix(landscape: Landscape, class_metrics=None, landscape_metrics=None, classes=None, fillna: bool = False, class_metrics_kwargs=None, landscape_metrics_kwargs=None) -> DataFrame:
    """A row for each landscape: columns metric_class for class metrics (NULL where the class is absent), then landscape metrics."""
    if not class_metrics and not landscape_metrics:
        raise ValueError("at least one metric must be given")
    keys, out = landscape.keys, None
    if class_metrics:
        if classes is None:  # the columns of a pivot: as many as there are classes
            classes = sorted(r[0] for r in landscape.classes().collect())
        frame = landscape.class_metrics_df(class_metrics, classes, class_metrics_kwargs, fillna)
        cells = [F.max(F.when(F.col("class_val") == c, F.col(m))).alias(f"{m}_{c}") for m in class_metrics for c in classes]
        out = frame.groupBy(*keys).agg(*cells)
    if landscape_metrics:
        whole = landscape.landscape_metrics_df(landscape_metrics, landscape_metrics_kwargs)
        out = whole if out is None else out.join(whole, keys, "full")
    return out


class SpatialSignatureAnalysis:
    def __init__(self, landscape: Landscape, **options):
        self.keys = landscape.keys
        self.metrics_df = written(matrix(landscape, **options), "signature")  # scaling, components and clusters read it again and again
        self.names = [c for c in self.metrics_df.columns if c not in self.keys]

    def scaled(self, preprocess: bool = True, impute: bool = False) -> DataFrame:
        """Columns centred and divided by their population deviation; then missing values become the mean, or their rows go with a warning."""
        df = self.metrics_df
        if preprocess:
            m = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(self.names)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(self.names))).first()
            df = df.select(*self.keys, *(((F.col(c) - F.lit(m[f"m{i}"])) / F.lit(m[f"s{i}"] or 1.0)).alias(c) for i, c in enumerate(self.names)))
        if impute:
            m = df.agg(*(F.avg(c).alias(c) for c in self.names)).first()
            return df.na.fill({c: m[c] or 0.0 for c in self.names})
        if df.where(" OR ".join(f"`{c}` IS NULL OR isnan(`{c}`)" for c in self.names)).limit(1).count():
            warnings.warn("rows with missing values are dropped", RuntimeWarning, stacklevel=2)
        return df.na.drop(subset=self.names)

    def decompose(self, n_components: int | None = None, preprocess: bool = True, impute: bool = False, decomposer=None) -> DataFrame:
        """Scores on the principal components (signs are arbitrary), or on what another estimator of vectors makes of the matrix."""
        df = self.scaled(preprocess, impute)
        mean = df.agg(*(F.avg(c).alias(c) for c in self.names)).first()
        centred = df.select(*self.keys, *((F.col(c) - F.lit(mean[c] or 0.0)).alias(c) for c in self.names))
        k = min(n_components or len(self.names), len(self.names))
        if n_components is None:
            k = max(1, min(k, df.count()))
        vectors = VectorAssembler(inputCols=self.names, outputCol="v").transform(centred)
        self.model = (decomposer or PCA(k=k)).copy().setInputCol("v").setOutputCol("p").fit(vectors)
        scores = self.model.transform(vectors).withColumn("p", vector_to_array("p"))
        if decomposer is not None:
            first = scores.select(F.size("p")).first()
            k = first[0] if first else 0
        return scores.select(*self.keys, *(F.col("p")[i].alias(f"component_{i}") for i in range(k)))

    def loadings(self) -> DataFrame:
        """Weights of the metrics on the components of the last decomposition."""
        pc = np.array(self.model.pc.toArray())
        rows = [(m, *map(float, pc[i])) for i, m in enumerate(self.names)]
        return self.metrics_df.sparkSession.createDataFrame(rows, ["metric", *(f"component_{i}" for i in range(pc.shape[1]))])

    def clusters(self, k_range=settings.K_RANGE, method: str = "kmeans", decompose: bool = False, seed: int = 0, **options) -> DataFrame:
        """Keys and, for every k, the cluster of each landscape as column k_<k>. Where fewer landscapes differ than k, there are as many clusters as those."""
        df = self.decompose(**options) if decompose else self.scaled(**options)
        names = [c for c in df.columns if c not in self.keys]
        df = written(df, "signature")  # each fit reads it several times
        out = VectorAssembler(inputCols=names, outputCol="features").transform(df).select(*self.keys, "features")
        most = df.select(*names).distinct().count()
        for k in k_range:
            if min(k, most) < 2:
                out = out.withColumn(f"k_{k}", F.lit(0))
                continue
            kind = {"kmeans": KMeans, "gmm": GaussianMixture}[method]
            out = kind(k=min(k, most), seed=seed, predictionCol=f"k_{k}", featuresCol="features", **({"probabilityCol": f"p_{k}"} if method == "gmm" else {})).fit(out).transform(out)
        return out.select(*self.keys, *(f"k_{k}" for k in k_range))

    def sample(self, clusters: DataFrame, k: int, n: int, seed: int = 0) -> DataFrame:
        """Up to n landscapes of each cluster, at random."""
        order = W.partitionBy(f"k_{k}").orderBy(F.rand(seed))
        return clusters.withColumn("tp_i", F.row_number().over(order)).where(F.col("tp_i") <= n).drop("tp_i")
