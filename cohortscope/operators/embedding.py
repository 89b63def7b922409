"""Two-dimensional maps of feature vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Landmarks are held by the driver and by every task.
MAX_LANDMARKS = 1000


def project_2d(df: DataFrame, features: str, names: tuple[str, str] = ("dim_1", "dim_2")) -> DataFrame:
    """Add the first two principal components of an array column.

    Fitting sums a (width x width) matrix over the partitions, whatever the number of rows. A component's
    sign is chosen so that its largest loading is positive, so the map doesn't depend on the solver.
    """
    prepared = df.withColumn("_vector", array_to_vector(F.col(features).cast("array<double>")))
    model = PCA(k=2, inputCol="_vector", outputCol="_plane").fit(prepared.select("_vector"))
    first, second = _signs(model.pc.toArray())
    plane = vector_to_array(F.col("_plane"))
    return (
        model.transform(prepared)
        .withColumns({names[0]: F.get(plane, F.lit(0)) * first, names[1]: F.get(plane, F.lit(1)) * second})
        .drop("_vector", "_plane")
    )


def _signs(vectors: np.ndarray) -> list[float]:
    """1 or -1 per column, the sign of its largest entry."""
    largest = np.abs(vectors).argmax(axis=0)
    return [1.0 if vectors[i, k] >= 0 else -1.0 for k, i in enumerate(largest)]


def _squared(points: np.ndarray, to: np.ndarray, metric: str) -> np.ndarray:
    """Squared distances of points to each of a few others, one of those at a time."""
    if metric == "euclidean":
        return np.stack([((points - p) ** 2).sum(axis=1) for p in to], axis=1)
    return np.stack([np.abs(points - p).sum(axis=1) ** 2 for p in to], axis=1)


def landmark_map(
    df: DataFrame,
    features: str,
    key: str,
    n_landmarks: int = 256,
    metric: str = "euclidean",
    names: tuple[str, str] = ("dim_1", "dim_2"),
) -> DataFrame:
    """Add a plane that keeps distances (``euclidean`` or ``manhattan``) as landmark scaling does.

    The landmarks are the rows with the smallest MD5 of their key, so the map is the same on any cluster. Their
    mutual distances give the plane by classical scaling, a problem of landmarks x landmarks in the driver; every
    row is then placed from its own distances to the landmarks, inside its task. Nothing is shuffled but the
    candidates for landmarks. A row without features, or with a NULL or NaN among them, has no place and is no landmark; a direction that the landmarks don't spread in
    is 0 for all; a table without features gives NULLs.
    """
    if metric not in ("euclidean", "manhattan"):
        raise ValueError(f"unknown metric {metric}")
    if not 1 <= n_landmarks <= MAX_LANDMARKS:
        raise ValueError(f"between 1 and {MAX_LANDMARKS} landmarks")
    vector = F.col(features).cast("array<double>")
    chosen = (
        df.select(F.col(key).alias("k"), vector.alias("v"))
        .filter(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e)))
        .orderBy(F.md5(F.col("k").cast("string").cast("binary")), "k", "v")
        .limit(n_landmarks)
        .collect()
    )
    if not chosen:
        return df.withColumns({name: F.lit(None).cast("double") for name in names})
    landmarks = np.array([r.v for r in chosen], float)
    between = _squared(landmarks, landmarks, metric)
    means = between.mean(axis=0)
    values, vectors = np.linalg.eigh(-0.5 * (between - means[:, None] - means[None, :] + means.mean()))
    weights = np.zeros((len(landmarks), 2))
    for k in range(min(2, len(landmarks))):
        value, direction = values[-1 - k], vectors[:, -1 - k]
        if value > 1e-12 * max(abs(values).max(), 1e-300):
            weights[:, k] = -0.5 * direction * _signs(direction[:, None])[0] / np.sqrt(value)

    @F.pandas_udf("first double, second double")
    def place(rows: pd.Series) -> pd.DataFrame:
        out = np.full((len(rows), 2), np.nan)
        known = rows.notna().to_numpy()
        if known.any():
            points = np.stack(rows[known].to_list())
            out[known] = (_squared(points, landmarks, metric) - means) @ weights
        lost = np.isnan(out)
        return pd.DataFrame({n: pd.arrays.FloatingArray(out[:, k], lost[:, k]) for k, n in enumerate(("first", "second"))})

    placed = df.withColumn("_place", place(vector))
    return placed.withColumns(
        {name: F.col(f"_place.{field}") for name, field in zip(names, ("first", "second"), strict=True)}
    ).drop("_place")
