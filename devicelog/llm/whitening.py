"""Whitening of embeddings, fitted on distinct vectors with their counts as weights.

Entries become integers x, and equal x vectors are grouped before anything is
computed from them: sums, the centred products and the projections all run once
for each distinct vector, with the count (or one) as its weight. Sums are exact.
Each task multiplies its own centred, weighted vectors; the matrices of the tasks
are added up by their places. Only numbers of the size of the covariance matrix
reach the driver. The results are joined back to the rows: vectors that hold more
than a thousandth of the rows, at most a thousand of them, by broadcast, the
others by a shuffle whose keys are then all small.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devicelog.session import written

#: A vector is common if it has more than one in so many rows.
COMMON = 1000
_WIDE = pa.decimal128(38, 0)
_RESULT = (
    "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
)


@dataclass
class Whitening:
    """A fit: number of vectors, exact sums, components as columns, their eigenvalues and shares of the variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact; wide integers only where 64 bits may not do."""
        return _centred(x, self.n, self.sums)

    def project(self, exact: np.ndarray) -> np.ndarray:
        """Whitened coordinates; not a number where a component has no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.eigenvalues > 0, 1 / np.sqrt(self.eigenvalues), np.nan)
        return ((exact / self.n).astype(np.float64) @ self.components) * scale


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)), 1) * n + max(map(abs, sums), default=0)
    if most < 1 << 62:
        return x * n - np.array(sums, dtype=np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def _squares(exact: np.ndarray) -> list[int]:
    """Exact sums of squares of the rows."""
    most = max(abs(int(v)) for v in (exact.max(initial=0), exact.min(initial=0)))
    if most * most * max(exact.shape[1], 1) < 1 << 62:
        return (exact * exact).sum(axis=1).tolist()
    wide = exact.astype(object)
    return [int(v) for v in (wide * wide).sum(axis=1)]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def as_integers(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id and x = floor(1024 c) + 100000 of the rows whose vectors are complete.

    A vector counts as complete if it has as many entries as the longest one, and
    all of them are finite.
    """
    vector = F.col(f"`{vector_column}`")
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), vector.cast("array<double>").alias("c"))
    finite = F.forall("c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = rows.where(F.coalesce(finite, F.lit(False)) & (F.size("c") > 0))
    longest = rows.agg(F.max(F.size("c"))).first()[0] or 0
    x = F.transform("c", lambda c: F.floor(c * 1024) + F.lit(100_000))
    return rows.where(F.size("c") == longest).select("vec_id", x.alias("x"))


def _sums(weighted: DataFrame) -> tuple[int, list[int]]:
    """Sum of the weights, and exact weighted sums of the entries of x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, weight = _matrix(batch.column(0)), batch.column(1).to_numpy()
            own = int(weight.sum())
            n += own
            if max(int(x.max()), -int(x.min()), 1) * own >= 1 << 62:
                x, weight = x.astype(object), weight.astype(object)
            part = [int(v) for v in weight @ x]
            total = part if total is None else [a + b for a, b in zip(total, part)]
        if total is not None:
            places = pa.array(range(-1, len(total)), pa.int32())
            yield pa.RecordBatch.from_arrays([places, pa.array([n, *total], _WIDE)], names=["place", "total"])

    parts = weighted.select("x", "weight").mapInArrow(run, "place int, total decimal(38,0)")
    rows = parts.groupBy("place").agg(F.sum("total").alias("total")).orderBy("place").collect()
    return (int(rows[0].total), [int(r.total) for r in rows[1:]]) if rows else (0, [])


def _products(table: DataFrame, centre: Callable[[pa.Array], np.ndarray]) -> np.ndarray:
    """Sum over the rows of weight times the outer product of ``centre`` of the first column with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            y = centre(batch.column(0))
            part = (y * batch.column(1).to_numpy()[:, None].astype(np.float64)).T @ y
            total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(len(total))
            columns = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])]
            yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "product"])

    parts = table.mapInArrow(run, "i int, j int, product double")
    found = parts.groupBy("i", "j").agg(F.sum("product").alias("product")).toArrow()
    i, j, products = (found.column(k).to_numpy() for k in range(3))
    size = int(j.max()) + 1 if len(j) else 0
    out = np.zeros((size, size))
    out[i, j] = out[j, i] = products
    return out


def fit(weighted: DataFrame, components: int = 8) -> Whitening | None:
    """A whitening from distinct vectors ``x`` and their ``weight``; None if there are none.

    The covariance has the sum of the weights as its divisor. Components are unit
    eigenvectors by falling eigenvalue, the entry of largest size made positive.
    """
    n, sums = _sums(weighted)
    if not n:
        return None

    def centre(column: pa.Array) -> np.ndarray:
        return (_centred(_matrix(column), n, sums) / n).astype(np.float64)

    covariance = _products(weighted.select("x", "weight"), centre) / n
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][:components]
    trace = float(np.trace(covariance))
    # Rounding leaves tiny eigenvalues where there is no variance.
    least = trace * len(values) * np.finfo(np.float64).eps
    chosen, own = vectors[:, order], np.where(values[order] > least, values[order], 0.0)
    chosen = chosen * np.where(np.take_along_axis(chosen, np.abs(chosen).argmax(axis=0)[None, :], 0)[0] < 0, -1.0, 1.0)
    return Whitening(n, sums, chosen, own, own / trace if trace > 0 else own)


def whiten_distinct(weighted: DataFrame, model: Whitening) -> DataFrame:
    """x, weight, n_rows, ``deviation`` (exact sum of squares of n * x - sums) and ``whitened`` of each distinct vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            exact = model.centred(_matrix(batch.column(0)))
            found = model.project(exact)
            columns = [*batch.columns, pa.array(_squares(exact), _WIDE), pa.array(list(found), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["x", "weight", "n_rows", "deviation", "whitened"])

    schema = "x array<long>, weight long, n_rows long, deviation decimal(38,0), whitened array<double>"
    return weighted.select("x", "weight", "n_rows").mapInArrow(run, schema)


def _identity_error(whitened: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the covariance of the whitened vectors minus the identity."""
    varied = np.flatnonzero(model.eigenvalues > 0)
    if not len(varied):
        return None
    entries = [F.sum(F.col("weight") * F.col("whitened")[int(k)]) for k in varied]
    means = np.array(whitened.agg(*entries).first(), dtype=np.float64) / model.n

    def centre(column: pa.Array) -> np.ndarray:
        return _matrix(column)[:, varied] - means

    covariance = _products(whitened.select("whitened", "weight"), centre) / model.n
    return float(np.abs(covariance - np.eye(len(varied))).max())


def whiten(
    vectors: DataFrame,
    components: int = 8,
    weights: str = "counts",
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    common: int = COMMON,
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each complete vector and component.

    ``weights`` is "counts" (every row counts) or "one" (every distinct vector
    counts once); n is their sum. Columns are those of the operator's contract, with
    ``deviation`` as a wide decimal.

    Rows without a vector, with fewer entries than the longest, or with null or
    non-finite entries are left out. A component without variance has whitened
    NULL and explained 0; identity_error looks at the others and is NULL if there
    are none. Null ids and repeated rows stay; an empty table gives an empty result;
    other columns are ignored. Entries beyond 9e15 do not fit and are an error.
    """
    if weights not in ("counts", "one"):
        raise ValueError("weights must be 'counts' or 'one'")
    spark = vectors.sparkSession
    rows = as_integers(vectors, id_column, vector_column)
    grouped = rows.groupBy("x").agg(F.count("*").alias("n_rows"))
    weight = F.col("n_rows") if weights == "counts" else F.lit(1).cast("long")
    weighted = written(grouped.withColumn("weight", weight))
    model = fit(weighted, components)
    if model is None:
        return spark.createDataFrame([], _RESULT)
    distinct = written(whiten_distinct(weighted, model).withColumn("hash", F.xxhash64("x")))
    error = _identity_error(distinct, model)

    known = distinct.drop("weight")
    total = known.agg(F.sum("n_rows")).first()[0]
    # At most ``common`` vectors have more than one in ``common`` of the rows.
    often = known.where(F.col("n_rows") * common > F.lit(total)).select("x", "deviation", "whitened")
    seldom = known.where(F.col("n_rows") * common <= F.lit(total)).select("hash", "x", "deviation", "whitened")
    first = rows.join(F.broadcast(often), "x").select("vec_id", "deviation", "whitened")
    keyed = rows.join(F.broadcast(often.select("x")), "x", "left_anti").withColumn("hash", F.xxhash64("x"))
    joined = first.unionByName(keyed.join(seldom, ["hash", "x"]).select("vec_id", "deviation", "whitened"))
    shares = F.array(*[F.lit(float(v)) for v in model.explained])
    return joined.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "value")).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        F.nanvl("value", F.lit(None).cast("double")).alias("whitened"),
        shares[F.col("place")].alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
