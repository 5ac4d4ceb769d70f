"""PCA whitening with MLlib's BlockMatrix.

Centred rows are dealt to blocks by a row number, the transposed matrix times the
matrix gives the scatter, a local eigendecomposition of that small square gives the
whitening matrix, and a second block product projects all rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.llm.common import prefix_sums
from jobweave.operators.scratch import Scratch

BLOCK_ROWS, BLOCK_COLS = 2048, 1024
BLOCKS_A_TASK = 8  # row blocks whose products one task of the scatter sums
LARGEST = float(1 << 40)  # entries of a fixed-point vector beyond it are not taken
NO_VARIANCE = 1e-13  # a component with less of the trace has no whitened values


def fixed_point(vector: Column, scale: int, offset: int) -> Column:
    """floor(scale * c) + offset of every entry as long; null for a vector that is
    null or has an entry that is null, not finite or beyond LARGEST."""
    v = F.transform(vector, lambda c: c.cast("double"))
    fine = F.forall(v, lambda c: F.coalesce((~F.isnan(c)) & (F.abs(c) <= LARGEST), F.lit(False)))
    return F.when(fine, F.transform(v, lambda c: F.floor(c * scale).cast("long") + offset))


def _scatter(dealt: BlockMatrix, splits: int) -> np.ndarray:
    """Transpose times matrix.  The Python method has no argument for the splits of the
    middle dimension; without them all row blocks would meet in one task."""
    left, right = dealt.transpose()._java_matrix_wrapper, dealt._java_matrix_wrapper
    product = left.call("multiply", right._java_model, splits)
    return BlockMatrix(product, dealt.colsPerBlock, dealt.colsPerBlock).toLocalMatrix().toArray()


def whiten(
    rows: DataFrame, scratch: Scratch, *, keys: Sequence[str] = ("vec_id",),
    vector: str = "vector", components: int = 8,
) -> DataFrame:
    """One row per row of ``rows`` with a vector and component up to ``components``:
    the keys, component, n, deviation, whitened, explained, identity_error.

    ``vector`` is an array of long.  Sums are exact; a row's deviation from the mean
    is (n * x - S) / n with an exact numerator, and ``deviation``, the sum of those
    numerators' squares, is a decimal(38, 0).  Component j is the j-th unit eigenvector
    of the covariance (divisor n) by falling eigenvalue, its sign fixed by its largest
    entry; ``whitened`` is the projection over the root of its eigenvalue, ``explained``
    its eigenvalue over the trace, ``identity_error`` the largest absolute entry of the
    whitened columns' covariance minus the identity.

    Only sums and the square scatter matrix, whose sizes depend on the dimensions
    alone, come to the driver.  Rows with a null vector are left out.  Shorter vectors
    count as if filled up with zeros.  Fewer dimensions give fewer components.  A
    component without variance has whitened null, explained 0 and does not count in
    identity_error (null if none is left).  Repeated rows and ties count as often as
    they stand; null keys stay; other columns are not read; an empty table gives no rows.
    """
    spark = rows.sparkSession
    given = rows.filter(F.col(vector).isNotNull())
    given = scratch.keep(given.select(*keys, F.col(vector).alias("_x")), "vectors")
    n, dims = given.agg(F.count(F.lit(1)), F.max(F.size("_x"))).first()
    kept = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    if not n or not dims:
        return spark.createDataFrame(
            [], f"{kept}, component int, n long, deviation decimal(38,0), whitened double, "
            "explained double, identity_error double"
        )
    entries = given.select(F.posexplode("_x").alias("d", "v"))
    found = entries.groupBy("d").agg(F.sum("v").alias("s")).collect()  # one row a dimension
    sums = [0] * dims
    for r in found:
        sums[r["d"]] = r["s"]

    filled = F.when(F.size("_x") == dims, F.col("_x")).otherwise(
        F.concat("_x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("_x")))
    )
    apart = F.zip_with(filled, F.lit(sums).cast("array<long>"), lambda x, s: x * F.lit(n).cast("long") - s)
    exact = F.aggregate(
        "_d", F.lit(0).cast("decimal(38,0)"),
        lambda a, d: (a + d.cast("decimal(19,0)") * d.cast("decimal(19,0)")).cast("decimal(38,0)"),
    )
    numbered = prefix_sums(
        given.withColumns({"_tie": F.xxhash64("_x"), "_one": F.lit(1).cast("long")}),
        [], [*keys, "_tie"], {"_at": "_one"}, scratch,
    )
    centred = scratch.keep(
        numbered.withColumn("_d", apart).select(
            *keys, F.col("_at").cast("long").alias("_at"), exact.alias("_deviation"),
            F.transform("_d", lambda d: d / F.lit(float(n))).alias("_c"),
        ),
        "centred",
    )
    wide = centred.select(F.col("_at").alias("index"), array_to_vector("_c").alias("vector"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(wide, "vector"), n, dims)
    cols = min(dims, BLOCK_COLS)
    dealt = matrix.toBlockMatrix(BLOCK_ROWS, cols)
    splits = math.ceil(n / BLOCK_ROWS / BLOCKS_A_TASK)
    scatter = _scatter(dealt, splits)

    values, vectors = np.linalg.eigh((scatter + scatter.T) / (2 * n))
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, dims)
    trace = max(float(values.sum()), 0.0)
    live = values[:k] > NO_VARIANCE * trace if trace > 0 else np.zeros(k, bool)
    vectors = vectors[:, :k] * np.where(vectors[np.abs(vectors[:, :k]).argmax(0), range(k)] < 0, -1, 1)
    white = np.where(live, vectors / np.sqrt(np.where(live, values[:k], 1.0)), 0.0)
    parts = [
        ((i, 0), Matrices.dense(len(w), k, w.flatten("F").tolist()))
        for i in range(math.ceil(dims / cols)) for w in [white[i * cols : (i + 1) * cols]]
    ]
    whitening = BlockMatrix(spark.sparkContext.parallelize(parts), cols, k, dims, k)
    projected = dealt.multiply(whitening).toIndexedRowMatrix()
    projected = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model)
    projected = scratch.keep(
        projected.select(F.col("index").alias("_i"), vector_to_array("vector").alias("_w")), "projected"
    )

    pairs = [(i, j) for i in range(k) for j in range(i + 1) if live[i] and live[j]]
    w = [F.col("_w")[i] for i in range(k)]
    error = None
    if pairs:
        got = projected.agg(
            *[F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i, j in pairs]
        ).first()
        error = max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    told = F.array(*[
        F.struct(
            F.lit(j + 1).alias("component"),
            (w[j] if live[j] else F.lit(None).cast("double")).alias("whitened"),
            F.lit(float(max(values[j], 0.0) / trace) if trace > 0 else 0.0).alias("explained"),
        )
        for j in range(k)
    ])
    return (
        centred.select(*keys, "_at", "_deviation")
        .join(projected, F.col("_at") == F.col("_i"))
        .select(*keys, "_deviation", F.explode(told).alias("_t"))
        .select(
            *keys, "_t.component", F.lit(n).cast("long").alias("n"), F.col("_deviation").alias("deviation"),
            "_t.whitened", "_t.explained", F.lit(error).cast("double").alias("identity_error"),
        )
    )
