"""Embedding whitening by distributed block matrices.

Rows are packed into blocks of equal height where they stand, so indexing them needs no
shuffle. The scatter matrix is one transpose-multiply of Spark's BlockMatrix, its eigenvectors
are found locally (dimensions x dimensions), and a second block product projects the rows.

A product of tall matrices would be dealt over the square root of the partitions only, as
the block grid is one block wide. The scatter therefore splits the middle dimension, and the
projection lays the blocks out as a square grid times a block-diagonal whitening matrix.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegralType, StructField, StructType

from corpusveil.session import new_table_path

#: Numbers of a block; the rows of a block follow from it.
BLOCK = 1 << 17
#: Blocks that meet in one task of a product.
SPLIT = 16
#: Dimensions at most: the driver holds a few matrices of dimensions x dimensions doubles.
MAX_DIMS = 4096
#: Eigenvalues under this share of the largest count as none.
RANK = 1e-12
#: Fixed value: the fields under which Spark stores a matrix.
MATRIX = "struct<type:tinyint,numRows:int,numCols:int,colPtrs:array<int>,rowIndices:array<int>,values:array<double>,isTransposed:boolean>"


@dataclass(frozen=True)
class Whitening:
    """What the fit learnt: n rows, their sums (exact for whole numbers), unit eigenvectors as
    columns by falling eigenvalue, each eigenvalue's share of the trace, and the largest
    entry by which the covariance of the whitened fit rows departs from the identity."""

    dims: int
    n: int
    sums: tuple
    vectors: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def matrix(self) -> np.ndarray:
        """dims x components; a component without variance has zeros."""
        root = np.sqrt(np.maximum(self.eigenvalues, 0))
        return np.divide(self.vectors, root, out=np.zeros_like(self.vectors), where=self.usable)

    @property
    def usable(self) -> np.ndarray:
        return self.eigenvalues > RANK * max(self.eigenvalues.max(initial=0), 0)


def _whole(vector: Column) -> Column:
    """The vector has entries, and all of them are finite numbers."""
    number = vector.cast("array<double>")
    return F.coalesce(F.forall(number, lambda c: c.isNotNull() & (F.abs(c) < float("inf")) & ~F.isnan(c)) & (F.size(vector) > 0), F.lit(False))


def _dtype(df: DataFrame, vector_col: str):
    """Whole numbers are kept as such, so that their sums are exact."""
    kind = df.schema[vector_col].dataType
    return np.int64 if isinstance(kind, ArrayType) and isinstance(kind.elementType, IntegralType) else np.float64


def _exact(vector: Column, dtype) -> Column:
    """64-bit entries without a negative zero, so that equal vectors are equal keys."""
    return vector.cast("array<bigint>") if dtype is np.int64 else F.transform(vector, lambda c: c.cast("double") + F.lit(0.0))


def _rows(dims: int) -> int:
    return max(16, BLOCK // dims)


def _packed(high: int, finish):
    """Batches of (x, ...) -> finish(x, rest) for every `high` rows, the last ones fewer."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            low = 0
            while low < batch.num_rows:
                part = batch.slice(low, high - n)
                held.append(part)
                n, low = n + part.num_rows, low + part.num_rows
                if n == high:
                    yield finish(pa.Table.from_batches(held).combine_chunks())
                    held, n = [], 0
        if n:
            yield finish(pa.Table.from_batches(held).combine_chunks())

    return run


def _numbers(table: pa.Table, dims: int, dtype) -> np.ndarray:
    flat = table.column("x").combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(dtype).reshape(-1, dims)


def _raw(dims: int, dtype):
    """The vectors of one block as they are."""

    def finish(table: pa.Table):
        return pa.RecordBatch.from_arrays([pa.array([table.num_rows], pa.int32()), pa.array([_numbers(table, dims, dtype).tobytes()], pa.binary())], ["rows", "x"])

    return finish


def _matrix(x: np.ndarray, high: int):
    """Rows as the fields of a dense matrix, filled up with zeros to `high` rows."""
    full = np.zeros((high, x.shape[1]))
    full[: len(x)] = x
    whole = pa.ListArray.from_arrays(pa.array([0, full.size], pa.int32()), pa.array(full.ravel()))
    none = pa.nulls(1, pa.list_(pa.int32()))
    fields = [pa.array([1], pa.int8()), pa.array([high], pa.int32()), pa.array([x.shape[1]], pa.int32()), none, none, whole, pa.array([True])]
    return pa.StructArray.from_arrays(fields, ["type", "numRows", "numCols", "colPtrs", "rowIndices", "values", "isTransposed"])


def _centred_block(dims: int, dtype, n: int, sums: tuple):
    """The centred rows of one block as a matrix, and their ids."""
    high = _rows(dims)

    def finish(table: pa.Table):
        m = _matrix(_centred(_numbers(table, dims, dtype), n, sums), high)
        ids = table.column("id").combine_chunks()
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), m], ["ids", "m"])

    return finish


def _centred_raw(dims: int, dtype, n: int, sums: tuple):
    """Batches of (block, x) -> (block, m): the centred rows as matrices."""
    high = _rows(dims)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.frombuffer(batch.column(1)[i].as_py(), dtype).reshape(-1, dims)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), _matrix(_centred(x, n, sums), high)], ["block", "m"])

    return run


def _centred(x: np.ndarray, n: int, sums: tuple) -> np.ndarray:
    """Rows less the mean. n * x - sum is exact where it fits 64 bits."""
    if x.dtype == np.int64 and np.abs(x.astype(np.float64)).max(initial=0) * n + max(map(abs, sums)) < 2.0**62:
        return (x * np.int64(n) - np.array(sums, np.int64)) / float(n)
    return x.astype(np.float64) - np.array([s / n for s in sums], np.float64)


def _numbered(made: DataFrame) -> tuple[str, DataFrame, int]:
    """Stores the blocks; where, a (part, base) table that with `place` numbers them from 0, and
    how many there are. What reaches the driver is one number per partition."""
    spark = made.sparkSession
    path = new_table_path(spark, "blocks")
    made.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).write.parquet(path)
    stored = spark.read.parquet(path)
    counts = sorted((r["part"], r["c"]) for r in stored.groupBy("part").agg(F.count(F.lit(1)).alias("c")).collect())
    first = np.cumsum([0] + [c for _, c in counts]).tolist()
    return path, spark.createDataFrame([(p, b) for (p, _), b in zip(counts, first)], "part int, base bigint"), first[-1]


def _typed(spark: SparkSession, path: str) -> DataFrame:
    """The stored table with its column m read as matrices, without a Python worker."""
    fields = [StructField("m", MatrixUDT()) if f.name == "m" else f for f in spark.read.parquet(path).schema.fields]
    return spark.read.schema(StructType(fields)).parquet(path)


def _plain(df: DataFrame, label: str) -> DataFrame:
    """df stored, and read again with its column m as a struct."""
    path = new_table_path(df.sparkSession, label)
    df.write.parquet(path)
    fields = [StructField("m", MatrixUDT.sqlType()) if f.name == "m" else f for f in df.schema.fields]
    return df.sparkSession.read.schema(StructType(fields)).parquet(path)


def _block_matrix(blocks: DataFrame, wide: int, high: int, broad: int, count: int) -> BlockMatrix:
    """(block, m) as a matrix whose grid is `wide` blocks wide; a block is high x broad."""
    at = F.struct(F.floor(F.col("block") / wide).cast("bigint").alias("i"), (F.col("block") % wide).alias("j"))
    made = callMLlibFunc("createBlockMatrix", blocks.select(at.alias("at"), "m"), high, broad, -(-count // wide) * high, wide * broad)
    return BlockMatrix(made, high, broad)


def _summed(dims: int, dtype):
    """Batches of blocks -> the task's column sums."""

    def run(batches):
        total = np.zeros(dims, object if dtype is np.int64 else np.float64)
        for batch in batches:
            for raw in batch.column(0):
                x = np.frombuffer(raw.as_py(), dtype).reshape(-1, dims)
                small = dtype is np.float64 or np.abs(x.astype(np.float64)).max(initial=0) * len(x) < 2.0**62
                total += x.sum(axis=0).astype(total.dtype) if small else x.astype(object).sum(axis=0)
        values = pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0)) if dtype is np.int64 else pa.array(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), values], ["pos", "s"])

    return run


def _sums(raw: DataFrame, dims: int, dtype) -> tuple:
    kind = "decimal(38,0)" if dtype is np.int64 else "double"
    sums = raw.select("x").mapInArrow(_summed(dims, dtype), f"pos int, s {kind}").groupBy("pos").agg(F.sum("s").alias("s")).collect()  # one row per dimension
    found = {r["pos"]: r["s"] for r in sums}
    return tuple((int if dtype is np.int64 else float)(found[i]) for i in range(dims))


def _scatter(blocks: DataFrame, count: int, high: int, broad: int) -> np.ndarray:
    """Sum over all rows of row' row: one block product, its middle dimension dealt over tasks."""
    tall = _block_matrix(blocks, 1, high, broad, count)
    flat = tall.transpose()
    # the Scala method takes the number of splits of the middle dimension, the Python one does not
    product = flat._java_matrix_wrapper.call("multiply", tall._java_matrix_wrapper._java_model, -(-count // SPLIT))
    return BlockMatrix(product, broad, broad).toLocalMatrix().toArray()


def _product(blocks: DataFrame, count: int, high: int, matrix: np.ndarray) -> DataFrame:
    """(block, m): the blocks times the matrix. On a square grid, so that the product is dealt over
    all tasks; the factor repeats the matrix along its diagonal."""
    spark, (dims, k) = blocks.sparkSession, matrix.shape
    wide = int(np.ceil(np.sqrt(count)))
    left = _block_matrix(blocks, wide, high, dims, count)
    values = np.asarray(matrix, np.float64).ravel("F")
    diagonal = spark.sparkContext.parallelize(range(wide), max(1, wide // SPLIT)).map(lambda j: ((j, j), DenseMatrix(dims, k, values)))
    made = left.multiply(BlockMatrix(diagonal, dims, k, wide * dims, wide * k))
    found = callMLlibFunc("getMatrixBlocks", made._java_matrix_wrapper._java_model)
    return found.select((F.col("_1._1") * wide + F.col("_1._2")).cast("bigint").alias("block"), F.col("_2").alias("m"))


def fit(df: DataFrame, vector_col: str, components: int) -> Whitening | None:
    """Mean, covariance and its first eigenvectors over the distinct vectors of df (divisor n).

    Vectors that are null, empty, or hold null or non-finite entries take no part, nor do those of
    another length than most have (of equally many, the longer). None where no vector is
    left. Repeated vectors count once. Components without variance have no direction of
    their own: their whitened values are 0 and they are left out of identity_error.
    """
    spark, dtype = df.sparkSession, _dtype(df, vector_col)
    rows = df.select(F.col(vector_col).alias("x")).where(_whole(F.col("x")))
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    if sizes is None:
        return None
    dims = sizes["d"]
    if dims > MAX_DIMS:
        raise ValueError(f"vectors of {dims} entries; at most {MAX_DIMS}")
    distinct = rows.where(F.size("x") == dims).select(_exact(F.col("x"), dtype).alias("x")).distinct()
    made = distinct.mapInArrow(_packed(_rows(dims), _raw(dims, dtype)), "rows int, x binary")
    path, bases, count = _numbered(made)
    raw = spark.read.parquet(path)
    n = raw.agg(F.sum("rows")).first()[0]
    sums = _sums(raw, dims, dtype)
    numbered = raw.join(F.broadcast(bases), "part").select((F.col("base") + F.col("place")).alias("block"), "x")
    centred = new_table_path(spark, "centred")
    numbered.mapInArrow(_centred_raw(dims, dtype, n, sums), f"block bigint, m {MATRIX}").write.parquet(centred)
    blocks = _typed(spark, centred)
    scatter = _scatter(blocks, count, _rows(dims), dims)
    values, vectors = np.linalg.eigh((scatter + scatter.T) / (2.0 * n))
    k = min(components, dims)
    values, vectors, trace = values[::-1][:k], vectors[:, ::-1][:, :k], np.trace(scatter) / n
    explained = values / trace if trace > 0 else np.zeros(k)
    model = Whitening(dims, n, sums, np.ascontiguousarray(vectors), values, explained, 0.0)
    whitened = new_table_path(spark, "whitened")
    _product(blocks, count, _rows(dims), model.matrix).write.parquet(whitened)
    again = _scatter(_typed(spark, whitened), count, _rows(dims), k) / n
    on = np.flatnonzero(model.usable)
    error = np.abs(again - np.eye(k))[np.ix_(on, on)].max(initial=0.0)
    return Whitening(dims, n, sums, model.vectors, values, explained, float(error))


def _unpacked(k: int, high: int):
    """Batches of (ids, values, by rows) -> (id, whitened) rows."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, z = batch.column(0).slice(i, 1).flatten(), batch.column(1).slice(i, 1).flatten().to_numpy()
                z = (z.reshape(high, k) if batch.column(2)[i].as_py() else z.reshape(k, high).T)[: len(ids)]
                places = pa.array(np.arange(len(ids) + 1) * k, pa.int32())
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(places, pa.array(z.ravel()))], ["id", "whitened"])

    return run


def project(df: DataFrame, model: Whitening, id_col: str, vector_col: str) -> DataFrame:
    """(id, whitened) for every row that could take part in the fit: its centred projection on
    each component over the square root of its eigenvalue. The id may be of any type, a struct too.

    Repeated rows stay, ids may be null or repeated, other columns are ignored, an empty table
    gives no rows."""
    spark, dtype, dims = df.sparkSession, _dtype(df, vector_col), model.dims
    rows = df.select(_exact(F.col(vector_col), dtype).alias("x"), F.col(id_col).alias("id")).where(_whole(F.col("x")) & (F.size("x") == dims))
    ids = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(_packed(_rows(dims), _centred_block(dims, dtype, model.n, model.sums)), f"ids array<{ids}>, m {MATRIX}")
    path, bases, count = _numbered(made)
    if not count:
        return spark.createDataFrame([], f"id {ids}, whitened array<double>")
    blocks = _typed(spark, path).join(F.broadcast(bases), "part").withColumn("block", F.col("base") + F.col("place"))
    z = _plain(_product(blocks, count, _rows(dims), model.matrix), "whitened").select("block", "m.values", "m.isTransposed")
    k = model.matrix.shape[1]
    return blocks.select("block", "ids").join(z, "block").select("ids", "values", "isTransposed").mapInArrow(
        _unpacked(k, _rows(dims)), f"id {ids}, whitened array<double>"
    )
