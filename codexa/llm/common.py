"""What the operators of this subpackage share: scratch tables, row identity, skew-proof lookups."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A lookup broadcasts the keys that hold over 1/HOT_KEYS of the rows; there are fewer than HOT_KEYS of them.
HOT_KEYS = 1000
#: Text handled at once by a Python worker.
CHUNK_BYTES = 8 << 20

_scratch: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset on a single machine (tests), a temporary one, which is then set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='codexa-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/codexa-{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def written(df: DataFrame, name: str, by: tuple[str, ...] = (), codec: str | None = None) -> DataFrame:
    """df as a table in the shared folder, in folders by the columns `by`: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    out = df.write.option("compression", codec) if codec else df.write
    out.partitionBy(*by).parquet(path) if by else out.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made and nothing will read again."""
    for t in tables:
        if path := getattr(t, "_scratch", None):
            _delete(t.sparkSession, path)
            t._scratch = None


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished steps now; it waits for collected references otherwise.

    The session holds on to its last query, so a small one comes between.
    """
    spark.range(1).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _clean() -> None:
    for spark, path in _scratch:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            return


def n_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def id_text(col: str = "doc_id") -> Column:
    """The id as text; null counts as ''."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def fold(col: str, n: int) -> Column:
    return F.crc32(id_text(col).cast("binary")) % n


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Identity of a row by id and text: repeated rows share it, rows that only share an id do not."""
    return F.xxhash64(id_text(id_col), F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).isNull())


def free_name(docs: DataFrame, name: str) -> str:
    """name, or name with underscores before it that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def set_aside(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """docs with all columns but `used` under names that no operator has, and what gives them their names and order back.

    The latter takes a table that kept these columns, and names of columns to add behind them.
    """
    names = {c: c if c in used else f"codexa aside {i}" for i, c in enumerate(docs.columns)}

    def back(df: DataFrame, *more: str) -> DataFrame:
        return df.select(*[F.col(f"`{n}`").alias(c) for c, n in names.items() if n in df.columns], *more)

    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), back


def hot_safe_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, how: str = "left", total: int | None = None) -> DataFrame:
    """left joined with right (one row a key) where single keys may hold a large share of left.

    counts: (key, rows of left), as a table that is cheap to read; total: the sum of these rows, if known. Keys over 1/HOT_KEYS of all rows, fewer than
    HOT_KEYS by that very share, are looked up by broadcast; the others are shuffled.
    """
    spark = left.sparkSession
    total = counts.agg(F.sum("rows")).first()[0] or 0 if total is None else total
    hot = counts.where(F.col("rows") > max(total // HOT_KEYS, 64)).select(key)
    found = hot.collect()  # fewer than HOT_KEYS rows
    if not found:
        return left.join(right, key, how)
    hot = spark.createDataFrame(found, hot.schema)
    is_hot = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left").withColumn("_hot", F.coalesce("_hot", F.lit(False)))
    few = right.join(F.broadcast(hot), key, "left_semi")
    rest = right.join(F.broadcast(hot), key, "left_anti")
    a = is_hot.where("_hot").drop("_hot").join(F.broadcast(few), key, how)
    b = is_hot.where("not _hot").drop("_hot").join(rest, key, how)
    return a.unionByName(b)


def trim() -> None:
    """Gives freed memory back to the system: a Python worker lives on after its task, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about `most` bytes of text (one row at least)."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist() if batch.num_rows else []
        at = held = 0
        for i, n in enumerate(sizes):
            if i > at and held + n > most:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        if at < batch.num_rows:
            yield batch.slice(at)
    trim()


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array, schema) -> pa.RecordBatch:
    """batch with one column more, in the types that Spark expects of `schema`."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrays = [batch.column(i) for i in range(batch.num_columns)] + [values]
    types = [batch.schema.field(i).type for i in range(batch.num_columns)] + [to_arrow_schema(schema).field(name).type]
    return pa.RecordBatch.from_arrays([a.cast(t) if a.type != t else a for a, t in zip(arrays, types, strict=True)], names=schema.names)


def int_lists(values: list) -> pa.Array:
    """Integer arrays as one Arrow array of lists of int32."""
    cuts = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=cuts[1:])
    flat = np.concatenate(values) if values else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat.astype(np.int32)))
