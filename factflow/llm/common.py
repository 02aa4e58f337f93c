"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local master may go without that setting (tests); it then gets a
    temporary folder. A cluster without it is refused: a machine-local folder
    would not be seen by the other machines.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not (master.startswith("local[") or master == "local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = getattr(shared_dir, "_own", None)
        if path is None:
            path = shared_dir._own = tempfile.mkdtemp(prefix="factflow-")
    return path.rstrip("/")


#: What ``settle`` wrote within the innermost ``scratch``; None: outside of any.
_WRITTEN: ContextVar[list[DataFrame] | None] = ContextVar("written", default=None)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage like ``checkpoint()``; the files are columnar and
    survive the loss of executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/factflow-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    if (written := _WRITTEN.get()) is not None:
        written.append(out)
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``settle`` wrote for these frames, once all that was made of
    them is written out itself."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._settled)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Within it, what ``settle`` writes is deleted at the end, but for the frames
    put into the list that is given. Whatever leaves must be made of these alone.
    After an error all is deleted."""
    left: list[DataFrame] = []
    written: list[DataFrame] = []
    token = _WRITTEN.set(written)
    try:
        yield left
    except BaseException:
        left.clear()
        raise
    finally:
        _WRITTEN.reset(token)
        paths = {df._settled for df in left}
        discard(*(df for df in written if df._settled not in paths))
        if (outer := _WRITTEN.get()) is not None:
            outer.extend(left)


#: Rows of one Arrow batch; with texts of 100 kB a batch stays near 25 MB.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Whole texts travel to Python: keep a batch of them small in memory."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def fold(id_col: str, modulus: int):
    """crc32 of the id written as text, modulo ``modulus`` (null id: -1)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus, F.lit(-1))


def sampled(hash64: Column, share) -> Column:
    """Is a uniform 64-bit hash within the lowest ``share`` (a number or a
    column, 0 to 1) of all values? Shares far below one in a billion rows still
    take their part."""
    share = share if isinstance(share, Column) else F.lit(float(share))
    # twice as much as there is at a share of one, so that rounding loses no row
    return F.shiftrightunsigned(hash64, 1).cast("double") < F.when(share >= 1, 2.0).otherwise(share) * float(1 << 63)


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores in front until no column (in any case) is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def kept(df, keep: list[str] | None, *made: str) -> list[str]:
    """The columns to pass on: ``keep``, or all; columns that are called like
    one that is made (in any case) are replaced by it."""
    gone = {m.lower() for m in made}
    return [c for c in (df.columns if keep is None else keep) if c.lower() not in gone]
