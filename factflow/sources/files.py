"""Files as attributes: CSV, line-wise JSON, Parquet. One DataFrame of pairs per
attribute; Spark splits the files among its tasks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factflow.errors import IncorrectError
from factflow.functions.values import SPARK_TYPE
from factflow.operators.attributes import TIME, AttributeConfig

#: Value types that a CSV column may have.
CSV_TYPES = ("String", "Number", "Eid")


@dataclass(frozen=True)
class CsvFile:
    """``schema``: attribute -> (column number, value type). ``eid_offset`` is
    the entity's column, ``timestamp_offset`` one of milliseconds that become
    the changes' time (without it: the epoch of arrival)."""

    path: str
    schema: dict[str, tuple[int, str]]
    eid_offset: int = 0
    has_headers: bool = False
    delimiter: str = ","
    comment: str | None = None
    timestamp_offset: int | None = None
    max_files_per_trigger: int | None = None

    def _columns(self) -> int:
        used = [self.eid_offset, *(c for c, _ in self.schema.values())]
        if self.timestamp_offset is not None:
            used.append(self.timestamp_offset)
        return max(used) + 1

    def _schema(self) -> T.StructType:
        kinds = {self.eid_offset: T.LongType()}
        for name, (column, kind) in self.schema.items():
            if kind not in CSV_TYPES:
                raise IncorrectError(f"{name}: a CSV column is one of {CSV_TYPES}, not {kind!r}")
            kinds.setdefault(column, SPARK_TYPE[kind])
        if self.timestamp_offset is not None:
            kinds.setdefault(self.timestamp_offset, T.LongType())
        return T.StructType([T.StructField(f"c{k}", kinds.get(k, T.StringType())) for k in range(self._columns())])

    def _options(self) -> dict[str, str]:
        out = {"header": str(self.has_headers).lower(), "delimiter": self.delimiter, "mode": "FAILFAST", "enforceSchema": "true"}
        return out | ({"comment": self.comment} if self.comment else {})

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self._schema()).options(**self._options()).csv(self.path)

    def stream(self, spark: SparkSession) -> DataFrame:
        reader = spark.readStream.schema(self._schema()).options(**self._options())
        if self.max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", self.max_files_per_trigger)
        return reader.csv(self.path)

    def pairs(self, rows: DataFrame, name: str) -> DataFrame:
        column = self.schema[name][0]
        out = rows.select(F.col(f"c{self.eid_offset}").alias("e"), F.col(f"c{column}").alias("v"), *(
            [F.col(f"c{self.timestamp_offset}").alias(TIME)] if self.timestamp_offset is not None else []))
        return out.where("e IS NOT NULL AND v IS NOT NULL")

    def configs(self) -> dict[str, AttributeConfig]:
        return {n: AttributeConfig.real_time("Distinct", value_type=kind) for n, (_, kind) in self.schema.items()}


@dataclass(frozen=True)
class JsonFile:
    """One object per line; the entity is the line's number, counted from 0 over
    the files in order. ``schema``: attribute (a top-level key) -> value type.
    A line without the key has no fact."""

    path: str
    schema: dict[str, str]

    def read(self, spark: SparkSession) -> DataFrame:
        for name, kind in self.schema.items():
            if kind not in ("String", "Number", "Bool"):
                raise IncorrectError(f"{name}: a JSON value is a String, Number or Bool, not {kind!r}")
        lines = spark.read.text(self.path).withColumn("_at", F.monotonically_increasing_id())
        # numbers without gaps: how many lines stand in the partitions before
        part = F.shiftright("_at", 33)
        sizes = lines.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
        from pyspark.sql import Window as W

        before = sizes.withColumn("_before", F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)))
        kind = T.StructType([T.StructField(n, SPARK_TYPE[k]) for n, k in self.schema.items()])
        numbered = lines.withColumn("_p", part).join(F.broadcast(before), "_p")  # a row per partition
        eid = F.coalesce("_before", F.lit(0)) + (F.col("_at") - F.shiftleft(F.col("_p"), 33))
        return numbered.select(eid.alias("e"), F.from_json("value", kind, {"mode": "FAILFAST"}).alias("o"))

    def pairs(self, rows: DataFrame, name: str) -> DataFrame:
        return rows.select("e", F.col("o").getField(name).alias("v")).where("v IS NOT NULL")

    def configs(self) -> dict[str, AttributeConfig]:
        return {n: AttributeConfig.real_time("Distinct", value_type=kind) for n, kind in self.schema.items()}


@dataclass(frozen=True)
class ParquetTable:
    """A wide Parquet table: attributes are columns (or SQL expressions) of the
    entities that its key column names."""

    path: str
    key: str
    attributes: dict[str, str]
    unique: bool = True

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)
