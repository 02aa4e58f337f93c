"""Value types, their order across types, exact rationals, and the tagged lane.

Columns are typed: STRING, BOOLEAN and BIGINT (numbers, entity ids, instants in
milliseconds). Values of different types compare by the order of their types,
never with an error. A column of mixed types is a *tagged lane*: a struct whose
first field is the type's rank, so that it sorts and groups in the same order.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factflow.errors import IncorrectError

#: Types in their order; fixed values of the wire format.
TYPE_ORDER = ("Aid", "String", "Bool", "Number", "Rational32", "Eid", "Instant", "Uuid", "Real")
RANK = {name: rank for rank, name in enumerate(TYPE_ORDER)}

#: Spark type of each value type.
SPARK_TYPE = {
    "Aid": T.StringType(),
    "String": T.StringType(),
    "Bool": T.BooleanType(),
    "Number": T.LongType(),
    "Rational32": T.StructType([T.StructField("num", T.LongType()), T.StructField("den", T.LongType())]),
    "Eid": T.LongType(),
    "Instant": T.LongType(),
    "Uuid": T.StringType(),
    "Real": T.IntegerType(),
}
_MAX_EID = (1 << 63) - 1
_REAL_ONE = 1 << 16


def decode(value: Any) -> tuple[str, Any]:
    """(type name, Python value) of a tagged JSON value; an untagged string,
    boolean or integer is a String, Bool or Number."""
    if isinstance(value, dict):
        if len(value) != 1:
            raise IncorrectError(f"not a value: {value!r}")
        [(tag, payload)] = value.items()
        if tag not in RANK:
            raise IncorrectError(f"unknown value type {tag!r}")
        if tag == "Eid" and not 0 <= int(payload) <= _MAX_EID:
            raise IncorrectError("entity ids run from 0 to 2^63 - 1")
        if tag == "Real":
            return tag, real(payload)
        return tag, payload
    if isinstance(value, bool):
        return "Bool", value
    if isinstance(value, str):
        return "String", value
    if isinstance(value, int):
        return "Number", value
    raise IncorrectError(f"not a value: {value!r}")


def encode(tag: str, value: Any) -> Any:
    """JSON of a result value: entity ids are strings, as map keys are."""
    return str(value) if tag == "Eid" else value


def real(x: float) -> int:
    """Fixed point with 16 fractional bits."""
    scaled = int(x * _REAL_ONE)
    if not -(1 << 31) <= scaled < 1 << 31:
        raise IncorrectError(f"{x} is out of a Real's range")
    return scaled


def tagged(tag: str, column: Column) -> Column:
    """The tagged lane of a typed column: equal types compare by payload, others
    by rank. Unused payload fields are null and equal."""
    s = column if tag in ("Aid", "String", "Uuid") else F.lit(None)
    n = column.cast("long") if tag in ("Number", "Eid", "Instant", "Real", "Bool") else F.lit(None)
    return F.struct(F.lit(RANK[tag]).alias("tag"), s.cast("string").alias("s"), n.cast("long").alias("n"))


def as_text(column: Column, kind: T.DataType) -> Column:
    """A value as text, as paths and map keys show it."""
    if isinstance(kind, T.StructType) and kind.fieldNames() == ["tag", "s", "n"]:
        flag = F.when(column["n"] == 1, "true").otherwise("false")
        return F.when(column["tag"] == RANK["Bool"], flag).otherwise(F.coalesce(column["s"], column["n"].cast("string")))
    if isinstance(kind, T.StructType):
        return F.concat_ws("/", column["num"], column["den"])
    return column.cast("string")


#: Where a column's metadata has its value type.
TYPE_KEY = "value_type"


class Typed(int):
    """A constant of a type that shares its Spark type with Number."""

    def __new__(cls, tag: str, value: int):
        out = super().__new__(cls, value)
        out.tag = tag
        return out


def typed(column: Column, name: str, tag: str | None) -> Column:
    """The column under a name, known to be of a value type."""
    return column.alias(name) if tag is None else column.alias(name, metadata={TYPE_KEY: tag})


def type_rank(df: DataFrame, name: str) -> int:
    """Order of a column's value type; where it is not told, of its Spark type."""
    field = df.schema[name]
    if TYPE_KEY in field.metadata:
        return RANK[field.metadata[TYPE_KEY]]
    kind = field.dataType
    if isinstance(kind, T.StringType):
        return RANK["String"]
    if isinstance(kind, T.BooleanType):
        return RANK["Bool"]
    if isinstance(kind, T.StructType):
        return RANK["Rational32"]
    return RANK["Number"]


def literal_rank(value: Any) -> int:
    if isinstance(value, Typed):
        return RANK[value.tag]
    if isinstance(value, bool):
        return RANK["Bool"]
    return RANK["String"] if isinstance(value, str) else RANK["Number"]


def rational(num: Column, den: Column) -> Column:
    """The reduced fraction as struct(num, den), den > 0; Euclid's steps on two
    64-bit numbers are at most 92."""
    start = F.struct(F.abs(num).cast("long").alias("a"), F.abs(den).cast("long").alias("b"))
    gcd = F.aggregate(
        F.sequence(F.lit(1), F.lit(92)), start,
        lambda acc, _: F.when(acc["b"] == 0, acc).otherwise(F.struct(acc["b"].alias("a"), (acc["a"] % acc["b"]).alias("b"))),
        lambda acc: F.greatest(acc["a"], F.lit(1)),
    )
    sign = F.when(den < 0, -1).otherwise(1)
    pair = F.struct((num * sign).cast("long").alias("p"), (den * sign).cast("long").alias("q"), gcd.alias("g"))
    return F.transform(F.array(pair), lambda x: F.struct(_div(x["p"], x["g"]).alias("num"), _div(x["q"], x["g"]).alias("den")))[0]


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)
