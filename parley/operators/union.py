"""Union of datasets whose columns differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGERS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}  # decimal digits
_FLOATS = {T.FloatType: 5, T.DoubleType: 10}  # digits of the widest integers they hold exactly


class TypeClash(TypeError):
    """The same column has different types on the two sides."""


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The least type that holds all values of both without losing a digit; string where there is none.

    Integers and decimals widen among themselves, integers of up to 32 bits to double, dates to
    timestamps. Structs get the fields of both, by name, each of the common type of its own; arrays
    and maps go by their elements. The type of nulls is that of the other side.
    """
    if a.simpleString() == b.simpleString() or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    kinds = {type(a), type(b)}
    if kinds == {T.StructType}:
        fields = {f.name: f.dataType for f in a.fields}
        for field in b.fields:
            known = fields.get(field.name)
            fields[field.name] = common_type(known, field.dataType) if known is not None else field.dataType
        return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])
    if kinds == {T.ArrayType}:
        return T.ArrayType(common_type(a.elementType, b.elementType))
    if kinds == {T.MapType} and a.keyType == b.keyType:
        return T.MapType(a.keyType, common_type(a.valueType, b.valueType))
    if kinds <= set(_INTEGERS):
        return max((a, b), key=lambda t: _INTEGERS[type(t)])
    if kinds <= {*_INTEGERS, T.DecimalType}:
        parts = [(t.precision - t.scale, t.scale) if isinstance(t, T.DecimalType) else (_INTEGERS[type(t)], 0) for t in (a, b)]
        whole, scale = (max(p) for p in zip(*parts))
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.StringType()
    if kinds == set(_FLOATS):
        return T.DoubleType()
    if kinds <= {*_INTEGERS, *_FLOATS}:
        digits = max(_INTEGERS[k] for k in kinds if k in _INTEGERS)
        fitting = [k for k in _FLOATS if _FLOATS[k] >= digits]
        least = T.DoubleType if T.DoubleType in kinds else next(iter(fitting), None)
        return least() if least in fitting else T.StringType()
    if kinds == {T.DateType, T.TimestampType}:
        return T.TimestampType()
    return T.StringType()


def widened(column: Column, old: T.DataType, new: T.DataType) -> Column:
    """A column of type ``old`` as ``new``, its ``common_type`` with another."""
    if old == new:
        return column
    if isinstance(new, T.StructType) and isinstance(old, T.StructType):
        has = {f.name: f.dataType for f in old.fields}
        fields = [
            (widened(column[f.name], has[f.name], f.dataType) if f.name in has else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in new.fields
        ]
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(new, T.ArrayType) and isinstance(old, T.ArrayType):
        return F.transform(column, lambda x: widened(x, old.elementType, new.elementType))
    if isinstance(new, T.MapType) and isinstance(old, T.MapType):
        return F.transform_values(column, lambda _, x: widened(x, old.valueType, new.valueType))
    if isinstance(new, T.StringType) and isinstance(old, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(column)
    return column.cast(new)


def union_datasets(a: DataFrame, b: DataFrame, on_clash: str = "error") -> DataFrame:
    """All rows of both; columns missing on one side are null there.

    Types are compared first: left to itself a union would cast a string to a number
    and fail on some row. ``on_clash="string"`` casts such columns to string instead, and
    ``on_clash="widen"`` to the least type that holds the values of both (``common_type``).
    """
    types_a = {f.name: f.dataType for f in a.schema}
    types_b = {f.name: f.dataType for f in b.schema}
    clashes = [
        name
        for name in types_a
        if name in types_b and types_a[name].simpleString() != types_b[name].simpleString()
    ]
    if clashes and on_clash not in ("string", "widen"):
        raise TypeClash(f"columns of different types: {clashes}")
    if clashes and on_clash == "widen":
        kinds = {name: common_type(types_a[name], types_b[name]) for name in clashes}
        a = a.withColumns({n: widened(F.col(f"`{n}`"), types_a[n], kind) for n, kind in kinds.items()})
        b = b.withColumns({n: widened(F.col(f"`{n}`"), types_b[n], kind) for n, kind in kinds.items()})
    elif clashes:
        casts = {name: F.col(f"`{name}`").cast("string") for name in clashes}
        a, b = a.withColumns(casts), b.withColumns(casts)
    return a.unionByName(b, allowMissingColumns=True)


def column_set(*frames: DataFrame) -> list[str]:
    """Sorted names of all columns of the frames."""
    return sorted({name for frame in frames for name in frame.columns})


def union_columns(a: Column, b: Column) -> Column:
    """The same for column lists kept in a table."""
    return F.array_sort(F.array_union(a, b))
