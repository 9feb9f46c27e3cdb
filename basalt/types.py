"""Logical fields and their Spark types; how values are brought to a declared schema."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import Invalid, Precondition, Unsupported

ALIASES = {"BOOLEAN": "BOOL", "INTEGER": "INT64", "FLOAT": "FLOAT64", "DECIMAL": "NUMERIC", "BIGDECIMAL": "BIGNUMERIC", "STRUCT": "RECORD"}
SCALARS = {
    "BOOL": T.BooleanType(),
    "INT64": T.LongType(),
    "FLOAT64": T.DoubleType(),
    "STRING": T.StringType(),
    "BYTES": T.BinaryType(),
    "DATE": T.DateType(),
    "DATETIME": T.TimestampNTZType(),
    "TIMESTAMP": T.TimestampType(),
    "JSON": T.StringType(),
}
#: Largest scale and largest number of integer digits.
DECIMALS = {"NUMERIC": (38, 9, 9, 29), "BIGNUMERIC": (38, 18, 38, 38)}
MODES = ("NULLABLE", "REQUIRED", "REPEATED")
ROUNDING = ("ROUND_HALF_AWAY_FROM_ZERO", "ROUND_HALF_EVEN")
MAX_DEPTH = 15
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,299}")


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    mode: str = "NULLABLE"
    precision: int | None = None
    scale: int | None = None
    rounding: str = ROUNDING[0]
    description: str = ""
    fields: tuple[Field, ...] = field(default=())

    @staticmethod
    def of(spec: dict) -> Field:
        kind = spec["type"].upper()
        return Field(spec["name"], ALIASES.get(kind, kind), spec.get("mode", "NULLABLE").upper(), spec.get("precision"), spec.get("scale"), spec.get("rounding", ROUNDING[0]), spec.get("description", ""), tuple(map(Field.of, spec.get("fields", ()))))

    def json(self) -> dict:
        out = {"name": self.name, "type": self.type, "mode": self.mode}
        out |= {k: v for k, v in (("precision", self.precision), ("scale", self.scale), ("description", self.description)) if v not in (None, "")}
        if self.rounding != ROUNDING[0]:
            out["rounding"] = self.rounding
        return out | ({"fields": [f.json() for f in self.fields]} if self.fields else {})

    def decimal(self) -> T.DecimalType:
        precision, scale, most_scale, most_whole = DECIMALS[self.type]
        if self.precision is not None:
            precision, scale = self.precision, self.scale or 0
        elif self.scale is not None:
            raise Invalid(f"{self.name}: a scale needs a precision")
        if not 1 <= precision <= 38 or not 0 <= scale <= min(most_scale, precision) or self.precision is not None and precision - scale > most_whole:
            raise Invalid(f"{self.name}: {self.type}({precision},{scale}) is out of range")
        return T.DecimalType(precision, scale)

    def element(self) -> T.DataType:
        """The Spark type of one value, whatever the mode."""
        if self.type in DECIMALS:
            return self.decimal()
        if self.type == "TIME":
            return T.TimeType(6)
        if self.type == "RECORD":
            return T.StructType([T.StructField(f.name, f.spark(), True) for f in self.fields])
        return SCALARS[self.type]

    def spark(self) -> T.DataType:
        return T.ArrayType(self.element(), True) if self.mode == "REPEATED" else self.element()


def validate(fields: tuple[Field, ...], depth: int = 1) -> tuple[Field, ...]:
    if depth > MAX_DEPTH:
        raise Invalid(f"records nest more than {MAX_DEPTH} deep")
    if not fields:
        raise Invalid("a record needs a field")
    seen: set[str] = set()
    for f in fields:
        if not NAME.fullmatch(f.name):
            raise Invalid(f"bad field name {f.name!r}")
        if f.name.lower() in seen:
            raise Invalid(f"duplicate field {f.name!r}")
        seen.add(f.name.lower())
        if f.mode not in MODES:
            raise Invalid(f"{f.name}: bad mode {f.mode!r}")
        if f.rounding not in ROUNDING:
            raise Invalid(f"{f.name}: bad rounding mode {f.rounding!r}")
        if f.type == "RECORD":
            validate(f.fields, depth + 1)
        elif f.type == "GEOGRAPHY":
            raise Unsupported(f"{f.name}: GEOGRAPHY isn't supported")
        elif f.type in DECIMALS:
            f.decimal()
        elif f.type not in SCALARS and f.type != "TIME":
            raise Invalid(f"{f.name}: unknown type {f.type!r}")
        elif f.fields or f.precision is not None or f.scale is not None:
            raise Invalid(f"{f.name}: {f.type} takes no fields, precision or scale")
    return fields


def schema(*specs: dict | Field) -> tuple[Field, ...]:
    return validate(tuple(s if isinstance(s, Field) else Field.of(s) for s in specs))


def spark_schema(fields: tuple[Field, ...]) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.spark(), True) for f in fields])


def inferred(of: T.StructType, hints: dict[str, Field] | None = None) -> tuple[Field, ...]:
    """Logical fields of a result; ``hints`` (by lower-case name) keep a declared field whose Spark type is the same."""

    def one(name: str, kind: T.DataType, required: bool = False) -> Field:
        hint = (hints or {}).get(name.lower())
        if hint is not None and hint.spark() == nullable(kind):
            return replace(hint, name=name, mode=hint.mode if hint.mode == "REPEATED" else "NULLABLE")
        if isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, T.ArrayType):
                raise Unsupported(f"{name}: arrays of arrays aren't supported")
            return replace(one(name, kind.elementType), mode="REPEATED")
        if isinstance(kind, T.StructType):
            return Field(name, "RECORD", fields=tuple(one(f.name, f.dataType) for f in kind.fields))
        if isinstance(kind, T.DecimalType):
            wide = kind.scale > 9 or kind.precision - kind.scale > 29
            return Field(name, "BIGNUMERIC" if wide else "NUMERIC", precision=kind.precision, scale=kind.scale)
        if isinstance(kind, T.IntegralType):
            return Field(name, "INT64")
        if isinstance(kind, T.FractionalType):
            return Field(name, "FLOAT64")
        if isinstance(kind, T.TimeType):
            return Field(name, "TIME")
        for logical, spark in SCALARS.items():
            if spark == kind:
                return Field(name, logical)
        if isinstance(kind, T.NullType):
            return Field(name, "INT64")
        raise Unsupported(f"{name}: {kind.simpleString()} has no logical type")

    return tuple(one(f.name, f.dataType) for f in of.fields)


def nullable(kind: T.DataType) -> T.DataType:
    """The type with every null allowed: what a declared field's type is compared to."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType), True)
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType), True) for f in kind.fields])
    return kind


def rounded(value: Column, f: Field) -> Column:
    """To the field's decimal: exact rounding in its mode, then an overflow is an error."""
    kind = f.decimal()
    apply = F.bround if f.rounding == ROUNDING[1] else F.round
    return apply(value, kind.scale).cast(kind)


def integer(value: Column) -> Column:
    """CAST to INT64 as the query language has it: halves away from zero, not truncation."""
    return F.round(value).cast("long")


def brought(value: Column, have: T.DataType, f: Field) -> Column:
    """One value (or array) as the field has it: cast, rounded, REQUIRED and null elements checked."""
    if f.mode == "REPEATED":
        if not isinstance(have, T.ArrayType):
            raise Precondition(f"{f.name}: an array is needed")
        item = replace(f, mode="REQUIRED")
        return F.coalesce(F.transform(value, lambda x: brought(x, have.elementType, item)), F.array().cast(f.spark()))
    if f.type == "RECORD":
        if not isinstance(have, T.StructType):
            raise Precondition(f"{f.name}: a record is needed")
        own = {h.name.lower(): h for h in have.fields}
        if len(have.fields) == len(f.fields) and not own.keys() & {x.name.lower() for x in f.fields}:
            own = {x.name.lower(): h for x, h in zip(f.fields, have.fields, strict=True)}  # an unnamed record: by position
        parts = []
        for inner in f.fields:
            h = own.get(inner.name.lower())
            got = brought(value[h.name], h.dataType, inner) if h else brought(F.lit(None).cast(inner.spark()), inner.spark(), inner)
            parts.append(got.alias(inner.name))
        out = F.when(value.isNotNull(), F.struct(*parts))
    elif f.type in DECIMALS:
        out = rounded(value if isinstance(have, T.NumericType) and not isinstance(have, T.FractionalType) or isinstance(have, T.DecimalType) else value.cast(T.DecimalType(38, min(18, f.decimal().scale + 9))), f)
    elif f.type == "INT64" and isinstance(have, T.FractionalType):
        out = integer(value)
    else:
        out = value.cast(f.element())
    if f.mode == "REQUIRED":
        out = F.when(out.isNull(), F.raise_error(F.lit(f"REQUIRED field {f.name} is null")).cast(f.element())).otherwise(out)
    return out


def conform(df: DataFrame, fields: tuple[Field, ...], by_name: bool = True, beside: str | None = None) -> DataFrame:
    """``df`` as rows of the schema: by name without regard to case (missing columns are null), or by position.

    A column ``beside`` stays as it is, after them.
    """
    have = [h for h in df.schema.fields if h.name != beside]
    df = df.select(*[f"`{h.name}`" for h in have], beside) if beside else df
    if not by_name and len(have) != len(fields):
        raise Precondition(f"{len(have)} columns for {len(fields)} fields")
    own = {h.name.lower(): (i, h) for i, h in enumerate(have)}
    if by_name and (extra := own.keys() - {f.name.lower() for f in fields}):
        raise Precondition(f"unknown columns: {', '.join(sorted(extra))}")
    plain = df.toDF(*[f"c{i}" for i in range(len(have))], *[beside] * bool(beside))
    out = []
    for i, f in enumerate(fields):
        at = own.get(f.name.lower()) if by_name else (i, have[i])
        value, kind = (F.col(f"c{at[0]}"), at[1].dataType) if at else (F.lit(None).cast(f.spark()), f.spark())
        out.append(brought(value, kind, f).alias(f.name))
    return plain.select(*out, *[beside] * bool(beside))


def same_shape(result: tuple[Field, ...], target: tuple[Field, ...]) -> None:
    """Raise unless a result's fields are the target's: names in order, types, modes, nested fields."""
    if len(result) != len(target):
        raise Precondition(f"{len(result)} columns for {len(target)} fields")
    for a, b in zip(result, target, strict=True):
        if a.name.lower() != b.name.lower():
            raise Precondition(f"column {a.name} stands where {b.name} should")
        if (a.mode == "REPEATED") != (b.mode == "REPEATED"):
            raise Precondition(f"{a.name}: {a.mode} isn't {b.mode}")
        if a.type in DECIMALS and b.type in DECIMALS:
            x, y = a.decimal(), b.decimal()
            if x.scale > y.scale or x.precision - x.scale > y.precision - y.scale:
                raise Unsupported(f"{a.name}: a decimal would be narrowed")
        elif a.type != b.type and not {a.type, b.type} == {"STRING", "JSON"}:
            raise Precondition(f"{a.name}: {a.type} isn't {b.type}")
        if a.type == "RECORD":
            same_shape(a.fields, b.fields)


def evolved(old: tuple[Field, ...], new: tuple[Field, ...], path: str = "") -> None:
    """Raise unless ``new`` only appends NULLABLE or REPEATED fields to ``old``, at every level."""
    if len(new) < len(old):
        raise Precondition(f"{path or 'schema'}: fields can't be removed")
    for a, b in zip(old, new, strict=False):
        if (a.name, a.type, a.mode, a.precision, a.scale, a.rounding) != (b.name, b.type, b.mode, b.precision, b.scale, b.rounding):
            raise Precondition(f"{path}{a.name}: an existing field can't change or move")
        if a.type == "RECORD":
            evolved(a.fields, b.fields, f"{path}{a.name}.")
    for f in new[len(old) :]:
        if f.mode == "REQUIRED":
            raise Precondition(f"{path}{f.name}: a new field can't be REQUIRED")
