"""Load jobs: object listing, format readers, and columns matched by name and cast by a whitelist."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .. import types
from ..errors import Invalid, NotFound, Precondition, Unsupported

#: Spark kinds that each logical type takes from a file.
TAKES = {
    "BOOL": (T.BooleanType,),
    "INT64": (T.IntegralType,),
    "FLOAT64": (T.FractionalType, T.IntegralType),
    "NUMERIC": (T.DecimalType, T.IntegralType),
    "BIGNUMERIC": (T.DecimalType, T.IntegralType),
    "STRING": (T.StringType,),
    "BYTES": (T.BinaryType,),
    "DATE": (T.DateType,),
    "DATETIME": (T.TimestampNTZType,),
    "TIME": (T.TimeType,),
    "TIMESTAMP": (T.TimestampType, T.TimestampNTZType),
    "JSON": (T.StringType,),
    "RECORD": (T.StructType,),
}
FORMATS = ("PARQUET", "CSV", "NEWLINE_DELIMITED_JSON", "ORC")


def listed(spark: SparkSession, uris: list[str], most: int = 10_000) -> list[str]:
    """Objects of the URIs, sorted, each once. ``*`` and ``?`` match within a name; ``**`` and braces are refused."""
    out: dict[str, None] = {}
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for uri in uris:
        if "**" in uri or re.search(r"[{}]", uri):
            raise Invalid(f"{uri}: only * and ? match names")
        where = jvm.org.apache.hadoop.fs.Path(uri)
        fs = where.getFileSystem(conf)
        found = fs.globStatus(where) if re.search(r"[*?\[]", uri) else [fs.getFileStatus(where)] if fs.exists(where) else []
        paths = sorted(s.getPath().toString() for s in found or [] if fnmatch.fnmatch(s.getPath().getName(), uri.rsplit("/", 1)[-1]))
        if not paths:
            raise NotFound(f"no object matches {uri}")
        out |= dict.fromkeys(paths)
    if len(out) > most:
        raise Precondition(f"{len(out)} objects; the limit is {most}")
    return list(out)


def read(spark: SparkSession, paths: list[str], kind: str, fields: tuple[types.Field, ...], options: dict | None = None) -> DataFrame:
    """Rows of the files; text formats are read by the table's own schema, never by guessing."""
    if kind == "AVRO":
        raise Unsupported("AVRO needs a reader that isn't part of the plain distribution")
    if kind not in FORMATS:
        raise Invalid(f"unknown format {kind!r}")
    reader = spark.read.options(**(options or {}))
    if kind == "PARQUET":
        return matched(reader.parquet(*paths), fields)
    if kind == "ORC":
        return matched(reader.orc(paths), fields)
    strict = reader.option("mode", "FAILFAST").schema(types.spark_schema(fields))
    return strict.csv(paths) if kind == "CSV" else strict.json(paths)


def matched(df: DataFrame, fields: tuple[types.Field, ...]) -> DataFrame:
    """Raise unless every column belongs to a field, in a kind that the field takes, without narrowing a decimal."""
    own = {f.name.lower(): f for f in fields}

    def check(name: str, kind: T.DataType, f: types.Field | None) -> None:
        if f is None:
            raise Precondition(f"column {name} isn't in the table")
        if (f.mode == "REPEATED") != isinstance(kind, T.ArrayType):
            raise Precondition(f"{name}: repeated and single values differ")
        kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
        if not isinstance(kind, TAKES[f.type]):
            raise Precondition(f"{name}: {kind.simpleString()} isn't {f.type}")
        if isinstance(kind, T.DecimalType):
            if f.type not in types.DECIMALS:
                raise Precondition(f"{name}: a decimal isn't {f.type}")
            to = f.decimal()
            if kind.scale > to.scale or kind.precision - kind.scale > to.precision - to.scale:
                raise Unsupported(f"{name}: a decimal would be narrowed")
        if isinstance(kind, T.StructType):
            inner = {g.name.lower(): g for g in f.fields}
            for g in kind.fields:
                check(f"{name}.{g.name}", g.dataType, inner.get(g.name.lower()))

    for c in df.schema.fields:
        check(c.name, c.dataType, own.get(c.name.lower()))
    for f in fields:
        if f.mode == "REQUIRED" and f.name.lower() not in {c.lower() for c in df.columns}:
            raise Precondition(f"REQUIRED field {f.name} is missing")
    return df
