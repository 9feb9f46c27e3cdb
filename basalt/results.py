"""Result columns, pages and cells."""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import json
import math
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import Invalid
from .types import NAME, Field

EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
PAGE_ROWS, PAGE_BYTES = 10_000, 10_000_000


def portable(names: list[str]) -> list[str]:
    """Columns without a usable or unique name become f<place>_, with a number after it on a collision."""
    taken = {n.lower() for n in names if NAME.fullmatch(n)}
    out, used = [], set()
    for i, n in enumerate(names):
        if NAME.fullmatch(n) and n.lower() not in used:
            out.append(n)
        else:
            new, k = f"f{i}_", 1
            while new in taken or new in used:
                new, k = f"f{i}_{k}", k + 1
            out.append(new)
        used.add(out[-1].lower())
    return out


def named(df: DataFrame) -> DataFrame:
    return df.toDF(*portable(df.columns))


def cell(value, field: Field, micros: bool = False):
    """One value as JSON has it: integers and booleans as text, records and arrays as f/v objects."""
    if field.mode == "REPEATED":
        item = Field(field.name, field.type, "NULLABLE", field.precision, field.scale, field.rounding, fields=field.fields)
        return [{"v": cell(v, item, micros)} for v in value or []]
    if value is None:
        return None
    if field.type == "RECORD":
        return {"f": [{"v": cell(value[i], f, micros)} for i, f in enumerate(field.fields)]}
    if field.type == "BOOL":
        return "true" if value else "false"
    if field.type == "INT64":
        return str(value)
    if field.type == "FLOAT64":
        return value if math.isfinite(value) else "NaN" if math.isnan(value) else "Infinity" if value > 0 else "-Infinity"
    if field.type in ("NUMERIC", "BIGNUMERIC"):
        return format(Decimal(value), "f")
    if field.type == "BYTES":
        return base64.b64encode(bytes(value)).decode()
    if field.type == "DATE":
        return value.isoformat()
    if field.type == "TIME":
        return value.strftime("%H:%M:%S") + _fraction(value.microsecond)
    if field.type == "DATETIME":
        return value.strftime("%Y-%m-%dT%H:%M:%S") + _fraction(value.microsecond)
    if field.type == "TIMESTAMP":
        moment = value.replace(tzinfo=dt.timezone.utc) if value.tzinfo is None else value
        total = (moment - EPOCH) // dt.timedelta(microseconds=1)
        if micros:
            return str(total)
        whole, part = divmod(abs(total), 1_000_000)
        return ("-" if total < 0 else "") + f"{whole}.{part:06d}"
    return str(value)


def _fraction(micros: int) -> str:
    return f".{micros:06d}".rstrip("0") if micros else ""


def page(read: Callable[[int, int], DataFrame], fields: tuple[Field, ...], rows: int, offset: int, limit: int = PAGE_ROWS, micros: bool = False) -> list[dict]:
    """Rows from ``offset`` in the table's stable order, at most ``limit``; ``read`` gives those of positions from and to before."""
    if offset < 0 or limit < 0:
        raise Invalid("offset and limit are not negative")
    limit = min(limit, PAGE_ROWS)
    if offset >= rows or not limit:
        return []
    got = read(offset, min(rows, offset + limit)).collect()
    out, size = [], 0
    for row in got:
        made = {"f": [{"v": cell(row[i], f, micros)} for i, f in enumerate(fields)]}
        size += len(json.dumps(made))
        if out and size > PAGE_BYTES:
            break
        out.append(made)
    return out


def token(offset: int, *bound: object) -> str:
    """A page token that holds for one job, schema and row count only."""
    check = hashlib.sha256(json.dumps([offset, *map(str, bound)]).encode()).hexdigest()[:16]
    return base64.urlsafe_b64encode(f"{offset}.{check}".encode()).decode()


def offset_of(text: str, *bound: object) -> int:
    try:
        offset = int(base64.urlsafe_b64decode(text.encode()).decode().split(".")[0])
    except ValueError as e:
        raise Invalid("bad page token") from e
    if token(offset, *bound) != text:
        raise Invalid("the page token belongs to another result")
    return offset


def packed_datetime(column: str):
    """DATETIME (as an NTZ timestamp) of packed civil bits: micros 20, second 6, minute 6, hour 5, day 5, month 4, year 14."""
    at, out = 0, {}
    for name, bits in (("micros", 20), ("second", 6), ("minute", 6), ("hour", 5), ("day", 5), ("month", 4), ("year", 14)):
        out[name] = F.shiftright(column, at).bitwiseAND(F.lit((1 << bits) - 1))
        at += bits
    ok = (out["micros"] < 1_000_000) & (out["second"] < 60) & (out["minute"] < 60) & (out["hour"] < 24) & out["day"].between(1, 31) & out["month"].between(1, 12) & out["year"].between(1, 9999)
    seconds = (out["second"] + out["micros"] / F.lit(1_000_000)).cast("decimal(16,6)")
    made = F.make_timestamp_ntz(out["year"].cast("int"), out["month"].cast("int"), out["day"].cast("int"), out["hour"].cast("int"), out["minute"].cast("int"), seconds)
    return F.when(ok, made).otherwise(F.raise_error(F.lit("bad packed DATETIME")).cast("timestamp_ntz"))
