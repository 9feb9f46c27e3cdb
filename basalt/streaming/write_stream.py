"""Write streams: rows staged under exact offsets, made visible for a group of streams at once.

A PENDING stream takes appends at the next offset only; the same append again is acknowledged without
effect. Finalizing freezes it. A group commit checks every stream first and then publishes all their staged
folders as one version, whose log entry names the group, so that a commit whose answer was lost is
recognised when it is tried again. The DEFAULT stream publishes each append by itself, at least once.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import types
from ..catalog import Catalog, Ref
from ..errors import AlreadyExists, Conflict, Invalid, NotFound, OutOfRange, Precondition, Unsupported


class Writer:
    def __init__(self, catalog: Catalog):
        self.catalog, self.files = catalog, catalog.files

    def create(self, ref: Ref, kind: str = "PENDING") -> str:
        if kind != "PENDING":
            raise Unsupported(f"{kind} streams aren't supported")
        info = self.catalog.table(ref)
        name = uuid.uuid4().hex
        ledger = {"table": [ref.project, ref.dataset, ref.table], "state": "OPEN", "fields": [f.json() for f in info.fields], "appends": []}
        self.files.create(f"streams/{name}/ledger.json", json.dumps(ledger))
        return name

    def get(self, name: str) -> dict:
        if not self.files.exists(f"streams/{name}/ledger.json"):
            raise NotFound(f"stream {name}")
        ledger = json.loads(self.files.read(f"streams/{name}/ledger.json"))
        return ledger | {"rows": sum(a["rows"] for a in ledger["appends"])}

    def append(self, name: str, rows: DataFrame, offset: int | None = None) -> int:
        """Stage rows at ``offset`` (the next one if None); returns the offset at which they stand."""
        ledger = self.get(name)
        if ledger["state"] != "OPEN":
            raise Precondition(f"stream {name} is {ledger['state']}")
        fields = tuple(map(types.Field.of, ledger["fields"]))
        shaped = types.conform(rows, fields)
        digest = self._digest(shaped)
        if offset is not None and offset < ledger["rows"]:
            at = 0
            for a in ledger["appends"]:
                if at == offset and a["digest"] == digest:
                    return offset  # the same append again
                at += a["rows"]
            raise AlreadyExists(f"offset {offset} has been written; the next is {ledger['rows']}")
        if offset is not None and offset > ledger["rows"]:
            raise OutOfRange(f"offset {offset}; the next is {ledger['rows']}")
        part = f"part-{len(ledger['appends']):06d}-{uuid.uuid4().hex}"
        shaped.write.parquet(f"{self.files.root}/streams/{name}/{part}")
        count = self.catalog.spark.read.parquet(f"{self.files.root}/streams/{name}/{part}").count()
        ledger["appends"].append({"part": part, "rows": count, "digest": digest})
        self._save(name, ledger)
        return ledger["rows"]

    def finalize(self, name: str) -> int:
        ledger = self.get(name)
        if ledger["state"] == "COMMITTED":
            raise Precondition(f"stream {name} is committed")
        self._save(name, ledger | {"state": "FINALIZED"})
        return ledger["rows"]

    def commit(self, ref: Ref, names: list[str]) -> int:
        """Publish finalized streams of one table together; returns the number of rows. All or nothing."""
        if not names or len(set(names)) != len(names):
            raise Invalid("name each stream once")
        group = hashlib.sha256("/".join(sorted(names)).encode()).hexdigest()
        info = self.catalog.table(ref)
        ledgers = {n: self.get(n) for n in names}
        rows = sum(x["rows"] for x in ledgers.values())
        if group not in info.state["commits"]:
            wrong = {n: x["state"] for n, x in ledgers.items() if x["state"] != "FINALIZED" or Ref(*x["table"]) != ref}
            if wrong:
                raise Precondition("; ".join(f"stream {n} is {s} or of another table" for n, s in sorted(wrong.items())))
            paths = [f"{self.files.root}/streams/{n}/{a['part']}" for n, x in ledgers.items() for a in x["appends"] if a["rows"]]
            kind = types.spark_schema(tuple(map(types.Field.of, ledgers[names[0]]["fields"])))
            staged = self.catalog.spark.read.schema(kind).parquet(*paths) if paths else self.catalog.spark.createDataFrame([], kind)

            def prove(written: int) -> None:
                if written != rows:
                    raise Conflict(f"{written} rows of {rows} were written")

            self.catalog.publish(info, staged, append=True, commit=group, prove=prove)
        for n, x in ledgers.items():  # after a lost answer this alone is left to do
            self._save(n, x | {"state": "COMMITTED"})
        return rows

    def append_default(self, ref: Ref, rows: DataFrame, offset: int | None = None) -> int:
        if offset is not None:
            raise Invalid("the default stream has no offsets")
        before = self.catalog.table(ref)
        return self.catalog.publish(before, rows, append=True).rows - before.rows

    def sink(self, ref: Ref, query: str):
        """A function for ``writeStream.foreachBatch``: each batch becomes visible exactly once."""

        def write(batch: DataFrame, batch_id: int) -> None:
            key = f"{query}/{batch_id}"
            info = self.catalog.table(ref)
            if key not in info.state["commits"]:
                self.catalog.publish(info, batch, append=True, commit=key)

        return write

    def _save(self, name: str, ledger: dict) -> None:
        self.files.put(f"streams/{name}/ledger.json", json.dumps({k: v for k, v in ledger.items() if k != "rows"}))

    @staticmethod
    def _digest(rows: DataFrame) -> str:
        """Of the rows as a multiset: equal for the same rows in any order."""
        h = F.xxhash64(*[F.to_json(F.struct(c)) if isinstance(rows.schema[c].dataType, types.T.MapType) else F.col(f"`{c}`") for c in rows.columns])
        r = rows.agg(F.count("*").alias("n"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("a"), F.bit_xor(h).alias("b")).first()
        return f"{r.n}-{r.a}-{r.b}"
