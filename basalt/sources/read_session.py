"""Read sessions: a pinned, projected, filtered snapshot, dealt into contiguous ranges that can be resumed."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import types
from ..catalog import Catalog, Ref
from ..errors import Invalid, NotFound, OutOfRange
from . import restriction as language
from .positions import Run, between, in_order, runs_of
from .storage import GENERATION, HIDDEN, ORDINAL

SESSION_SECONDS = 6 * 3600


@dataclass(frozen=True)
class Stream:
    name: str
    start: int
    end: int

    @property
    def rows(self) -> int:
        return self.end - self.start


@dataclass
class Session:
    name: str
    fields: tuple[types.Field, ...]
    streams: list[Stream]
    rows: int
    expires: float
    frame: DataFrame = field(repr=False)
    runs: list[Run] = field(repr=False)


def ranges(rows: int, count: int) -> list[tuple[int, int]]:
    """Contiguous ranges as even as can be, the larger ones first."""
    each, more = divmod(rows, count)
    out, at = [], 0
    for k in range(count):
        out.append((at, at := at + each + (k < more)))
    return out


class Reader:
    def __init__(self, catalog: Catalog, scratch: str, max_streams: int = 64, clock=time.time):
        self.catalog, self.scratch, self.max_streams, self.clock = catalog, scratch.rstrip("/"), max_streams, clock
        self.sessions: dict[str, Session] = {}

    def open(self, ref: Ref, columns: list[str] | None = None, restriction: str = "", streams: int = 4) -> Session:
        """A session on the table's present version: later writes don't show.

        Without a restriction the version's own files are the snapshot; with one the rows that pass are
        written once. Either way a stream is a range filter on the hidden order, which reaches the files.
        """
        if not 0 <= streams <= self.max_streams:
            raise Invalid(f"0 to {self.max_streams} streams")
        info = self.catalog.table(ref)
        chosen = info.fields
        if columns:
            wanted = {c.lower() for c in columns}
            if missing := wanted - {f.name.lower() for f in info.fields}:
                raise Invalid(f"unknown columns {', '.join(sorted(missing))}")
            chosen = tuple(f for f in info.fields if f.name.lower() in wanted)  # in the table's order
        frame = self.catalog.read(info, hidden=True)
        names = [f"`{f.name}`" for f in chosen]
        if restriction.strip():
            passed = frame.where(language.parse(restriction, info.fields)).select(*names)  # in the scan's order
            path = f"{self.scratch}/read-{uuid.uuid4().hex}"
            passed.withColumn(GENERATION, F.lit(0)).withColumn(ORDINAL, F.monotonically_increasing_id()).write.parquet(path)
            frame = self.catalog.spark.read.parquet(path)
        else:
            frame = frame.select(*names, *HIDDEN)
        runs, rows = runs_of(frame)
        name = uuid.uuid4().hex
        made = [Stream(f"{name}/{k}", a, b) for k, (a, b) in enumerate(ranges(rows, max(1, streams or 4)))]
        self.sessions[name] = Session(name, chosen, made, rows, self.clock() + SESSION_SECONDS, frame, runs)
        return self.sessions[name]

    def frame(self, stream: str, offset: int = 0) -> DataFrame:
        """The stream's rows from ``offset`` (relative to it) on, in order of position."""
        session, own = self._stream(stream)
        if not 0 <= offset <= own.rows:
            raise OutOfRange(f"offset {offset} of {own.rows} rows")
        return in_order(between(session.frame, session.runs, own.start + offset, own.end))

    def batches(self, stream: str, offset: int = 0, size: int = 10_000):
        """Arrow batches of bounded size with the share of the stream that is done: one job, and the driver holds a partition at a time."""
        session, own = self._stream(stream)
        kind = types.spark_schema(session.fields)
        from pyspark.sql.pandas.types import to_arrow_schema

        def packed(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, size):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, batch.schema) as out:
                        out.write_batch(batch.slice(at, size))
                    yield pa.RecordBatch.from_pydict({"batch": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        done = offset
        for row in self.frame(stream, offset).mapInArrow(packed, "batch binary").toLocalIterator(prefetchPartitions=True):
            got = pa.ipc.open_stream(row.batch).read_all().cast(to_arrow_schema(kind)).combine_chunks()
            done += len(got)
            yield got.to_batches()[0], done / own.rows

    def split(self, stream: str, fraction: float) -> tuple[Stream, Stream]:
        session, own = self._stream(stream)
        middle = own.start + int(own.rows * fraction)
        parts = Stream(f"{own.name}.a", own.start, middle), Stream(f"{own.name}.b", middle, own.end)
        session.streams = [s for s in session.streams if s != own] + list(parts)
        return parts

    def _stream(self, name: str) -> tuple[Session, Stream]:
        for key in [k for k, s in self.sessions.items() if s.expires <= self.clock()]:
            del self.sessions[key]
        session = self.sessions.get(name.split("/")[0])
        own = next((s for s in session.streams if s.name == name), None) if session else None
        if own is None:
            raise NotFound(f"stream {name}")
        return session, own
