"""Outside services that are asked again and again, as streams of Spark with offsets.

A service answers `fetch(ticker, after, upto)` with the rows of a ticker whose time (epoch ms) is in (after, upto], and
`latest()` with the time up to which it has all rows.  An offset is such a time.  A batch asks for so many polls at most
from where the last one ended, a task a ticker, each with retries; a service that stays silent fails the batch, which
comes again from the checkpoint: nothing is lost, and nothing is asked for twice once its batch is in.

The place up to which batches are done is kept in a small file beside the checkpoint, in a store that driver hosts share, as
a restarted reader isn't told.  Without that file a stream that has a checkpoint stops rather than ask again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .readers import with_retry


class Service(Protocol):
    def latest(self) -> int: ...

    def fetch(self, ticker: str, after: int, upto: int) -> list[tuple]: ...


class Span(InputPartition):
    def __init__(self, ticker: str, after: int, upto: int) -> None:
        self.ticker, self.after, self.upto = ticker, after, upto


class Poller(DataSourceStreamReader):
    """poll_ms: time between polls; polls: most of them in a batch; start: where a new stream begins."""

    def __init__(self, service: Service, tickers: list[str], start: int, poll_ms: int, polls: int, cursor: str, attempts: int, wait: float) -> None:
        self.service, self.tickers, self.start, self.poll_ms, self.polls = service, tickers, start, poll_ms, polls
        self.cursor, self.attempts, self.wait = cursor, attempts, wait
        self.last: int | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"upto": self.start}

    def latestOffset(self) -> dict:  # noqa: N802
        """The end of the last poll that is over, and not further ahead than a batch may go."""
        if self.last is None:
            self.last = self._done()
        over = self.start + (self.service.latest() - self.start) // self.poll_ms * self.poll_ms
        self.last = max(self.last, min(over, self.last + self.polls * self.poll_ms))
        return {"upto": self.last}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        if end["upto"] < start["upto"]:
            raise ValueError(f"{self.cursor} is lost: write {json.dumps(start)} there and start from a new checkpoint")
        self.last = max(self.last or 0, end["upto"])
        return [Span(t, start["upto"], end["upto"]) for t in self.tickers] if end["upto"] > start["upto"] else []

    def read(self, partition: Span) -> Iterator[tuple]:
        """Poll by poll, each with retries."""
        for after in range(partition.after, partition.upto, self.poll_ms):
            import time

            rows = with_retry(self.service.fetch, partition.ticker, after, after + self.poll_ms, attempts=self.attempts, sleep=lambda s: time.sleep(s * self.wait))
            if rows is None:
                raise ConnectionError(f"no answer for {partition.ticker} after {after}")
            yield from rows

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.cursor)

    def commit(self, end: dict) -> None:
        store, path = self._store()
        store.create_dir(path.rpartition("/")[0], recursive=True)
        draft = f"{path}.{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as f:
            f.write(json.dumps(end).encode())
        store.move(draft, path)

    def _done(self) -> int:
        """At most a batch behind the checkpoint: what is offered first is then no more than what is in."""
        store, path = self._store()
        try:
            with store.open_input_stream(path) as f:
                return json.loads(f.readall())["upto"]
        except FileNotFoundError:
            return self.start

    def stop(self) -> None:
        pass


def polled(spark: SparkSession, name: str, service: Service, schema: str, tickers: list[str], cursor: str, start: int = 0, poll_ms: int = 60_000, polls: int = 10, attempts: int = 3, wait: float = 1.0) -> DataFrame:
    """A stream of what the service says.  cursor: the URI of a file that the driver can write, one for each stream; wait: how much of the seconds between retries to wait."""
    reader = Poller(service, tickers, start, poll_ms, polls, cursor, attempts, wait)

    class Feed(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
            return reader

    spark.dataSource.register(Feed)
    return spark.readStream.format(name).load()


class TableService:
    """A table of parquet files that answers as a service does, as far as it is told to know: for replays.

    rows: (ticker, time in ms, row) of the rows of a batch, in any order.  latest_only: of a poll the last row by time, then `row`.
    """

    def __init__(self, path: str, time: str, rows: Callable[[pa.RecordBatch], Iterator[tuple[str, int, tuple]]], known: int, latest_only: bool = False) -> None:
        self.path, self.time, self.rows, self.known, self.latest_only = path, time, rows, known, latest_only

    def latest(self) -> int:
        return self.known

    def fetch(self, ticker: str, after: int, upto: int) -> list[tuple]:
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        table = ds.dataset(self.path)
        unit = table.schema.field(self.time).type
        bound = lambda ms: pa.scalar(ms * 1000, pa.timestamp("us")).cast(unit)
        within = (pc.field(self.time) > bound(after)) & (pc.field(self.time) <= bound(upto))
        found = sorted((at, row) for b in table.to_batches(filter=within) for t, at, row in self.rows(b) if t == ticker)
        return [row for _, row in (found[-1:] if self.latest_only else found)]
