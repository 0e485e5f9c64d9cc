"""A connector for paged bars: a Python data source that reads (symbol, time slice) partitions page by page.

A store holds ``<path>/<symbol>/<from>-<to>.json``: pages of bars as JSON lines [open time in ms, open, high, low,
close, volume], for the open times of its name, both included. Pages may overlap, be empty or leave holes, as answers
of an exchange do. Each partition calls for the pages that reach into its slice and keeps each time once; a call that
fails for a while is repeated, and a partition that needs more calls than its budget fails rather than hammer the store.

    BarPages.register(spark)
    spark.read.format("bar_pages").option("slice_days", 30).load("/data/pages").where("symbol = 'BTCUSDT' and ts >= '2024-01-01'")

Limits of symbol and time reach the source as pushed filters: other symbols and slices become no partition.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from tidegauge.schema import BARS
from tidegauge.sources.bars import SourceError

_DAY_MS = 86_400_000
_FOREVER = 1 << 62


class RateLimit(SourceError):
    """A partition used up its calls."""


class ConnectionLost(SourceError):
    """A page could not be read, however often it was asked for."""


class PageStore:
    """Pages of a folder that pyarrow can reach (a path, or a URI of a local or remote file system)."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def _names(self, folder: str, kind: str) -> list[str]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return [i.base_name for i in found if i.type == getattr(fs.FileType, kind)]

    def symbols(self) -> list[str]:
        return sorted(self._names(self.root, "Directory"))

    def spans(self, symbol: str) -> list[tuple[int, int]]:
        """First and last time of each of the symbol's pages, ascending; other files are none."""
        named = (re.fullmatch(r"(-?\d+)-(-?\d+)\.json", n) for n in self._names(f"{self.root}/{symbol}", "File"))
        return sorted((int(m[1]), int(m[2])) for m in named if m)

    def page(self, symbol: str, span: tuple[int, int]) -> list[list]:
        with self.fs.open_input_stream(f"{self.root}/{symbol}/{span[0]}-{span[1]}.json") as f:
            return [json.loads(line) for line in f.read().decode().splitlines() if line.strip()]


@dataclass
class Slice(InputPartition):
    """Bars of a symbol with start <= open time < end."""

    symbol: str
    start: int
    end: int


def _ms(value: datetime) -> tuple[int, int]:
    """The millisecond at or before a time, and the one at or after it."""
    value = value if value.tzinfo else value.replace(tzinfo=UTC)
    us = round(value.timestamp() * 1_000_000)
    return us // 1000, -(-us // 1000)


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.slice_ms = int(float(options.get("slice_days", "30")) * _DAY_MS)
        self.budget, self.tries = int(options.get("calls", "1000")), int(options.get("tries", "3"))
        self.pause = float(options.get("pause_seconds", "0"))
        if self.slice_ms <= 0 or self.budget < 1 or self.tries < 1:
            raise ValueError("slice_days, calls and tries must be positive")
        self.symbols: set[str] | None = None
        self.start, self.end = -_FOREVER, _FOREVER
        self.store = PageStore

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes limits of symbol and ts, which prune partitions; gives back the rest."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("symbol",) and isinstance(f, EqualTo | In):
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                self.symbols = wanted if self.symbols is None else self.symbols & wanted
            elif column == ("ts",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                low, high = _ms(f.value)
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.start = max(self.start, low)
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.end = min(self.end, high if isinstance(f, LessThan) else high + 1)
                yield f  # bars are timed to the millisecond, so the edge is tested again
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Slices from the first to the last time of each symbol's pages, aligned to multiples of the slice's length."""
        store, out = self.store(self.path), []
        for symbol in store.symbols():
            spans = store.spans(symbol) if self.symbols is None or symbol in self.symbols else []
            if spans:
                low, high = max(self.start, spans[0][0]), min(self.end, max(b for _, b in spans) + 1)
                first = low // self.slice_ms * self.slice_ms
                out += [Slice(symbol, max(at, low), min(at + self.slice_ms, high)) for at in range(first, high, self.slice_ms)]
        return out

    def _call(self, store: PageStore, symbol: str, span: tuple[int, int]) -> list[list]:
        for attempt in range(1, self.tries + 1):
            try:
                return store.page(symbol, span)
            except OSError as e:
                if attempt == self.tries:
                    raise ConnectionLost(f"page {span[0]} of {symbol}: {e}") from e
                time.sleep(self.pause * attempt)
        raise AssertionError

    def read(self, partition: Slice | None) -> Iterator[tuple]:
        """The slice's bars in time order, each time once: of bars with one time that of the earlier page stays."""
        if partition is None:  # Spark's stand-in where there are no slices
            return
        store, bars = self.store(self.path), {}
        wanted = [s for s in store.spans(partition.symbol) if s[0] < partition.end and s[1] >= partition.start]
        if len(wanted) > self.budget:
            raise RateLimit(f"{partition.symbol}: {len(wanted)} calls from {partition.start} on, and {self.budget} are allowed")
        for calls, span in enumerate(wanted):
            if calls and self.pause:
                time.sleep(self.pause)
            for at, *values in self._call(store, partition.symbol, span):
                if partition.start <= at < partition.end:
                    bars.setdefault(at, values)
        for at in sorted(bars):
            yield (partition.symbol, datetime.fromtimestamp(at / 1000, UTC), *(None if v is None else float(v) for v in bars[at][:5]))


class BarPages(DataSource):
    """Format ``bar_pages``; options slice_days (30), calls (1000 a partition), tries (3 a call), pause_seconds (0)."""

    @classmethod
    def name(cls) -> str:
        return "bar_pages"

    def schema(self) -> StructType:
        return BARS

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(dict(self.options))

    @classmethod
    def register(cls, spark: SparkSession) -> None:
        """Makes the format known to the session, and lets filters reach it."""
        spark.dataSource.register(cls)
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_pages(bars, path: str, page_bars: int = 500, overlap: int = 0) -> None:
    """Writes bars as such pages, one task a symbol and page, through pyarrow: ``overlap`` bars of the next page are in a page too."""
    from pyspark.sql import functions as F
    from pyspark.sql import Window as W

    numbered = bars.withColumn("_ms", F.unix_millis("ts")).withColumn("_i", F.row_number().over(W.partitionBy("symbol").orderBy("ts")) - 1).withColumn("_page", F.expr(f"_i div {page_bars}"))
    again = numbered.where((F.col("_page") > 0) & (F.col("_i") % page_bars < overlap)).withColumn("_page", F.col("_page") - 1)

    def write(rows):
        rows = rows.sort_values("_ms")
        times = rows["_ms"].tolist()
        lines = [json.dumps([t, *(None if v != v else v for v in r)]) for t, r in zip(times, rows[["open", "high", "low", "close", "volume"]].itertuples(index=False), strict=True)]
        store = PageStore(path)
        folder = f"{store.root}/{rows['symbol'].iloc[0]}"
        store.fs.create_dir(folder, recursive=True)
        with store.fs.open_output_stream(f"{folder}/{times[0]}-{times[-1]}.json") as f:
            f.write("\n".join(lines).encode())
        return rows.iloc[:1][["symbol", "_page"]]

    numbered.unionByName(again).groupBy("symbol", "_page").applyInPandas(write, "symbol string, _page long").write.format("noop").mode("overwrite").save()
