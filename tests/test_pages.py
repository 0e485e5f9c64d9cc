"""The paged connector against a plain reader of the same bars."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidegauge.sources.pages import BarPages, ConnectionLost, PageReader, PageStore, RateLimit, write_pages

HOUR = 3_600_000
START = 1_704_067_200_000  # 2024-01-01


def bar(t: int) -> list:
    return [t, 1.0, 2.0, 0.5, None if t // HOUR % 7 == 3 else t / 1e9, 10]


def put(path, symbol: str, start: int, times: list[int]) -> None:
    (path / symbol).mkdir(parents=True, exist_ok=True)
    (path / symbol / f"{start}-{max(times, default=start)}.json").write_text("\n".join(json.dumps(bar(t)) for t in times))


@pytest.fixture
def pages(tmp_path):
    """AAA: overlapping pages, a hole, an empty page, a page out of order; BBB: one page; CCC: none."""
    t = [START + i * HOUR for i in range(400)]
    put(tmp_path, "AAA", t[0], t[:100])
    put(tmp_path, "AAA", t[90], t[90:150][::-1])
    put(tmp_path, "AAA", t[120], t[120:140])
    put(tmp_path, "AAA", t[150], [])
    put(tmp_path, "AAA", t[260], t[260:300])
    put(tmp_path, "AAA", t[299], t[299:400])
    put(tmp_path, "BBB", t[10], t[10:20])
    (tmp_path / "CCC").mkdir()
    return tmp_path, {"AAA": sorted({*t[:150], *t[260:400]}), "BBB": t[10:20]}


def at(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000)


@pytest.mark.parametrize("days", [0.1, 1, 3.3, 365])
def test_equals_the_plain_reader(spark, pages, days):
    path, times = pages
    BarPages.register(spark)
    got = spark.read.format("bar_pages").option("slice_days", days).load(str(path))
    have = sorted((r["symbol"], int(r["ms"]), r["close"]) for r in got.select("symbol", (F.unix_millis("ts")).alias("ms"), "close").collect())
    assert have == sorted((s, t, bar(t)[4]) for s, ts in times.items() for t in ts)


@pytest.mark.parametrize("where", ["symbol = 'AAA'", "symbol in ('BBB', 'ZZZ')", "ts >= '2024-01-05' and ts < '2024-01-12 03:00:00'", "symbol = 'AAA' and ts > '2024-01-17 10:00:00'", "ts = '2024-01-01 12:00:00'", "ts < '2000-01-01'", "close is null and symbol <> 'BBB'"])
def test_filters(spark, pages, where):
    path, _ = pages
    BarPages.register(spark)
    plain = spark.createDataFrame(spark.read.format("bar_pages").load(str(path)).collect(), "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    got = spark.read.format("bar_pages").option("slice_days", 2).load(str(path)).where(where)
    rows = lambda df: sorted(map(str, df.select("symbol", "ts", "volume").collect()))
    assert rows(got) == rows(plain.where(where))


def test_partitions_are_pruned(spark, pages):
    path, _ = pages
    BarPages.register(spark)
    read = spark.read.format("bar_pages").option("slice_days", 1).load(str(path))
    some = read.where("symbol = 'AAA' and ts >= '2024-01-03' and ts < '2024-01-05'")
    assert read.rdd.getNumPartitions() == 17 + 1 and some.rdd.getNumPartitions() == 2
    assert "symbol" in (plan := some._jdf.queryExecution().executedPlan().toString()) and "bar_pages" in plan.lower()


def reader(path, **options) -> PageReader:
    return PageReader({"path": str(path)} | {k: str(v) for k, v in options.items()})


def test_calls_and_failures(pages):
    path, times = pages
    one = reader(path, slice_days=365)
    (slice_,) = [p for p in one.partitions() if p.symbol == "AAA"]
    assert len(list(one.read(slice_))) == len(times["AAA"])
    with pytest.raises(RateLimit):
        list(reader(path, slice_days=365, calls=2).read(slice_))

    class Shaky(PageStore):
        fails = {}

        def page(self, symbol, span):
            left = self.fails.setdefault(span, 2)
            self.fails[span] -= 1
            if left > 0:
                raise OSError("away")
            return super().page(symbol, span)

    again = reader(path, slice_days=365)
    again.store = Shaky
    assert len(list(again.read(slice_))) == len(times["AAA"])
    Shaky.fails = {}
    never = reader(path, slice_days=365, tries=2)
    never.store = Shaky
    with pytest.raises(ConnectionLost):
        list(never.read(slice_))
    with pytest.raises(ValueError):
        reader(path, slice_days=0)


def test_written_pages_come_back(spark, tmp_path):
    from helpers import bars

    df = bars(spark, [float(i) for i in range(1, 60)]).drop("rn").unionByName(bars(spark, [5.0, 6.0], symbol="Y").drop("rn"))
    write_pages(df, f"file://{tmp_path}/store", page_bars=7, overlap=3)
    BarPages.register(spark)
    back = spark.read.format("bar_pages").option("slice_days", 5).load(f"file://{tmp_path}/store")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.select(*back.columns).collect()))
