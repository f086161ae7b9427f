"""State that updates keep beside the lake, so that a change reads its own partitions and their neighbours only.

`LastPrices` has one row per (instrument, vendor): its first and last priced day and its last price. New days are linked to
it without reading any history. A day corrected inside the history is linked to its neighbours by reading the partitions
around it, doubling their number until every asked row has its neighbour. `ReportRings` has the last reports of each
(contract, group) before a day, which is all that a window over later reports can reach back to.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.functions import scalars as S
from panelloom.operators.returns import rolling_zscore
from panelloom.session import stored
from panelloom.sources.lake import Lake, file_system, path_exists

PRICE_KEY = ["instrument", "vendor"]
REPORT_KEY = ["contract", "group"]


class Snapshots:
    """Tables kept in folders `<first>_<second>` below one path, written whole; a table without its success mark is not there."""

    def __init__(self, lake: Lake, label: str, schema: str) -> None:
        self.lake, self.path, self.schema = lake, f"{lake.root}/meta/{label}", schema

    def names(self) -> list[tuple[str, str]]:
        if not path_exists(self.lake.spark, self.path):
            return []
        fs, where = file_system(self.lake.spark, self.path)
        found = [s.getPath().getName() for s in fs.listStatus(where)]
        return sorted(tuple(n.split("_")) for n in found if path_exists(self.lake.spark, f"{self.path}/{n}/_SUCCESS"))

    def read(self, name: tuple[str, str]) -> DataFrame:
        return self.lake.spark.read.schema(self.schema).parquet(f"{self.path}/{'_'.join(name)}")

    def write(self, frame: DataFrame, name: tuple[str, str]) -> None:
        frame.write.mode("overwrite").parquet(f"{self.path}/{'_'.join(name)}")

    def drop(self, names: Sequence[tuple[str, str]]) -> None:
        fs, where = file_system(self.lake.spark, self.path)
        for name in names:
            fs.delete(self.lake.spark._jvm.org.apache.hadoop.fs.Path(where, "_".join(name)), True)


# --- prices ---------------------------------------------------------------------------


class LastPrices:
    """(instrument, vendor, first_dt, last_dt, last_px) as of a version of the silver prices."""

    SCHEMA = "instrument string, vendor string, first_dt date, last_dt date, last_px double"

    def __init__(self, lake: Lake) -> None:
        self.lake = lake
        self.kept = Snapshots(lake, "last_prices", self.SCHEMA)

    @staticmethod
    def of(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*PRICE_KEY).agg(
            F.min("dt").alias("first_dt"), F.max("dt").alias("last_dt"), F.max_by("px", "dt").alias("last_px"))

    def at(self, version: int) -> DataFrame:
        """The state of exactly this version; without one, from a pass over the stored prices."""
        name = ("upto", str(version))
        if name not in self.kept.names():
            self.kept.write(self.of(price_rows(self.lake)), name)
        return self.kept.read(name)

    def advance(self, before: DataFrame, own: DataFrame, version: int) -> None:
        """The state after days were written: `own` has all rows of those days."""
        older = self.kept.names()
        fresh = self.of(own).select(*PRICE_KEY, *[F.col(c).alias(f"new_{c}") for c in ("first_dt", "last_dt", "last_px")])
        later = F.col("last_dt").isNull() | (F.col("new_last_dt") >= F.col("last_dt"))
        merged = before.join(fresh, PRICE_KEY, "full_outer").select(
            *PRICE_KEY, F.least("first_dt", "new_first_dt").alias("first_dt"), F.greatest("last_dt", "new_last_dt").alias("last_dt"),
            F.when(later, F.col("new_last_px")).otherwise(F.col("last_px")).alias("last_px"))
        self.kept.write(merged, ("upto", str(version)))
        self.kept.drop([n for n in older if n != ("upto", str(version))])


def price_rows(lake: Lake, days: Sequence[dt.date] | None = None) -> DataFrame:
    """(instrument, vendor, dt, px) of the given days' partitions, or of all."""
    frame = lake.scan("market_prices", "silver") if days is None else lake.read_keys("market_prices", list(days), "silver")
    return frame.where("px_last is not null").select(*PRICE_KEY, "dt", F.col("px_last").alias("px"))


class Reach:
    """Stored days that have been read around the changed ones: runs of neighbouring partitions, which can be widened."""

    def __init__(self, days: list[dt.date], changed: Sequence[dt.date]) -> None:
        self.days = days
        self.at = {d: i for i, d in enumerate(days)}
        self.runs = self._merged([(self.at[d], self.at[d]) for d in changed if d in self.at])

    @staticmethod
    def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        for lo, hi in sorted(runs):
            if out and lo <= out[-1][1] + 1:
                out[-1] = (out[-1][0], max(hi, out[-1][1]))
            else:
                out.append((lo, hi))
        return out

    def read(self) -> list[dt.date]:
        return [self.days[i] for lo, hi in self.runs for i in range(lo, hi + 1)]

    def table(self, spark) -> DataFrame:
        rows = [(self.days[i], n) for n, (lo, hi) in enumerate(self.runs) for i in range(lo, hi + 1)]
        return spark.createDataFrame(rows, "dt date, run int")

    def add(self, days: Sequence[dt.date]) -> None:
        self.runs = self._merged([*self.runs, *[(self.at[d], self.at[d]) for d in days if d in self.at]])

    def widen(self, back: set[int], ahead: set[int], by: int) -> bool:
        """Widen the runs of these numbers on either side; False where nothing is left to read."""
        before = self.runs
        self.runs = self._merged([
            (max(0, lo - by) if n in back else lo, min(len(self.days) - 1, hi + by) if n in ahead else hi) for n, (lo, hi) in enumerate(before)])
        return self.runs != before


def linked_prices(lake: Lake, state: DataFrame, reach: Reach, ask: Callable[[DataFrame], DataFrame], ahead: bool) -> DataFrame:
    """Stored (instrument, vendor, dt, px, prev_px, next_dt) rows of what has been read, whose rows marked by `ask` have their true neighbours.

    `state` tells each key's first and last day; rows outside of them lie on days that `reach` began with, so they have
    all been read. Inside, a neighbour counts if no unread partition lies between. Otherwise more partitions are read.
    """
    by_key = Window.partitionBy(*PRICE_KEY).orderBy("dt")
    step = 1
    while True:
        rows = price_rows(lake, reach.read()).join(reach.table(lake.spark), "dt").join(state, PRICE_KEY, "left")
        near = ask(rows).withColumns({
            "lag_dt": F.lag("dt").over(by_key), "lag_px": F.lag("px").over(by_key), "lag_run": F.lag("run").over(by_key),
            "lead_dt": F.lead("dt").over(by_key), "lead_run": F.lead("run").over(by_key)})
        outside = F.col("last_dt").isNull()
        after_last, before_first = F.col("dt") > F.col("last_dt"), F.col("dt") < F.col("first_dt")
        known_back = outside | after_last | (F.col("dt") <= F.col("first_dt")) | F.coalesce(F.col("lag_run") == F.col("run"), F.lit(False))
        known_ahead = outside | (F.col("dt") >= F.col("last_dt")) | before_first | F.coalesce(F.col("lead_run") == F.col("run"), F.lit(False))
        # The last known price stands in for a row that was not read.
        from_state = after_last & (F.col("lag_dt").isNull() | (F.col("lag_dt") < F.col("last_dt")))
        next_dt = F.when(before_first, F.least("lead_dt", "first_dt")).otherwise(F.col("lead_dt"))
        linked = near.select(
            *PRICE_KEY, "dt", "px", "run", "asked", F.when(from_state, F.col("last_px")).otherwise(F.col("lag_px")).alias("prev_px"),
            next_dt.alias("next_dt"), known_back.alias("known_back"), (known_ahead if ahead else F.lit(True)).alias("known_ahead"))
        linked = stored(linked, "linked-prices")
        short = linked.where("asked and not (known_back and known_ahead)").groupBy("run").agg(
            F.max(~F.col("known_back")).alias("back"), F.max(~F.col("known_ahead")).alias("ahead")).collect()
        if not short or not reach.widen({r["run"] for r in short if r["back"]}, {r["run"] for r in short if r["ahead"]}, step):
            return linked
        step *= 2


def stored_days(lake: Lake) -> list[dt.date]:
    return sorted(r["day"] for r in lake.partitions("market_prices", "silver").where("day is not null").select("day").collect())


def price_links(lake: Lake, state: DataFrame, reach: Reach, changed: Sequence[dt.date]) -> DataFrame:
    """(instrument, vendor, dt, px, prev_px, next_dt) of every price on a changed day."""
    on_changed = F.col("dt").isin(list(changed))
    return linked_prices(lake, state, reach, lambda rows: rows.withColumn("asked", on_changed), ahead=True).where("asked")


def reached_returns(lake: Lake, state: DataFrame, changed: Sequence[dt.date]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a change of prices reaches: (instrument, dt, return, px_t, px_t_1), all (instrument, dt) looked at, and the links used.

    Looked at are the rows of the changed days and, for every key priced there, of its next priced day; an instrument
    reached through one vendor is compared again with its others. Other partitions are read only where they hold
    previous prices of such rows.
    """
    reach = Reach(stored_days(lake), changed)
    links = linked = price_links(lake, state, reach, changed)
    after = stored(links.where("next_dt is not null").select("instrument", F.col("next_dt").alias("dt")).distinct(), "next-days")
    later = {r["dt"] for r in after.select("dt").distinct().collect()} - set(changed)
    touched = stored(links.select("instrument", "dt").unionByName(after).distinct(), "touched-prices")
    if later:
        reach.add(sorted(later))
        named = touched.withColumn("asked", F.lit(True))
        linked = linked_prices(lake, state, reach, lambda rows: rows.join(named, ["instrument", "dt"], "left").withColumn(
            "asked", F.coalesce("asked", F.lit(False))), ahead=False).where("asked")
    best = F.min_by(F.struct("ret", "px", "prev_px"), "vendor")
    rows = linked.withColumn("ret", S.ratio(F.col("px"), F.col("prev_px")) - 1).where("ret is not null").groupBy("dt", "instrument").agg(
        best.alias("r")).select("dt", "instrument", F.col("r.ret").alias("return"), F.col("r.px").alias("px_t"), F.col("r.prev_px").alias("px_t_1"))
    return rows, touched, links


# --- positioning reports --------------------------------------------------------------


class ReportRings:
    """The last `size` reports of each (contract, group) before a Monday, kept with the version of the reports they were taken at."""

    SCHEMA = "contract string, group string, report_date date, net_pos bigint"

    def __init__(self, lake: Lake, size: int) -> None:
        self.lake, self.size = lake, size
        self.kept = Snapshots(lake, f"report_rings_{size}".replace("_", "-"), self.SCHEMA)

    def before(self, monday: dt.date, log: DataFrame) -> tuple[dt.date | None, DataFrame]:
        """The newest ring of no later day that no recorded delivery has overtaken, and its day."""
        names = [n for n in self.kept.names() if n[0] <= monday.isoformat()]
        if names:
            spark = self.lake.spark
            rings = spark.createDataFrame([(a, int(b)) for a, b in names], "asof string, version bigint")
            seen = log.where(F.col("dataset") == "silver.cot_weekly").select(
                S.iso_week_monday(F.col("partition")).cast("string").alias("week"), "written_at").groupBy("week").agg(F.max("written_at").alias("written_at"))
            late = rings.join(seen, (seen["week"] < rings["asof"]) & (seen["written_at"] > rings["version"]), "left_semi")
            gone = {(r["asof"], str(r["version"])) for r in late.collect()}
            names = [n for n in names if n not in gone]
        if not names:
            return None, self.lake.spark.createDataFrame([], self.SCHEMA)
        return dt.date.fromisoformat(names[-1][0]), self.kept.read(names[-1])

    def keep(self, rows: DataFrame, monday: dt.date, version: int) -> None:
        """Store the ring before a Monday, taken from rows that reach back far enough."""
        newest = Window.partitionBy(*REPORT_KEY).orderBy(F.desc("report_date"))
        ring = rows.where(F.col("report_date") < F.lit(monday)).withColumn("n", F.row_number().over(newest)).where(F.col("n") <= self.size)
        older = [n for n in self.kept.names() if n[0] == monday.isoformat()]
        self.kept.write(ring.select("contract", "group", "report_date", "net_pos"), (monday.isoformat(), str(version)))
        self.kept.drop([n for n in older if n[1] != str(version)])

    def thin(self) -> None:
        """Of the rings of one year keep the first, and the newest of all."""
        names = self.kept.names()
        first: dict[str, tuple[str, str]] = {}
        for name in names:
            first.setdefault(name[0][:4], name)
        self.kept.drop([n for n in names[:-1] if first[n[0][:4]] != n])


def scored_reports(lake: Lake, log: DataFrame, weeks: Sequence[str], lookback: int) -> tuple[DataFrame, DataFrame]:
    """z-scores of the reports that changed weeks reach, and the reports read for them: those since the last ring, and the ring."""
    first = monday_of(min(weeks))
    asof, ring = ReportRings(lake, lookback).before(first, log)
    rows = lake.scan("cot_weekly", "silver")
    if asof is not None:
        rows = rows.where(F.col("week") >= "{0}-{1:02d}".format(*asof.isocalendar()))
    rows = stored(rows.select("contract", "group", "report_date", "net_pos").unionByName(ring), "reports")
    keyed = rows.withColumn("week", S.iso_week_key(F.col("report_date")))
    flagged = reached_reports(keyed, F.col("week").isin(list(weeks)), lookback)
    scored = rolling_zscore(flagged, REPORT_KEY, "net_pos", lookback, 4, "report_date").where("reached")
    return stored(scored.select("week", "contract", "group", "net_pos", "zscore"), "scored-reports"), rows


def keep_rings(lake: Lake, rows: DataFrame, weeks: Sequence[str], lookback: int, version: int) -> None:
    """Rings before the first changed week and after the last report, for the next update."""
    rings, first = ReportRings(lake, lookback), monday_of(min(weeks))
    last = rows.agg(F.max("report_date")).first()[0]
    for monday in {first, last + dt.timedelta(days=7 - last.weekday())}:
        rings.keep(rows, monday, version)
    rings.thin()


def monday_of(week: str) -> dt.date:
    return dt.date.fromisocalendar(int(week[:4]), int(week[5:]), 1)


def reached_reports(rows: DataFrame, changed: Column, lookback: int) -> DataFrame:
    """Flag reports that a changed one reaches: itself and the key's next `lookback` - 1 reports."""
    frame = Window.partitionBy(*REPORT_KEY).orderBy("report_date").rowsBetween(-(lookback - 1), 0)
    return rows.withColumn("reached", F.max(changed).over(frame))
