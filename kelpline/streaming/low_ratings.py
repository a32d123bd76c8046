"""Months of low ratings over a stream of reviews: state a unit, closed month by month as the watermark passes."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: State is kept in this store, which holds typed variables and timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE_CONF = "spark.sql.streaming.stateStore.providerClass"


def month_end(mi: int) -> int:
    """The first millisecond after a month, which is a number: year * 12 + month - 1."""
    year, month = divmod(mi + 1, 12)
    return int(datetime.datetime(year, month + 1, 1, tzinfo=datetime.UTC).timestamp() * 1000)


class LowRatings(StatefulProcessor):
    """Per unit: reviews and stars of the months still needed, and what was closed and fired last.

    A timer at the end of each month with reviews closes it: all its rows that
    aren't too late are in by then. It fires where it has ten reviews, the
    twelve months before have thirty and it is rated 0.3 or more under them,
    six months or more after the last that fired.
    """

    def __init__(self, complete: int):
        self.complete = complete

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.months = handle.getMapState("months", "mi int", "n long, stars long")
        self.last = handle.getValueState("last", "first_mi int, closed_mi int, fired_mi int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first, closed, fired = self.last.get() if self.last.exists() else (None, -1, -1)
        for batch in rows:
            for mi, n, stars in batch.groupby("mi").agg(n=("n", "sum"), stars=("stars", "sum")).itertuples():
                mi = int(mi)
                old = self.months.getValue((mi,)) if self.months.containsKey((mi,)) else (0, 0)
                if not old[0]:
                    self.handle.registerTimer(month_end(mi))
                self.months.updateValue((mi,), (old[0] + int(n), old[1] + int(stars)))
                first = mi if first is None else min(first, mi)
        self.last.update((first, closed, fired))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first, closed, fired = self.last.get()
        upto = expiredTimerInfo.getExpiryTimeInMs()
        held = {mi[0]: tuple(v) for mi, v in self.months.iterator()}
        out = []
        for mi in sorted(m for m in held if closed < m and month_end(m) <= upto):  # in order, whatever the order of timers
            n, stars = held[mi]
            year = [held[m] for m in range(mi - 12, mi) if m in held]
            total, sums = sum(a for a, _ in year), sum(b for _, b in year)
            low = n >= 10 and total >= 30 and mi - first >= 12 and mi <= self.complete - 3 and stars / n <= sums / total - 0.3
            if low and (fired < 0 or mi - fired >= 6):
                out.append(mi)
                fired = mi
            closed = mi
        for mi in held:
            if mi < closed - 12:
                self.months.removeKey((mi,))
        self.last.update((first, closed, fired))
        if out:
            yield pd.DataFrame({"unit": [key[0]] * len(out), "m0": out})


def _added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of a batch added up by unit and day, so that a unit with a third of all reviews sends few rows to its state."""
    for batch in batches:
        yield batch.groupby(["unit", "at"], as_index=False).agg(n=("rating", "size"), stars=("rating", "sum"))


def low_rating_stream(reviews: DataFrame, complete: int, late: str = "40 days") -> DataFrame:
    """unit, m0 of a stream ``reviews`` (unit, at: timestamp, rating): the months that fire, as soon as the watermark has passed them.

    Days up to ``late`` behind count; later ones are left out, as a stream must.
    Null units and times don't count, nor do null ratings. Reviews are added up
    by unit and day where they are read; a unit's state is thirteen months
    and three numbers, and the months still open.
    """
    known = reviews.filter("unit is not null and at is not null and rating is not null").select("unit", F.date_trunc("day", "at").alias("at"), F.col("rating").cast("long").alias("rating"))
    rows = known.mapInPandas(_added, "unit string, at timestamp, n long, stars long").withWatermark("at", late)
    rows = rows.withColumn("mi", (F.year("at") * 12 + F.month("at") - 1).cast("int"))
    return rows.groupBy("unit").transformWithStateInPandas(LowRatings(complete), "unit string, m0 int", outputMode="Append", timeMode="EventTime")
