"""Rolling totals over trailing periods (problem 4) with a two-stack monoid queue per entity."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TwoStackQueue:
    """A first-in first-out window over a monoid; its product takes O(1) amortised steps, without inverses."""

    def __init__(self, combine: Callable, unit):
        self.combine, self.unit = combine, unit
        self.front: list = []  # (item's day, product of it and all behind it in this stack)
        self.back: list = []  # (day, item)
        self.back_product = unit

    def push(self, day: int, item) -> None:
        self.back.append((day, item))
        self.back_product = self.combine(self.back_product, item)

    def drop_before(self, day: int) -> None:
        while True:
            if not self.front:
                product = self.unit
                while self.back:
                    at, item = self.back.pop()
                    product = self.combine(item, product)
                    self.front.append((at, product))
                self.back_product = self.unit
            if not self.front or self.front[-1][0] >= day:
                return
            self.front.pop()

    def product(self):
        return self.combine(self.front[-1][1] if self.front else self.unit, self.back_product)


# A day's summary: events, input tokens, known cost, events with known cost, largest cost (the last isn't invertible).
UNIT = (0, 0, 0.0, 0, None)


def combine(a: tuple, b: tuple) -> tuple:
    top = b[4] if a[4] is None else a[4] if b[4] is None else max(a[4], b[4])
    return a[0] + b[0], a[1] + b[1], a[2] + b[2], a[3] + b[3], top


def windows_of(days: Iterator[tuple[int, tuple]], widths: tuple[int, ...]) -> Iterator[tuple[int, bool, list[tuple]]]:
    """(day, has events, product of each width) for every day from the first to the last of ascending days."""
    queues = [TwoStackQueue(combine, UNIT) for _ in widths]
    last = None
    for day, item in days:
        for today in range(day if last is None else last + 1, day + 1):
            for queue, width in zip(queues, widths):
                if today == day:
                    queue.push(day, item)
                queue.drop_before(today - width + 1)
            yield today, today == day, [q.product() for q in queues]
        last = day


def trailing_totals(daily: DataFrame, widths: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Trailing totals and daily averages of each entity for every day from its first to its last.

    daily: (entity, day date, events, tokens, cost, costed, top_cost), one row of each entity and day; build it
    with daily_totals(), whose partial aggregation leaves an entity at most one row a day however many events
    it has. A cost is null where no event of the window has a known one; an average divides by the width.
    Null entities are an entity of their own.
    """
    fields = [f"{k}_{w} {t}" for w in widths for k, t in (("events", "long"), ("tokens", "long"), ("cost", "double"), ("top_cost", "double"), ("avg_tokens", "double"), ("avg_cost", "double"))]
    names = [f.split()[0] for f in fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def emit(entity, days):
            rows = []
            for day, active, products in windows_of(iter(days), widths):
                row = [entity, date(1970, 1, 1) + timedelta(days=day), active]
                for width, (n, tokens, cost, costed, top) in zip(widths, products):
                    known = cost if costed else None
                    row += [n, tokens, known, top, tokens / width, known / width if costed else None]
                rows.append(row)
            return pd.DataFrame(rows, columns=["entity", "day", "active", *names])

        at, days = None, []
        none = lambda x: None if x is None or x != x else x
        for pdf in batches:
            for entity, day, n, tokens, cost, costed, top in zip(*(pdf[c].tolist() for c in ("entity", "d", "events", "tokens", "cost", "costed", "top_cost"))):
                entity = none(entity)
                if days and entity != at:
                    yield emit(at, days)
                    days = []
                at = entity
                days.append((day, (n, tokens, none(cost) or 0.0, costed, none(top))))
        if days:
            yield emit(at, days)

    keyed = daily.withColumn("d", F.unix_date("day")).select("entity", "d", "events", "tokens", "cost", "costed", "top_cost")
    parts = keyed.repartition("entity").sortWithinPartitions("entity", "d")
    return parts.mapInPandas(run, "entity string, day date, active boolean, " + ", ".join(fields))


def daily_totals(events: DataFrame, entity: str, micros: str, tokens: str, cost: str) -> DataFrame:
    """One row of each entity and UTC day: the input of trailing_totals(). Null tokens count as 0; costs that are null or NaN are unknown."""
    known = F.when(~F.isnan(cost), F.col(cost))
    day = F.to_date(F.timestamp_micros(micros))
    return events.groupBy(F.col(entity).alias("entity"), day.alias("day")).agg(
        F.count(F.lit(1)).alias("events"),
        F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens"),
        F.sum(known).alias("cost"),
        F.count(known).alias("costed"),
        F.max(known).alias("top_cost"),
    )
