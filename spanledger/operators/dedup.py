"""One copy of each message (problem 3): identities are split by their aggregated frequency.

Singletons pass as they are. Only the rows of repeated identities are gathered and ranked, and both results are united.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import broadcast

from ..session import materialize

#: An identity with more than one in so many of the repeated rows is gathered by broadcast; there can't be more of them.
HOT_PARTS = 1024
LEAST_HOT = 1000


def first_filled(*names: str) -> Column:
    """The first of the columns that is neither null nor empty, tagged with its place, else null."""
    return F.coalesce(*[F.when(F.col(n) != "", F.concat(F.lit(f"{i}:"), F.col(n))) for i, n in enumerate(names)])


def one_of(*names: str) -> Column:
    """One text for a combination of columns, nulls told apart from texts: an identity made of several columns."""
    return F.to_json(F.struct(*names), {"ignoreNullFields": "false"})


class Copies:
    """The copies among all stored and new messages.

    rows has the columns ids (unique together; the last is a bigint that breaks ties), weight and keys, the identity. Keys
    compare null-safely; rows without identity must be left out before. fresh, if given, are further rows that arrived
    later: which copy is kept depends on all of them, not on the batch.
    Kept is the row with the largest weight (null is 0), then the smallest last id. Repeated rows (all of ids equal) count
    as one.
    """

    def __init__(self, rows: DataFrame, keys: list[str], ids: list[str], weight: str, fresh: DataFrame | None = None):
        every = rows if fresh is None else rows.unionByName(fresh)
        self.ids, self.keys = ids, keys
        self.rows = every.select(*dict.fromkeys([*keys, *ids]), F.coalesce(F.col(weight), F.lit(0)).cast("long").alias("_w"))
        # Fixed-width buffers only: hash aggregation, combined before the shuffle, so a hot identity is a row a task.
        self.frequency = self.rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(ids[-1]).alias("_only"))
        self._ranked: DataFrame | None = None

    def _match(self, left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        named = right.select(*(F.col(k).alias(f"_r_{k}") for k in self.keys), *(c for c in right.columns if c not in self.keys))
        on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in self.keys))
        return left.join(named, on, how).drop(*(f"_r_{k}" for k in self.keys))

    def repeated(self) -> DataFrame:
        """The rows of identities that occur more than once, with `_kept`: whether they are of rank 1."""
        if self._ranked is None:
            groups = materialize(self.frequency.where("_n > 1").select(*self.keys, "_n"), "repeated")
            total = groups.agg(F.sum("_n")).first()[0] or 0
            is_hot = F.col("_n") > max(total // HOT_PARTS, LEAST_HOT)
            hot = broadcast(groups.where(is_hot).drop("_n"))
            cold = groups.where(~is_hot).drop("_n")
            some = not groups.where(is_hot).isEmpty()
            rest = self._match(self.rows, hot, "left_anti") if some else self.rows
            gathered = self._match(rest, cold, "left_semi")
            if some:
                gathered = gathered.unionByName(self._match(self.rows, hot, "left_semi"))
            gathered = materialize(gathered, "copies")
            order = F.struct("_w", (-F.col(self.ids[-1])).alias("_i"), *self.ids[:-1])
            best = gathered.groupBy(*self.keys).agg(F.max(order).alias("_b")).select(*(F.col(f"_b.{c}").alias(c) for c in self.ids[:-1]), (-F.col("_b._i")).alias(self.ids[-1]), F.lit(True).alias("_best"))
            # By the unique ids, never by the identity: no hot key here.
            self._ranked = gathered.join(best, self.ids, "left").withColumn("_kept", F.coalesce("_best", F.lit(False))).drop("_best")
        return self._ranked

    def surplus(self) -> DataFrame:
        """The ids of the rows that aren't kept."""
        return self.repeated().where("not _kept").select(*self.ids).distinct()

    def kept(self) -> DataFrame:
        """The last id of each row that is kept: singletons as they are, and those of rank 1 of the repeated."""
        passed = self.frequency.where("_n = 1").select(F.col("_only").alias(self.ids[-1]))
        return passed.unionByName(self.repeated().where("_kept").select(self.ids[-1]).distinct())


def surplus(rows: DataFrame, keys: list[str], row_id: str, weight: str, fresh: DataFrame | None = None) -> DataFrame:
    """The ids of surplus copies; see Copies."""
    return Copies(rows, keys, [row_id], weight, fresh).surplus()


def absorb(held: DataFrame, fresh: DataFrame, keys: list[str], row_id: str, weight: str) -> DataFrame:
    """What is kept after a new batch, of rows kept so far and the batch: equal to deduplicating all that ever arrived.

    The best of a group is the best of the bests of its parts, so that old surplus needn't be held.
    """
    both = held.unionByName(fresh)
    return both.join(Copies(held, keys, [row_id], weight, fresh).kept(), row_id, "left_semi")
