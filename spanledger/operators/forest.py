"""Parent-child links to full hierarchies (problem 1).

Rows are laid out so that a group (say a session) stays in one partition of bounded size; groups beyond that are
cut into slices. In each partition leaves are peeled, which leaves the local circles, and an Euler tour numbers
every local tree. Links that leave their partition make a graph of trees that is small next to the rows: its
circles come to light by pointer jumping, and the pieces of the tours between two attached trees form lists whose
parallel ranking turns local tour numbers into global ones. Nothing gathers a whole hierarchy in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, release
from .ordered import Sliced

#: Rows of one group that stay together in one partition; larger groups are cut into slices of about so many.
GROUP_ROWS = 200_000
#: Oversized groups up to this number are told apart by broadcast.
BROADCAST_GROUPS = 100_000
#: Ids that a path holds before it goes on from an ancestor (see path_pieces).
PATH_IDS = 64
#: Links beyond which pointer jumping looks for pointers that many share.
JUMP_HOT = 1_000_000
#: Rows that are worth a partition of their own.
LEAST_ROWS = 10_000
ROOT, EXTERNAL, CIRCLE, MISSING = 0, 1, 2, 3
_HOT_BASE = 1 << 21

#: Names of the operator's own columns; payload columns of these names are left out.
RESERVED = {
    "tree", "kind", "ext", "top", "enter", "size", "depth", "on_circle", "root", "state", "exit", "descendants", "end_kind", "end_tree", "offset", "start", "parent_tree", "weight", "g", "h", "g0", "deep", "_on", "_n", "_at",
}

Annotate = Callable[[pd.DataFrame, list[int], list[int], int], dict[str, list]]


def peel(parent: list[int]) -> tuple[list[int], list[int]]:
    """(peeled, left): leaves first, a node before its parent; left are the nodes on circles. -1 is no parent."""
    children = [0] * len(parent)
    for p in parent:
        if p >= 0:
            children[p] += 1
    ready = [v for v, c in enumerate(children) if c == 0]
    peeled = []
    while ready:
        v = ready.pop()
        peeled.append(v)
        p = parent[v]
        if p >= 0:
            children[p] -= 1
            if children[p] == 0:
                ready.append(p)
    return peeled, [v for v, c in enumerate(children) if c > 0]


def around(parent: list[int], circle: list[int]) -> list[int]:
    """The nodes on circles, circle by circle, each node before its child on the circle."""
    out, seen = [], set()
    for v in circle:
        walk = []
        while v not in seen:
            seen.add(v)
            walk.append(v)
            v = parent[v]
        out += walk[::-1]
    return out


def tours(parent: list[int], n: int) -> tuple[list[int], ...]:
    """(enter, size, depth, top, tree, on circle, parents-first order) of local trees.

    Nodes from n on stand for parents in other partitions: they weigh nothing, their children are at depth 0
    and are tops. Siblings keep their order. A circle's nodes are each the top of what hangs below.
    """
    total = len(parent)
    peeled, circle = peel(parent)
    on = [False] * total
    for v in circle:
        on[v] = True
    size = [1] * n + [0] * (total - n)
    for v in peeled:
        if parent[v] >= 0:
            size[parent[v]] += size[v]
    links = np.asarray(parent, dtype=np.int64)
    by_parent = np.argsort(links, kind="stable")
    bounds = np.searchsorted(links[by_parent], np.arange(total + 1)).tolist()
    by_parent = by_parent.tolist()
    enter, depth = [0] * n + [-1] * (total - n), [0] * n + [-1] * (total - n)
    top, tree = list(range(total)), list(range(total))
    order = around(parent, circle) + peeled[::-1]
    for v in order:
        at, d = enter[v] + 1, depth[v] + 1
        for c in by_parent[bounds[v] : bounds[v + 1]]:
            if not on[c]:
                enter[c], depth[c], tree[c] = at, d, tree[v]
                if v < n:
                    top[c] = top[v]
                at += size[c]
    return enter, size, depth, top, tree, on, order


class Forest:
    """The local trees of a set of links, and how they hang together.

    nodes has a unique, non-null _id, a _parent (null for a root), a _group that keeps related rows together, an
    _order that sorts siblings, and payload columns (those with a name of RESERVED are left out). annotate may add columns: it gets a partition's rows, the
    local parent of each (-1 none, >= n outside), the order (circles first, each walked along from some node; then parents
    before children), and n. sizes (_group, _n) may give upper bounds of the groups' sizes where they are cheaper to get
    than by counting nodes.
    """

    def __init__(self, nodes: DataFrame, annotate: Annotate | None = None, extra: list[T.StructField] | None = None, sizes: DataFrame | None = None):
        self.sizes = sizes
        self.spark = nodes.sparkSession
        own = {"_id", "_parent", "_group", "_order", *RESERVED, *(f.name for f in extra or [])}
        self.payload = [f for f in nodes.schema.fields if f.name not in own]
        id_type = nodes.schema["_id"].dataType
        self.schema = T.StructType([
            T.StructField("_id", id_type), T.StructField("_parent", id_type), T.StructField("tree", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("ext", id_type), T.StructField("top", id_type),
            T.StructField("enter", T.LongType()), T.StructField("size", T.LongType()), T.StructField("depth", T.LongType()), T.StructField("on_circle", T.BooleanType()), *(extra or []), *self.payload,
        ])
        self.annotate, self.extra = annotate, extra or []
        self.local = materialize(self._lay_out(nodes), "forest")
        self._links: DataFrame | None = None

    def _lay_out(self, nodes: DataFrame) -> DataFrame:
        # Nodes without a group are groups of their own, not one together.
        nodes = nodes.withColumn("_group", F.coalesce(F.col("_group").cast("string"), F.hex(F.xxhash64("_id"))))
        counts = nodes.groupBy("_group").agg(F.count(F.lit(1)).alias("_n")) if self.sizes is None else self.sizes
        sizes = counts.agg(F.sum("_n"), F.max("_n")).first()
        rows, largest = sizes[0] or 0, sizes[1] or 0
        # By rows: as many as bound a partition, and enough for the cores where that is worth a task.
        parts = max(math.ceil(2 * rows / GROUP_ROWS), min(self.spark.sparkContext.defaultParallelism, math.ceil(rows / LEAST_ROWS)), 1)
        self.parts = parts
        if largest <= GROUP_ROWS:
            return self._run(nodes.repartition(parts, "_group"), 0)
        # Each has more than GROUP_ROWS rows, so they are few: known by heart in every task, no hot group is shuffled to one.
        big = materialize(counts.where(F.col("_n") > GROUP_ROWS).select("_group"), "big")
        if big.count() <= BROADCAST_GROUPS:
            big = F.broadcast(big)
        cold = nodes.join(big, "_group", "left_anti").repartition(parts, "_group")
        hot = nodes.join(big, "_group", "left_semi").repartitionByRange(parts, "_group", "_order", "_id")
        return self._run(cold, 0).unionByName(self._run(hot, _HOT_BASE))

    def _run(self, laid: DataFrame, base: int) -> DataFrame:
        annotate, extra, payload, names = self.annotate, [f.name for f in self.extra], [f.name for f in self.payload], self.schema.names

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            frames = [b for b in batches if len(b)]
            if not frames:
                return
            pdf = pd.concat(frames, ignore_index=True)
            n = len(pdf)
            ids, parents = pdf["_id"].tolist(), pdf["_parent"].tolist()
            at = {v: i for i, v in enumerate(ids)}
            outside: dict = {}
            local = [-1 if not isinstance(p, (str, bytes)) else at[p] if p in at else outside.setdefault(p, n + len(outside)) for p in parents]
            stub = list(outside)
            parent = local + [-1] * len(stub)
            enter, size, depth, top, tree, on, order = tours(parent, n)
            key = (base + TaskContext.get().partitionId()) << 32
            out = {
                "_id": ids, "_parent": parents, "tree": [key | t for t in tree[:n]], "kind": [EXTERNAL if t >= n else CIRCLE if on[t] else ROOT for t in tree[:n]], "ext": [stub[t - n] if t >= n else None for t in tree[:n]],
                "top": [ids[t] for t in top[:n]], "enter": enter[:n], "size": size[:n], "depth": depth[:n], "on_circle": on[:n],
            }
            if annotate:
                out |= annotate(pdf, parent, order, n)
            frame = pd.DataFrame({k: out[k] for k in out})
            for c in payload:
                frame[c] = pdf[c]
            yield frame[names]

        return laid.sortWithinPartitions("_group", "_order", "_id").mapInPandas(run, self.schema)

    def links(self) -> DataFrame:
        """Each tree that hangs below another partition's node or below a missing one, resolved.

        tree, weight (its nodes), ext, parent_tree, at_enter, at_size, at_depth (of the node it hangs on; null if
        missing), end_kind (ROOT, MISSING, CIRCLE), end_tree, offset (depth of its tops), root (null if itself), on_circle, and the
        columns of the node it hangs on that annotate() and the payload gave, prefixed by at_.
        """
        if self._links is None:
            hung = self.local.where((F.col("kind") == EXTERNAL) & (F.col("depth") == 0)).groupBy("tree").agg(F.first("ext").alias("ext"), F.sum("size").alias("weight"))
            more = [f.name for f in [*self.extra, *self.payload]]
            at = self.local.select(F.col("_id").alias("ext"), F.col("tree").alias("parent_tree"), F.col("kind").alias("at_kind"), *(F.col(c).alias(f"at_{c}") for c in ["enter", "size", "depth", "top", *more]))
            found = materialize(hung.join(at, "ext", "left"), "links")
            # A tree whose parent is missing is an end itself, so that what hangs on it learns on which of its tops.
            lost = found.where("parent_tree is null").select(F.col("tree").alias("parent_tree"), F.lit(True).alias("on_lost"))
            known = found.join(lost, "parent_tree", "left")
            kind = F.when(F.col("parent_tree").isNull() | F.col("on_lost"), MISSING).when(F.col("at_kind") == EXTERNAL, F.lit(None)).otherwise(F.col("at_kind"))
            goes_on = (F.col("at_kind") == EXTERNAL) & F.col("on_lost").isNull()
            steps = known.select(
                F.col("tree").alias("id"), F.when(goes_on, F.col("parent_tree")).alias("ptr"), F.coalesce(F.col("at_depth") + 1, F.lit(0)).alias("total"),
                F.coalesce("parent_tree", "tree").alias("last"), kind.cast("int").alias("end_kind"), F.col("at_top").alias("root"),
            )
            ends = jump(steps, ["last", "end_kind", "root"])
            circles = ends.where("ptr is not null").select(F.col("ptr").alias("tree")).distinct().withColumn("on_circle", F.lit(True))
            ends = ends.select(F.col("id").alias("tree"), F.coalesce("end_kind", F.lit(CIRCLE)).alias("end_kind"), F.col("last").alias("end_tree"), F.col("total").alias("offset"), "root")
            self._links = materialize(found.join(ends, "tree").join(circles, "tree", "left").fillna(False, ["on_circle"]), "links")
        return self._links

    def circle_nodes(self) -> DataFrame:
        """The local rows of the nodes on circles, within a partition or across several.

        A circle enters each of its trees at one node only, so the join below meets a row at most once.
        """
        within = self.local.where("on_circle")
        links = self.links().where("on_circle").select(F.col("parent_tree").alias("tree"), F.col("at_enter").alias("_at"))
        across = self.local.where(F.col("kind") == EXTERNAL).join(links, "tree").where("enter <= _at and _at < enter + size").drop("_at")
        return within.unionByName(across.select(within.columns))

    def nodes(self) -> DataFrame:
        """Every node: _id, _parent, payload, root, depth, enter, exit, descendants and state.

        Within one root, a is an ancestor of b exactly if a.enter <= b.enter < a.exit. state is `tree`, `orphan` (the
        top's parent is missing; the top is the root), `circle` or `below_circle`; the last two have no root, depth or
        interval. Siblings of one group are in their order, those from other groups last.
        """
        links = self.links()
        segments = self._segments(links)
        cut = segments.where("j > 0").select("tree").distinct()
        on = self.circle_nodes().select("_id").withColumn("_on", F.lit(True))
        mine = self.local.drop("on_circle").join(links.select("tree", "end_kind", "offset", "root"), "tree", "left")
        ok = F.coalesce("end_kind", "kind") != CIRCLE
        mine = mine.withColumns({"root": F.when(ok, F.coalesce("root", "top")), "end_kind": F.coalesce("end_kind", "kind"), "offset": F.coalesce("offset", F.lit(0))})
        whole = mine.join(cut, "tree", "left_anti").join(segments.where("j = 0").select("tree", "start"), "tree", "left")
        whole = whole.withColumns({"start": F.coalesce("start", F.lit(0))}).withColumns({"g": F.col("start") + F.col("enter"), "h": F.col("start") + F.col("enter") + F.col("size")}).drop("start")
        parted = mine.join(cut, "tree", "left_semi")
        schema = T.StructType([*parted.schema.fields, T.StructField("g", T.LongType()), T.StructField("h", T.LongType())])
        # Many trees at a time: as many buckets of trees as there are partitions, so of about their size.
        bucket = F.pmod(F.xxhash64("tree"), F.lit(self.parts))
        placed = parted.groupBy(bucket).cogroup(segments.join(cut, "tree", "left_semi").groupBy(bucket)).applyInPandas(_place, schema)
        rows = materialize(whole.unionByName(placed.select(whole.columns)), "tours")
        # Orphans of one missing parent share a numbering: it starts anew at each of them.
        orphans = rows.where(F.col("end_kind") == MISSING)
        tops = orphans.where(F.col("_id") == F.col("root")).select("root", F.col("g").alias("g0"))
        rows = rows.where(F.col("end_kind") != MISSING).withColumn("g0", F.lit(0).cast("long")).unionByName(orphans.join(tops, "root"), allowMissingColumns=False)
        names = [f.name for f in self.payload]
        done = rows.join(on, "_id", "left")
        ok = F.col("end_kind") != CIRCLE
        state = F.when(F.col("_on"), "circle").when(~ok, "below_circle").when(F.col("end_kind") == MISSING, "orphan").otherwise("tree")
        return done.select(
            "_id", "_parent", *names, state.alias("state"), "root", F.when(ok, F.col("depth") + F.col("offset")).alias("depth"), F.when(ok, F.col("g") - F.col("g0")).alias("enter"),
            F.when(ok, F.col("h") - F.col("g0")).alias("exit"), F.when(ok, F.col("h") - F.col("g") - 1).alias("descendants"),
        )

    def _segments(self, links: DataFrame) -> DataFrame:
        """tree, j, pos, cut_depth, start: the pieces of each tour between attached trees, ranked.

        Piece j of a tree begins at its local position pos, behind the j-th tree attached to it; start is the number
        of nodes of the whole tour before it. The slices of a group are ranges of its order, so all tops of a tree from
        an earlier slice come before the local children of the node it hangs on, those from a later one behind them.
        """
        hung = links.where(F.col("end_kind") != CIRCLE)
        earlier = (F.col("tree") >= _HOT_BASE << 32) & (F.shiftright("tree", 32) < F.shiftright("parent_tree", 32))
        attached = hung.where("parent_tree is not null").withColumn("pos", F.col("at_enter") + F.when(earlier, 1).otherwise(F.col("at_size")))
        # The trees attached to one tree may be a large part of all: numbered over ranges of them, not in one task.
        s = Sliced(attached.withColumn("deep", -F.col("at_depth")), ["parent_tree"], ["pos", "deep", "tree"])
        near = s.carry(s.rows.withColumn("_lag", F.lag("pos").over(s.within())), {"_n": (F.count(F.lit(1)), "sum"), "_pos": (F.max("pos"), "last")})
        attached = near.withColumns({"j": (F.row_number().over(s.within()) + F.col("_n")).cast("int"), "before": F.coalesce("_lag", "_pos", F.lit(0))})
        attached = materialize(attached.select("tree", "weight", "parent_tree", "pos", "before", "j", "at_depth"), "attached")
        ends = attached.groupBy("parent_tree").agg(F.max("j").alias("m"), F.max("pos").alias("end")).withColumnRenamed("parent_tree", "tree")
        name = lambda tree, j: F.concat_ws(":", tree, j)
        sizes = hung.select("tree", "weight").join(ends, "tree", "left").fillna(0, ["m", "end"])
        # Each piece with its weight; the last piece of a root's tree has no successor and needs none.
        inner = attached.select(name(F.col("parent_tree"), F.col("j") - 1).alias("id"), F.col("parent_tree").alias("tree"), (F.col("j") - 1).alias("j"), (F.col("pos") - F.col("before")).alias("w"))
        final = sizes.select(name(F.col("tree"), F.col("m")).alias("id"), "tree", F.col("m").alias("j"), (F.col("weight") - F.col("end")).alias("w"))
        roots = ends.join(hung, "tree", "left_anti").select(name(F.col("tree"), F.col("m")).alias("id"), "tree", F.col("m").alias("j"), F.lit(0).cast("long").alias("w"))
        pieces = inner.unionByName(final).unionByName(roots)
        first = attached.select(name(F.col("tree"), F.lit(0)).alias("id"), name(F.col("parent_tree"), F.col("j") - 1).alias("ptr"))
        after = attached.join(sizes.select("tree", "m"), "tree").select(name(F.col("parent_tree"), F.col("j")).alias("id"), name(F.col("tree"), F.col("m")).alias("ptr"))
        before = first.unionByName(after)
        ranked = jump(pieces.join(before, "id", "left").select("id", "ptr", F.col("w").alias("total"), F.col("id").alias("last")), ["last"])
        placed = pieces.join(ranked.select("id", "total"), "id").withColumn("start", F.col("total") - F.col("w"))
        cuts = attached.select(F.col("parent_tree").alias("tree"), "j", "pos", F.col("at_depth").alias("cut_depth"))
        return materialize(placed.select("tree", "j", "start").join(cuts, ["tree", "j"], "left").fillna(0, ["pos"]).fillna(-1, ["cut_depth"]), "pieces")


def _place(nodes: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
    """Global tour numbers of the nodes of many local trees, given the ranked pieces of their tours."""
    if not len(nodes):
        return nodes.assign(g=pd.Series(dtype="int64"), h=pd.Series(dtype="int64"))
    base = int(pieces["cut_depth"].max()) + 2
    # Behind a node's last descendant come the trees hung below it: those cut at its end at its depth or deeper.
    rank = np.where(pieces["j"] == 0, -1, pieces["pos"] * (base + 1) + (base - 1 - pieces["cut_depth"]))
    pieces = pieces.assign(rank=rank.astype(np.int64))[["tree", "j", "pos", "start", "rank"]]
    end = nodes["enter"] + nodes["size"]
    asked = pd.DataFrame({"i": np.arange(len(nodes)), "tree": nodes["tree"].to_numpy(), "enter": nodes["enter"].to_numpy(), "end": end.to_numpy(), "at": (end * (base + 1) + (base - 1 - np.minimum(nodes["depth"], base - 1))).to_numpy().astype(np.int64)})

    def behind(left: str, right: str) -> pd.DataFrame:
        """Of each node the last piece of its tree that begins no later."""
        return pd.merge_asof(asked.sort_values(left), pieces.sort_values([right, "j"]), left_on=left, right_on=right, by="tree").sort_values("i")

    first, last = behind("enter", "pos"), behind("at", "rank")
    return nodes.assign(g=(first["start"] + first["enter"] - first["pos"]).to_numpy(), h=(last["start"] + last["end"] - last["pos"]).to_numpy())


def jump(steps: DataFrame, carried: list[str]) -> DataFrame:
    """Pointer jumping over (id, ptr, total, carried): follow ptr to its end, adding up totals.

    Afterwards ptr is null where an end was reached, and carried are the end's. What still has a pointer after
    twice as many steps as there are rows runs in a circle; such pointers then are nodes on circles, all of them.
    Each round is one join, written to the shared folder; there are log2 of the longest list of them.
    """
    state = materialize(steps, "jump")
    n = state.count()
    for _ in range(max(1, n).bit_length() + 1):
        active = state.where("ptr is not null")
        if active.isEmpty():
            break
        ahead = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("total").alias("_total"), *(F.col(c).alias(f"_{c}") for c in carried))
        moved = _follow(active, ahead, n).select("id", F.col("_ptr").alias("ptr"), (F.col("total") + F.col("_total")).alias("total"), *(F.col(f"_{c}").alias(c) for c in carried))
        old, state = state, materialize(moved.unionByName(state.where("ptr is null")), "jump")
        release(old)
    return state


def _follow(active: DataFrame, ahead: DataFrame, n: int) -> DataFrame:
    """active with what is at the end of its pointers. Of many rows, pointers that more than one in 1,024 share go by broadcast."""
    if n <= JUMP_HOT:
        return active.join(ahead, "ptr")
    hot = active.groupBy("ptr").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > n // 1024).select("ptr")
    hot = materialize(ahead.join(F.broadcast(hot), "ptr", "left_semi"), "hot")
    rest = active.join(F.broadcast(hot.select("ptr")), "ptr", "left_anti")
    return rest.join(ahead, "ptr").unionByName(active.join(F.broadcast(hot), "ptr"))


def first_rows(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row of each non-null, non-empty key: the one with the smallest order. Partial minima go before the shuffle."""
    best = rows.where(F.col(key) != "").groupBy(key).agg(F.min(F.struct(order, *columns)).alias("_first"))
    return best.select(key, "_first.*")


PIECES = [T.StructField("anchor", T.StringType()), T.StructField("path", T.StringType())]


def path_pieces(most: int = PATH_IDS) -> Annotate:
    """An annotation (with PIECES): the path of each node as a piece of at most so many ids, and the ancestor that it goes on from.

    anchor is null where the piece is the whole path from the root. A piece ends where another partition begins. A chain of n
    nodes so has n pieces of bounded length, not n * n / 2 ids.
    """

    def annotate(pdf: pd.DataFrame, parent: list[int], order: list[int], n: int) -> dict[str, list]:
        ids, parents = pdf["_id"].tolist(), pdf["_parent"].tolist()
        anchor: list = [None] * n
        path: list = [None] * n
        held = [0] * n
        for v in order:
            if v >= n:
                continue
            p = parent[v]
            if p < 0 or (p < n and not held[p]):  # a root, or where a circle was entered
                path[v], held[v] = ids[v], 1
            elif p >= n or held[p] == most:
                anchor[v], path[v], held[v] = parents[v], ids[v], 1
            else:
                anchor[v], path[v], held[v] = anchor[p], f"{path[p]}/{ids[v]}", held[p] + 1
        return {"anchor": anchor, "path": path}

    return annotate


def pieces(forest: Forest) -> DataFrame:
    """(_id, anchor, path) of the nodes that have a root; the forest was annotated by path_pieces."""
    ends = forest.links().select("tree", "end_kind", F.col("parent_tree").isNull().alias("_lost"))
    told = forest.local.join(ends, "tree", "left").where(F.coalesce("end_kind", "kind") != CIRCLE)
    # Below a missing parent the topmost node is the root: its piece has nothing to go on from.
    lost = F.coalesce("_lost", F.lit(False)) & (F.col("anchor") == F.col("ext"))
    return told.select("_id", F.when(~F.coalesce(lost, F.lit(False)), F.col("anchor")).alias("anchor"), "path")


def expand_paths(nodes: DataFrame, wanted: DataFrame, separator: str = "/") -> DataFrame:
    """(_id, path): the full paths of the wanted ids, exactly; nodes are those of Forest.nodes().

    A path's ids are the nodes whose intervals hold it. What comes out is as long as the paths are deep: ask for few.
    """
    known = nodes.where("root is not null").select("_id", "root", "depth", "enter", "exit")
    asked = known.join(wanted.select("_id").distinct(), "_id").select(F.col("_id").alias("_of"), "root", F.col("enter").alias("_at"))
    above = known.join(asked, "root").where("enter <= _at and _at < exit")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("depth", "_id"))), lambda x: x["_id"])
    return above.groupBy("_of").agg(F.array_join(ids, separator).alias("path")).withColumnRenamed("_of", "_id")
