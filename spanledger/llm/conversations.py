"""Conversations from message rows (problem 2).

Lines are laid out by session, sorted by their sequence within it, and run through a finite-state automaton, parents
first: a line's state is handed down to the lines below it. Roles, empty turns, missing replies and broken
links are outputs of the automaton; a conversation's verdict is what its lines' outputs come to. What crosses a
partition (an oversized session is cut into slices) is settled over the links between partitions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import forest
from ..operators.forest import CIRCLE, MISSING
from ..session import materialize

#: Symbols of a line.
OTHER, USER, ASSISTANT = 0, 1, 2
#: A state is a pair. First, what is above a line in its conversation: no user message; the last one, which waits for a reply or
#: has one; unknown (it is decided in another partition). Second, where its links lead: to a line without
#: parent; to another partition; around a circle.
START, OPEN, ELSEWHERE = 0, 1, 2
ROOTED, AWAY, LOST = 0, 1, 2
#: Outputs of a line, as bits: it is a message; it opens a turn; answers the open one; may answer one elsewhere; its links are broken.
#: WAITS is what is left of OPENS when no line of the partition has answered.
SAYS, OPENS, ANSWERS, MAY_ANSWER, BROKEN, WAITS = 1, 2, 4, 8, 16, 32
#: (what is above, symbol) to (what is above the lines below, output).
TURNS = {
    (START, OTHER): (START, 0), (START, USER): (OPEN, SAYS | OPENS), (START, ASSISTANT): (START, SAYS),
    (OPEN, OTHER): (OPEN, 0), (OPEN, USER): (OPEN, SAYS | OPENS), (OPEN, ASSISTANT): (OPEN, SAYS | ANSWERS),
    (ELSEWHERE, OTHER): (ELSEWHERE, 0), (ELSEWHERE, USER): (OPEN, SAYS | OPENS), (ELSEWHERE, ASSISTANT): (ELSEWHERE, SAYS | MAY_ANSWER),
}
LINKS = {ROOTED: 0, AWAY: 0, LOST: BROKEN}
AUTOMATON = {((turn, link), symbol): ((below, link), out | LINKS[link]) for (turn, symbol), (below, out) in TURNS.items() for link in LINKS}

_EXTRA = [T.StructField("turn", T.BinaryType()), T.StructField("turn_elsewhere", T.BooleanType()), T.StructField("bits", T.IntegerType())]


def symbol(role: str, content: str) -> Column:
    """USER or ASSISTANT for a message: a line of that role (case and outer blanks aside) with content that isn't all white space."""
    word = F.lower(F.trim(F.regexp_replace(role, r"(?U)^\s+|\s+$", "")))
    text = F.col(content).rlike(r"(?U)\S")
    return F.when(text & (word == "user"), USER).when(text & (word == "assistant"), ASSISTANT).otherwise(OTHER)


def run_automaton(pdf: pd.DataFrame, parent: list[int], order: list[int], n: int) -> dict[str, list]:
    """The automaton over one partition's lines; turns start anew where a branch enters another conversation."""
    symbols, ids = pdf["symbol"].tolist(), pdf["_id"].tolist()
    talk = pd.factorize(pd.MultiIndex.from_arrays([pdf["session_id"], pdf["agent_id"]]))[0].tolist()
    state: list[tuple[int, int] | None] = [None] * n
    turn, bits = [-1] * n, [0] * n
    lines = [v for v in order if v < n]
    if lines and 0 <= parent[lines[0]] < n:  # a circle: what its last line hands down reaches its first in a second run
        lines += lines
    for v in lines:
        p = parent[v]
        if p >= n:
            above, opened = (ELSEWHERE, AWAY), -1
        elif p < 0:
            above, opened = (START, ROOTED), -1
        elif state[p] is None:  # where a circle was entered
            above, opened = (START, LOST), -1
        else:
            above, opened = state[p], turn[p]
            if talk[p] != talk[v]:
                above, opened = (START, above[1]), -1
        state[v], output = AUTOMATON[above, symbols[v]]
        bits[v] |= output
        turn[v] = v if output & OPENS else opened
        if output & ANSWERS:
            bits[opened] |= ANSWERS << 8
    for v in range(n):
        answered = bits[v] & ANSWERS << 8
        bits[v] &= 255
        if bits[v] & OPENS and not answered:
            bits[v] |= WAITS
    return {"turn": [ids[t] if t >= 0 else None for t in turn], "turn_elsewhere": [s[0] == ELSEWHERE for s in state], "bits": bits}


class Conversations:
    """The conversations of a set of lines: those of one session and agent ('' is the main thread).

    lines has line_id, session_id, agent_id, uuid, parent_uuid, role, content and order (a bigint by which siblings
    are sorted). Lines without session (null or empty) are in none. Of the rows with one uuid in a session the first
    by line_id counts. Lines without uuid (null or empty) have no links and stand for themselves: a user message without uuid
    has no reply.
    """

    def __init__(self, lines: DataFrame):
        kept = lines.where(F.col("session_id") != "").withColumns({"agent_id": F.coalesce("agent_id", F.lit("")), "symbol": symbol("role", "content").cast("int"), "order": F.coalesce("order", F.lit(2**62))})
        key = lambda c: F.when(F.col(c).isNotNull(), F.unhex(F.md5(F.concat_ws("\0", "session_id", c))))
        named = F.col("uuid") != ""
        own = F.when(named, key("uuid")).otherwise(F.unhex(F.md5(F.concat_ws("\0", "session_id", F.lit(""), F.col("line_id").cast("string")))))
        rows = kept.select("line_id", "session_id", "agent_id", "symbol", own.alias("_id"), F.when(named, key("parent_uuid")).alias("_parent"), F.col("order").alias("_order"))
        once = rows.groupBy("_id").agg(F.min(F.struct("line_id", "_parent", "_order", "session_id", "agent_id", "symbol")).alias("r")).select("_id", "r.*")
        sizes = kept.groupBy(F.col("session_id").alias("_group")).agg(F.count(F.lit(1)).alias("_n"))
        self.forest = forest.Forest(once.withColumns({"_group": F.col("session_id"), "sort": F.col("_order")}), run_automaton, _EXTRA, sizes)

    def outputs(self) -> DataFrame:
        """session_id, agent_id, bits of every line, with what other partitions add: broken links, and replies to its turn."""
        told = self.forest.local.select("_id", "tree", "session_id", "agent_id", "bits")
        links = self.forest.links()
        if not links.isEmpty():
            lost = links.where(F.col("end_kind").isin(CIRCLE, MISSING)).select("tree", F.lit(BROKEN).alias("_lost"))
            late = self._answered_elsewhere().withColumn("_late", F.lit(True))
            more = F.col("bits").bitwiseOR(F.coalesce("_lost", F.lit(0)))
            told = told.join(lost, "tree", "left").join(late, "_id", "left").withColumn("bits", F.when(F.col("_late"), more.bitwiseAND(~WAITS)).otherwise(more))
        return told.select("session_id", "agent_id", "bits")

    def _answered_elsewhere(self) -> DataFrame:
        """(_id) of user messages answered by a line of another partition."""
        may = self.forest.local.where(F.col("bits").bitwiseAND(MAY_ANSWER) > 0).select("tree", "session_id", "agent_id").distinct()
        links = self.forest.links().where("parent_tree is not null").select("tree", "parent_tree", "at_turn", "at_turn_elsewhere", "at_session_id", "at_agent_id")
        # Where the turn above is decided still further up, go on, as long as it is the same conversation.
        up = links.select(F.col("tree").alias("parent_tree"), F.col("at_session_id").alias("s2"), F.col("at_agent_id").alias("a2"))
        joined = links.join(up, "parent_tree", "left")
        goes_on = F.col("at_turn_elsewhere") & (F.col("s2") == F.col("at_session_id")) & (F.col("a2") == F.col("at_agent_id"))
        steps = joined.select(F.col("tree").alias("id"), F.when(goes_on, F.col("parent_tree")).alias("ptr"), F.lit(0).cast("long").alias("total"), F.when(~F.col("at_turn_elsewhere"), F.col("at_turn")).alias("turn"))
        turns = forest.jump(steps, ["turn"]).where("turn is not null").select(F.col("id").alias("tree"), F.col("turn").alias("_id"))
        own = links.select("tree", F.col("at_session_id").alias("session_id"), F.col("at_agent_id").alias("agent_id"))
        return may.join(own, ["tree", "session_id", "agent_id"]).join(turns, "tree").select("_id").distinct()

    def rejected(self) -> DataFrame:
        """(session_id, agent_id, broken, empty, unanswered) of the conversations to leave out."""
        per = self.outputs().groupBy("session_id", "agent_id").agg(F.bit_or("bits").alias("b"))
        has = lambda bit: F.col("b").bitwiseAND(bit) > 0
        flags = per.select("session_id", "agent_id", has(BROKEN).alias("broken"), (~has(SAYS)).alias("empty"), has(WAITS).alias("unanswered"))
        return flags.where("broken or empty or unanswered")

    def ordered(self) -> DataFrame:
        """The messages of the conversations that stay: session_id, agent_id, root_order, root_line, seq, line_id, symbol.

        Within a conversation, sort by root_order, root_line, seq: parents come first, siblings by their order, trees by
        that of their first line. Lines without uuid have no links and stand for themselves.
        """
        nodes = self.forest.nodes()
        firsts = nodes.where("depth = 0").select("root", F.col("line_id").alias("root_line"), F.col("sort").alias("root_order"))
        linked = nodes.where(F.col("symbol") != OTHER).join(firsts, "root").select("session_id", "agent_id", "root_order", "root_line", F.col("enter").alias("seq"), "line_id", "symbol")
        kept = materialize(self.rejected(), "rejected")
        return linked.join(kept, ["session_id", "agent_id"], "left_anti")
