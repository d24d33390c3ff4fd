"""The pN_ queries of the text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stamps
from ..session import table
from ..plans.stamp_sql import stamped
from . import packing, tokens, truncation
from .conversations import ASSISTANT, Conversations

# --- 2: conversations ---------------------------------------------------------------------------------------


def _lines(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return table(spark, d, "transcript_line").select("line_id", "session_id", "agent_id", "uuid", "parent_uuid", F.col("message.role").alias("role"), F.col("message.content").alias("content"), *more)


def p2_rejected(spark: SparkSession, d: str) -> DataFrame:
    """The conversations to leave out, with the reasons."""
    return Conversations(_lines(spark, d).withColumn("order", F.col("line_id"))).rejected()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_rejected(spark, d).select("session_id", "agent_id")


def p2_conversations(spark: SparkSession, d: str) -> DataFrame:
    """The messages of the remaining conversations, sorted: parents first, siblings by the instant of ts."""
    lines = _lines(spark, d, "ts", "host_id")
    timed = stamps.normalise(lines.withColumn("_from", F.lit("transcript_line.ts")), table(spark, d, "host_clock"), "ts", "host_id", "_from").withColumnRenamed("stamp_micros", "order")
    texts = lines.select("line_id", "content")
    told = Conversations(timed).ordered().join(texts, "line_id").withColumn("role", F.when(F.col("symbol") == ASSISTANT, "assistant").otherwise("user"))
    order = ["session_id", "agent_id", "root_order", "root_line", "seq"]
    return told.select(*order, "line_id", "role", "content").repartitionByRange(*order).sortWithinPartitions(*order)


# --- 8: token ids -------------------------------------------------------------------------------------------


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"), "doc_id", "text")


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_counts(table(spark, d, "documents"), "doc_id", "text")


# --- 9: containers ------------------------------------------------------------------------------------------


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "container_spec"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    """Of each capacity: containers, tokens, and the share of room left unused."""
    used = p9_containers(spark, d).where("container_id is not null").groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("used"))
    per = used.groupBy("spec_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"))
    specs = table(spark, d, "container_spec").select("spec_id", "capacity_tokens")
    return per.join(specs, "spec_id").withColumn("unused_share", 1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))


# --- 10: texts cut off --------------------------------------------------------------------------------------


def p10_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """The documents whose text begins a longer one, and whether any of those goes on inside the line: the prefix join alone."""
    return truncation.prefix_of_longer(table(spark, d, "documents"), "doc_id", "text")


def p10_evidence(spark: SparkSession, d: str) -> DataFrame:
    """What speaks for a cut, for every document."""
    return truncation.evidence(table(spark, d, "documents"), "doc_id", "text", "source")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_evidence(spark, d).where("truncated").select("doc_id")


def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    """How often each source hands over a cut text."""
    return truncation.source_shares(p10_evidence(spark, d))


QUERIES = {"p10_found": p10_found, "p10_evidence": p10_evidence, "p10_prefixes": p10_prefixes, "p10_sources": p10_sources, "p8_ids": p8_ids, "p8_counts": p8_counts, "p9_containers": p9_containers, "p9_fill": p9_fill, "p2_found": p2_found, "p2_rejected": p2_rejected, "p2_conversations": p2_conversations}
_TALKS = r"""lines AS (
  SELECT line_id, session_id AS s, coalesce(agent_id, '') AS a, nullif(uuid, '') AS u, parent_uuid AS p,
    CASE WHEN regexp_matches(coalesce(message.content, ''), '[^\s]') AND lower(trim(message.role)) IN ('user', 'assistant') THEN lower(trim(message.role)) END AS kind
  FROM transcript_line WHERE session_id <> ''),
once AS (SELECT s, u, a, p, kind FROM (SELECT *, row_number() OVER (PARTITION BY s, u ORDER BY line_id) AS n FROM lines WHERE u IS NOT NULL) WHERE n = 1),
good AS (SELECT s, u FROM once WHERE p IS NULL UNION ALL SELECT o.s, o.u FROM good g JOIN once o ON o.s = g.s AND o.p = g.u),
below AS (SELECT c.s, c.u AS at, c.kind, o.u AS asked, c.a FROM once o JOIN once c ON c.s = o.s AND c.a = o.a AND c.p = o.u WHERE o.kind = 'user'
  UNION SELECT c.s, c.u, c.kind, b.asked, c.a FROM below b JOIN once c ON c.s = b.s AND c.a = b.a AND c.p = b.at WHERE b.kind IS DISTINCT FROM 'user'),
answered AS (SELECT DISTINCT s, asked AS u FROM below WHERE kind = 'assistant'),
broken AS (SELECT DISTINCT s, a FROM once o WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.s = o.s AND g.u = o.u)),
empty AS (SELECT s, a FROM (SELECT s, a, kind FROM once UNION ALL SELECT s, a, kind FROM lines WHERE u IS NULL) GROUP BY s, a HAVING count(kind) = 0),
waiting AS (SELECT DISTINCT s, a FROM once o WHERE kind = 'user' AND NOT EXISTS (SELECT 1 FROM answered x WHERE x.s = o.s AND x.u = o.u) UNION SELECT s, a FROM lines WHERE u IS NULL AND kind = 'user')"""

_ORDERED = """
root AS (SELECT s, u, u AS root, line_id AS root_line, place AS root_order, [{'o': place, 'k': k}] AS way FROM numbered WHERE p IS NULL),
tour AS (SELECT * FROM root UNION ALL SELECT c.s, c.u, t.root, t.root_line, t.root_order, list_append(t.way, {'o': c.place, 'k': c.k}) FROM tour t JOIN numbered c ON c.s = t.s AND c.p = t.u),
placed AS (SELECT *, row_number() OVER (PARTITION BY s, root ORDER BY way) - 1 AS seq FROM tour),
out AS (SELECT session_id, agent_id FROM (SELECT s AS session_id, a AS agent_id FROM broken UNION SELECT s, a FROM empty UNION SELECT s, a FROM waiting)),
said AS (SELECT n.s AS session_id, n.a AS agent_id, t.root_order, t.root_line, t.seq, n.line_id, n.kind AS role FROM numbered n JOIN placed t ON t.s = n.s AND t.u = n.u WHERE n.kind IS NOT NULL
  UNION ALL SELECT s, a, coalesce(micros, 4611686018427387904), line_id, 0, line_id, kind FROM loose WHERE kind IS NOT NULL)"""
_NUMBERED = """
numbered AS (SELECT o.s, o.u, o.a, o.p, o.kind, o.line_id, coalesce(r.micros, 4611686018427387904) AS place, md5(o.s || chr(0) || o.u) AS k FROM (SELECT *, row_number() OVER (PARTITION BY s, u ORDER BY line_id) AS n FROM lines WHERE u IS NOT NULL) o LEFT JOIN read r ON r.k = o.line_id WHERE n = 1),
loose AS (SELECT l.*, r.micros FROM lines l LEFT JOIN read r ON r.k = l.line_id WHERE u IS NULL)"""
_CLOSERS_SQL = "".join("''" if c == "'" else "\\" + c if c in "[]()}{" else c for c in truncation._CLOSERS)
_STOPS_SQL = "".join(truncation._STOPS)
_BLANK = r"[\s\x{1c}-\x{1f}\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SQL: dict[str, str] = {
    "p10_prefixes": f"""WITH t AS (SELECT text, array_agg(doc_id) AS ids FROM documents WHERE text <> '' GROUP BY text), s AS (SELECT text, ids, regexp_replace(text, '{_BLANK}+$', '') AS bare FROM t),
w AS (SELECT *, regexp_matches(regexp_replace(bare, '[{_CLOSERS_SQL}]+$', ''), '[{_STOPS_SQL}]$') AS stops, regexp_matches(text, '{_BLANK}$') OR (bare <> '' AND unicode(right(bare, 1)) > 11903) AS never FROM s),
f AS (SELECT w.text, w.ids, bool_or(c NOT IN (chr(10), chr(13)) AND right(w.text, 1) NOT IN (chr(10), chr(13)) AND NOT (stops AND (never OR regexp_matches(c, '{_BLANK}')))) AS inside_line FROM w, LATERAL (SELECT substr(l.text, length(w.text) + 1, 1) AS c FROM t l WHERE length(l.text) > length(w.text) AND starts_with(l.text, w.text)) x GROUP BY ALL)
SELECT unnest(ids) AS doc_id, inside_line FROM f""",
    "p2_conversations": "WITH RECURSIVE " + stamped("read", "SELECT line_id AS k, ts AS raw, host_id FROM transcript_line") + f", {_TALKS},{_NUMBERED},{_ORDERED} SELECT c.*, t.message.content AS content FROM said c JOIN transcript_line t ON t.line_id = c.line_id WHERE NOT EXISTS (SELECT 1 FROM out o WHERE o.session_id = c.session_id AND o.agent_id = c.agent_id)",
    "p2_found": f"WITH RECURSIVE {_TALKS} SELECT s AS session_id, a AS agent_id FROM broken UNION SELECT s, a FROM empty UNION SELECT s, a FROM waiting",
    "p2_rejected": f"""WITH RECURSIVE {_TALKS} SELECT s AS session_id, a AS agent_id, bool_or(r = 1) AS broken, bool_or(r = 2) AS empty, bool_or(r = 3) AS unanswered
FROM (SELECT s, a, 1 AS r FROM broken UNION ALL SELECT s, a, 2 FROM empty UNION ALL SELECT s, a, 3 FROM waiting) GROUP BY s, a""",
}
