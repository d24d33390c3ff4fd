"""Texts cut off by field limits or broken transfers (problem 10).

Texts are sorted as values, so that the longer copies of a text stand right behind it; what they go on with tells whether
the cut is inside a line. Each source's field limits and block sizes are read off the lengths of its texts: those
that are improbably frequent beside their neighbours. How a text ends is the secondary evidence, for cuts that left no longer copy.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

#: A length is a source's field limit, or a power of two its block size, if chance would bring as many texts there with a
#: probability below this (Chernoff's bound for a Poisson count), and if it has so many times what its neighbourhood has, so
#: that large tables don't turn every uneven histogram into limits.
CHANCE, SPIKE = 1e-9, 5.0
#: The neighbourhood of a length: up to this share shorter or longer, and at least so many characters.
AROUND, LEAST_AROUND = 0.05, 16

#: Bytes of text of one sorted partition. Beginnings of texts that hold more than that are told apart by further pieces.
SORT_BYTES = 32 << 20
#: Characters of the first piece of a text that ranges are cut by; each further piece has four times as many.
KEY_CHARS = 128
#: Hot beginnings up to this number are joined by broadcast (each has more than SORT_BYTES of text).
BROADCAST_HOT = 10_000

# Kinds of endings.
BLANK, COMPLETE, STRUCTURE, ITEM, SENTENCE_OPEN, MARKUP_OPEN, MARKED = "blank", "complete", "structure", "item", "sentence_open", "markup_open", "marked"

_MARKED = re.compile(r"(?:\.\.\.|…|\[(?:\.\.\.|…)\]|\((?:\.\.\.|…)\)|[\[(](?:more|continued|truncated|cut|read more)[\])])$", re.I)
_STOPS = tuple(".!?:;。！？：；؟।")
_CLOSERS = "'\"”’»›」』)]}）】》"
_TABLE_LINE = re.compile(r"[|!]")
_LIST_LINE = re.compile(r"[*#:;]")


def _open_template(text: str) -> bool:
    """Whether a template or table that was opened is still open at the end, with no blank line since."""
    start = text.rfind("\n\n") + 1
    tail = text[start:]
    depth = 0
    for m in re.finditer(r"\{\{|\}\}|\{\||\|\}", tail):
        depth = depth + 1 if m[0][0] == "{" else max(0, depth - 1)
    return depth > 0


def ending(text: str | None) -> str:
    """How a text ends, white space at its end aside.

    marked: by a sign that something was left out. markup_open: inside a link, template, table, tag, comment or heading.
    sentence_open: inside a word or sentence of running text. structure: with a whole list item, heading, table row,
    link, template or tag. item: with a list item's bare word, which may be whole. complete: with a sentence's stop.
    """
    s = (text or "").rstrip().rstrip("�").rstrip()
    if not s:
        return BLANK
    if _MARKED.search(s):
        return MARKED
    line = s[s.rfind("\n") + 1 :]
    lead = line.lstrip()
    stopped = s.rstrip(_CLOSERS).endswith(_STOPS)
    if stopped and not re.search(r"<ref\b[^<>]*>?[^<>]{0,80}$", line):
        return COMPLETE  # markup left open earlier is unbalanced, not cut
    if s.rfind("<!--") > s.rfind("-->") or line.rfind("[[") > line.rfind("]]") or s.rfind("<") > s.rfind(">") and s.rfind("<") > s.rfind("\n"):
        return MARKUP_OPEN
    ref = max(line.rfind("<ref>"), line.rfind("<ref "))
    if ref >= 0 and "</ref>" not in line[ref:] and "/>" not in line[ref:]:
        return MARKUP_OPEN
    if _open_template(s) or re.search(r"(?<!\[)\[$|(?<!\{)\{$", s):
        return MARKUP_OPEN
    if lead.startswith("=") and not lead.rstrip().endswith("="):
        return MARKUP_OPEN
    if _LIST_LINE.match(lead) and s[-1].isalnum():
        return ITEM
    if lead.startswith("=") or _LIST_LINE.match(lead) or _TABLE_LINE.match(lead) or lead.startswith("{|"):
        return STRUCTURE
    if s.endswith(("]]", "}}", "|}", ">", "]")):
        return STRUCTURE
    return COMPLETE if stopped else SENTENCE_OPEN


def _goes_on(text: str, longer: str) -> bool:
    """Whether a longer copy goes on inside the line at which the text stops, other than with a new sentence."""
    rest = longer[len(text) :]
    if rest[:1] in ("\n", "\r") or text.endswith(("\n", "\r")):
        return False
    return not (text.rstrip().rstrip(_CLOSERS).endswith(_STOPS) and (rest[:1].isspace() or text[-1:].isspace() or ord(text.rstrip()[-1]) > 0x2E7F))


# What follows a text, as bits: any character, one that isn't a line break, one that isn't white space.
ANY, IN_LINE, VISIBLE = 1, 2, 4


def _bits(c: str) -> int:
    return ANY | (IN_LINE if c not in "\n\r" else 0) | (VISIBLE if not c.isspace() else 0)


def _wanted(text: str) -> int:
    """The bit of what must follow for a text to be cut inside a line; 0 if nothing can (see _goes_on)."""
    if text.endswith(("\n", "\r")):
        return 0
    bare = text.rstrip()
    if not bare.rstrip(_CLOSERS).endswith(_STOPS):
        return IN_LINE
    return 0 if text[-1:].isspace() or ord(bare[-1]) > 0x2E7F else VISIBLE


def common(a: str, b: str) -> int:
    """How many characters two texts have in common from their start."""
    low, high = 0, min(len(a), len(b))
    if a[:16] != b[:16]:
        high = min(high, 16)
    elif a[:high] == b[:high]:
        return high
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


@F.pandas_udf(T.LongType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common(x, y) for x, y in zip(a.tolist(), b.tolist())])


@F.pandas_udf(T.StructType([T.StructField("depth", T.LongType()), T.StructField("bits", T.IntegerType())]))
def _meet(last: pd.Series, first: pd.Series) -> pd.DataFrame:
    """Where the last text of a partition and the first of the next part, and what follows there."""
    at = [common(a, b) for a, b in zip(last.tolist(), first.tolist())]
    return pd.DataFrame({"depth": at, "bits": [_bits(b[i]) if len(b) > i else 0 for i, b in zip(at, first.tolist())]})



# Rows of a sorted partition: a copy of text `no`; the verdict on one; a text that begins the partition's last one, and so
# may go on in the next partition; what follows the first depth characters of the partition's first text; its ends.
MEMBER, VERDICT, OPEN, FOLLOWS, ENDS, MEETS = range(6)


def _sort_keys(texts: DataFrame, size: int) -> tuple[DataFrame, list[str]]:
    """texts (k, t) with short columns that sort as t does, by which the ranges of partitions are cut.

    They are pieces of t. A beginning that holds more than a partition's share gets a further piece, taken from
    where its texts begin to differ; copies of one text get their key, so that they spread. No whole text is a sort key.
    """
    keyed = texts.withColumns({"key0": F.substring("t", 1, KEY_CHARS), "salt": F.lit("")})
    keys, width, open_ = ["key0"], KEY_CHARS, F.lit(True)
    while size > SORT_BYTES:
        groups = keyed.where(open_).groupBy(*keys).agg(F.sum(F.octet_length("t")).alias("_bytes"))
        hot = materialize(groups.where(F.col("_bytes") > SORT_BYTES).select(*keys), "beginnings")
        n = hot.count()
        if n == 0:
            break
        small = (lambda x: F.broadcast(x)) if n <= BROADCAST_HOT else (lambda x: x)
        spread = keyed.where(open_).join(small(hot), keys).groupBy(*keys).agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
        place = materialize(spread.select(*keys, _common("_a", "_b").alias("_m"), (F.col("_a") == F.col("_b")).alias("_equal")), "beginnings")
        width *= 4
        name = f"key{len(keys)}"
        joined = keyed.join(small(place), keys, "left")
        more = F.when(F.col("_m").isNotNull() & ~F.col("_equal"), F.substring(F.col("t"), F.col("_m").cast("int") + 1, F.lit(width))).otherwise("")
        salt = F.when(F.coalesce("_equal", F.lit(False)), F.lpad(F.col("k").cast("string"), 20, "0")).otherwise(F.col("salt"))
        keyed = joined.select("k", "t", *keys, more.alias(name), salt.alias("salt"))
        open_ = F.col(name) != ""
        keys.append(name)
    return keyed, [*keys, "salt"]


def prefix_of_longer(docs: DataFrame, key: str, text: str, size: int | None = None) -> DataFrame:
    """(key, inside_line): the documents whose text is a strict prefix of a longer text elsewhere.

    inside_line is whether any of the longer texts goes on inside the line at which the text stops. Every text but null and empty
    ones takes part, however short. In sorted order all texts that begin with a text stand behind it in one run. A
    stack holds the texts that begin the current one; where two neighbours part tells which of them sees a new
    character. What is still open at a partition's end is settled by numbers alone: the depth at which partitions part from each
    other, and what follows there. size is the bytes of all texts, if known.
    """
    spark = docs.sparkSession
    kept = docs.where(F.length(text) > 0).select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    schema = T.StructType([
        T.StructField("kind", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("no", T.LongType()), T.StructField("k", kept.schema["k"].dataType), T.StructField("depth", T.LongType()),
        T.StructField("wanted", T.IntegerType()), T.StructField("bits", T.IntegerType()), T.StructField("first", T.StringType()), T.StructField("last", T.StringType()),
    ])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, no, now, first = TaskContext.get().partitionId(), -1, None, None
        stack: list[list[int]] = []  # [depth, no, wanted, bits] of the texts that begin the current one, itself included
        spine: dict[int, int] = {}
        shared = 0  # characters that all texts so far have in common with the first
        frame = lambda rows: pd.DataFrame(rows, columns=schema.names)
        verdict = lambda x: (VERDICT, part, x[1], None, x[0], x[2], x[3], None, None)
        for pdf in batches:
            out = []
            for k, t in zip(pdf["k"].tolist(), pdf["t"].tolist()):
                if t != now:
                    if now is None:
                        first, shared = t, len(t)
                    else:
                        at = common(now, t)
                        while stack and stack[-1][0] > at:
                            x = stack.pop()
                            if x[3]:
                                out.append(verdict(x))
                        if stack and stack[-1][0] == at:
                            stack[-1][3] |= _bits(t[at])
                        if at <= shared:
                            spine[at] = spine.get(at, 0) | _bits(t[at])
                            shared = at
                    now, no = t, no + 1
                    stack.append([len(t), no, _wanted(t), 0])
                out.append((MEMBER, part, no, k, None, None, None, None, None))
            yield frame(out)
        if now is not None:
            rows = [(OPEN, part, x[1], None, x[0], x[2], x[3], None, None) for x in stack]
            rows += [(FOLLOWS, part, None, None, depth, None, bits, None, None) for depth, bits in spine.items()]
            yield frame([*rows, (ENDS, part, None, None, shared, None, None, first, now)])

    if size is None:
        size = kept.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(size / SORT_BYTES))
    keyed, keys = _sort_keys(kept, size)
    laid = keyed.repartitionByRange(parts, *keys).sortWithinPartitions("t", "k").select("k", "t")
    seen = materialize(laid.mapInPandas(run, schema), "prefixes", ["kind"])
    inside = (F.col("wanted") > 0) & (F.col("bits").bitwiseAND(F.col("wanted")) > 0)
    told = seen.where(F.col("kind") == VERDICT).unionByName(_settle(seen), allowMissingColumns=True).where("bits > 0")
    members = seen.where(F.col("kind") == MEMBER).select("part", "no", "k")
    return members.join(told.select("part", "no", inside.alias("inside_line")), ["part", "no"]).select(F.col("k").alias(key), "inside_line")


def _cut(ahead: list[list[int]], depth: int) -> None:
    while ahead and ahead[-1][0] > depth:
        ahead.pop()


def _add(ahead: list[list[int]], depth: int, bits: int) -> None:
    if bits and ahead and ahead[-1][0] == depth:
        ahead[-1][1] |= bits
    elif bits:
        ahead.append([depth, bits])


def _settle(seen: DataFrame) -> DataFrame:
    """(part, no, wanted, bits) of the texts open at the ends of partitions, with what follows them in later ones.

    Texts meet pairwise only: the last of a partition and the first of the next one. What goes to one task are a few numbers for each
    partition.
    """
    ends = seen.where(F.col("kind") == ENDS).select("part", "first", "last", F.col("depth").alias("shared"))
    order = materialize(ends.select("part", "shared"), "order")
    follows = order.selectExpr("part", "lead(part) OVER (ORDER BY part) AS next").where("next is not null")
    pairs = ends.select("part", "last").join(follows, "part").join(ends.select(F.col("part").alias("next"), "first"), "next")

    facts = seen.where(F.col("kind").isin(OPEN, FOLLOWS)).select("kind", "part", "no", "depth", "wanted", "bits")
    none = lambda t: F.lit(None).cast(t)
    numbers = facts.unionByName(order.select(F.lit(ENDS).alias("kind"), "part", none("long").alias("no"), F.col("shared").alias("depth"), none("int").alias("wanted"), none("int").alias("bits")))
    meets = pairs.select("next", _meet("last", "first").alias("p")).select(F.lit(MEETS).alias("kind"), F.col("next").alias("part"), none("long").alias("no"), "p.depth", none("int").alias("wanted"), "p.bits")

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [b for b in batches if len(b)]
        if not frames:
            return
        rows = pd.concat(frames)
        out: list[tuple] = []
        ahead: list[list[int]] = []  # [depth, bits], deepest last: what follows the beginnings of a partition's first text
        meets: tuple | None = None  # where the later partition parts from the one at hand, and what follows there
        for part, group in sorted(rows.groupby("part"), key=lambda x: -x[0]):
            pick = lambda kind, *names: [tuple(map(int, x)) for x in group.loc[group["kind"] == kind, list(names)].itertuples(index=False)]  # noqa: B023, E731
            _cut(ahead, -1 if meets is None else meets[0])
            if meets is not None:
                _add(ahead, *meets)
            found = dict(map(tuple, ahead))
            out += [(part, no, wanted, bits | found.get(depth, 0)) for no, depth, wanted, bits in pick(OPEN, "no", "depth", "wanted", "bits")]
            _cut(ahead, pick(ENDS, "depth")[0][0])  # beginnings that all texts of this partition share see what is ahead
            for depth, bits in sorted(pick(FOLLOWS, "depth", "bits")):
                _add(ahead, depth, bits)
            meets = next(iter(pick(MEETS, "depth", "bits")), None)
        yield pd.DataFrame(out, columns=["part", "no", "wanted", "bits"])

    return numbers.unionByName(meets).coalesce(1).mapInPandas(resolve, "part int, no long, wanted int, bits int")


def described(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key, source, ending, chars, bytes, hash) of each text, read whole."""

    @F.pandas_udf(T.StringType())
    def how(t: pd.Series) -> pd.Series:
        return pd.Series([ending(x) if isinstance(x, str) else BLANK for x in t.tolist()], dtype=object)

    body = F.col(text).cast("string")
    return docs.select(F.col(key), F.col(source).alias("source"), how(body).alias("ending"), F.length(body).alias("chars"), F.octet_length(body).alias("bytes"), F.xxhash64(body).alias("hash"))


def improbable(n: Column, expected: Column) -> Column:
    """Whether n is SPIKE times what is expected, and chance brings so many with a probability below CHANCE."""
    return (n > SPIKE * expected) & (n * F.log(n / expected) - n + expected > -math.log(CHANCE))


def _lengths(texts: DataFrame) -> DataFrame:
    """source, unit (chars or bytes), size, n: how many different texts of a source have each length. Every text counts."""
    once = texts.where("chars > 0").select("source", "chars", "bytes", "hash").distinct()
    sizes = once.select("source", F.explode(F.create_map(F.lit("chars"), F.col("chars"), F.lit("bytes"), F.col("bytes"))).alias("unit", "size"))
    return sizes.groupBy("source", "unit", "size").agg(F.count(F.lit(1)).alias("n"))


def field_limits(texts: DataFrame) -> DataFrame:
    """(source, unit, size): lengths at which a source cuts its texts, over its whole histogram of lengths.

    A limit has improbably many different texts for its neighbourhood, AROUND it on both sides; lengths that nothing is near are
    held against LEAST_AROUND lengths with one text.
    """
    counts = _lengths(texts)
    # Running sums of the histogram give each neighbourhood's total: a join on nothing but source, unit and a length bucket.
    width = F.greatest(F.floor(F.col("size") * AROUND), F.lit(LEAST_AROUND))
    asked = counts.where("n >= 3").withColumns({"low": F.col("size") - width, "high": F.col("size") + width})
    step = F.greatest(F.floor(F.log2("size")), F.lit(0)).cast("int")
    near = asked.withColumn("step", F.explode(F.sequence(F.floor(F.log2(F.greatest("low", F.lit(1)))).cast("int"), F.floor(F.log2("high")).cast("int"))))
    other = counts.select(F.col("source").alias("s2"), F.col("unit").alias("u2"), F.col("size").alias("z2"), F.col("n").alias("n2"), step.alias("step2"))
    same = F.col("source").eqNullSafe(F.col("s2")) & (F.col("unit") == F.col("u2")) & (F.col("step") == F.col("step2"))
    inside = same & (F.col("z2") >= F.col("low")) & (F.col("z2") <= F.col("high")) & (F.col("z2") != F.col("size"))
    total = near.join(other, inside, "left").groupBy("source", "unit", "size", "n", "low", "high").agg(F.coalesce(F.sum("n2"), F.lit(0)).alias("around"))
    expected = F.greatest(F.col("around"), F.lit(1)) / (F.col("high") - F.greatest(F.col("low"), F.lit(1)))
    return total.where(improbable(F.col("n"), expected)).select("source", "unit", "size")


def block_sizes(texts: DataFrame) -> DataFrame:
    """(source, block): the power of two at whose multiples a source's transfers break, if any.

    That of which improbably many of the source's different texts have a multiple of bytes; of several the most improbable.
    """
    counts = _lengths(texts).where("unit = 'bytes'")
    powers = F.explode(F.array(*(F.lit(1 << i) for i in range(6, 17)))).alias("block")
    each = counts.select("source", "size", "n", powers)
    total = each.groupBy("source", "block").agg(F.sum("n").alias("all"), F.sum(F.when(F.col("size") % F.col("block") == 0, F.col("n")).otherwise(0)).alias("hits"))
    expected = F.col("all") / F.col("block")
    score = F.col("hits") * F.log(F.col("hits") / expected) - F.col("hits") + expected
    return total.where(improbable(F.col("hits"), expected)).groupBy("source").agg(F.max_by("block", score).alias("block"))


def evidence(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """Every document with what speaks for a cut, and `truncated`, the verdict.

    key, source, ending, at_limit, at_block, has_longer, inside_line, truncated, by. A text is truncated if a longer copy goes on
    inside its last line (by: prefix); if it has one of its source's field limits and doesn't end with a whole sentence (limit);
    if it ends in an open sentence, open markup or a list item's bare word where its source's blocks end (block); or, the secondary
    evidence, if its end is open (sentence or markup) or marked as cut (ending). Null, empty and blank texts aren't truncated.
    """
    texts = materialize(described(docs, key, text, source), "endings")
    limits = field_limits(texts)
    as_chars = limits.where("unit = 'chars'").select(F.col("source").alias("s1"), F.col("size").alias("z1"), F.lit(True).alias("by_chars"))
    # A byte limit may fall inside a character, which is then dropped or replaced.
    as_bytes = limits.where("unit = 'bytes'").select(F.col("source").alias("s2"), F.explode(F.sequence(F.col("size") - 3, F.col("size"))).alias("z2"), F.lit(True).alias("by_bytes")).distinct()
    blocks = block_sizes(texts).select(F.col("source").alias("s3"), "block")
    size = texts.agg(F.sum("bytes")).first()[0] or 0
    longer = prefix_of_longer(docs, key, text, size).groupBy(key).agg(F.max("inside_line").alias("inside_line"))
    told = texts.join(as_chars, F.col("source").eqNullSafe(F.col("s1")) & (F.col("chars") == F.col("z1")), "left").join(as_bytes, F.col("source").eqNullSafe(F.col("s2")) & (F.col("bytes") == F.col("z2")), "left")
    told = told.join(blocks, F.col("source").eqNullSafe(F.col("s3")), "left").join(longer, key, "left")
    at_limit = F.coalesce("by_chars", "by_bytes", F.lit(False))
    at_block = F.coalesce(F.col("bytes") % F.col("block") == 0, F.lit(False))
    told = told.select(key, "source", "ending", at_limit.alias("at_limit"), at_block.alias("at_block"), F.col("inside_line").isNotNull().alias("has_longer"), F.coalesce("inside_line", F.lit(False)).alias("inside_line"))
    end = F.col("ending")
    by = (
        F.when(end == BLANK, F.lit(None)).when(F.col("inside_line"), "prefix").when(F.col("at_limit") & (end != COMPLETE), "limit")
        .when(F.col("at_block") & end.isin(SENTENCE_OPEN, MARKUP_OPEN, ITEM), "block").when(end.isin(SENTENCE_OPEN, MARKUP_OPEN, MARKED), "ending")
    )
    return told.withColumn("by", by).withColumn("truncated", F.col("by").isNotNull())


def source_shares(told: DataFrame) -> DataFrame:
    """(source, documents, truncated, by_prefix, by_limit, by_block, by_ending, share) of evidence()."""
    kinds = [F.sum((F.coalesce("by", F.lit("")) == k).cast("long")).alias(f"by_{k}") for k in ("prefix", "limit", "block", "ending")]
    per = told.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("truncated").cast("long")).alias("truncated"), *kinds)
    return per.withColumn("share", F.col("truncated") / F.col("documents"))
