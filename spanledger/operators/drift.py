"""Schemas that drift between files (problem 5): rescue-column ingestion and a report of every change.

Bodies are read against a target schema. What the target lacks, and what can't be cast to its type, is kept as
JSON in a rescue column; approved fields can be promoted later, replaying the rescued values into typed columns.
The same pass writes down each record's layout (its field paths and their kinds), from which the changes between files
are told: the one table and the report come from the same rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsonwalk import KINDS, Num, clean, dumps, field_paths, kind, whole_object
from ..session import materialize

_TYPES = {"string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_LONG = 2**63


@dataclass(frozen=True)
class Target:
    """A column of the target table: its name, type, and the paths it may be written under, the preferred first."""

    name: str
    type: str
    paths: tuple[str, ...]


def with_spellings(targets: list[Target], aliases: list[tuple[str, str]]) -> list[Target]:
    """The targets with every known spelling of their paths: aliases are (canonical path, spelling), each group one field."""
    groups: dict[str, list[str]] = {}
    for canonical, spelling in sorted(aliases):
        groups.setdefault(canonical, [canonical]).append(spelling)
    out = []
    for target in targets:
        paths = list(target.paths)
        for path in target.paths:
            for group in groups.values():
                if path in group:
                    paths += group
        out.append(replace(target, paths=tuple(dict.fromkeys(paths))))
    return out


def cast(value, to: str):
    """(fits, value) of a JSON scalar for a target type. Null fits every type.

    Only lossless casts fit: a number, or a string spelled as a JSON number, whose value the target type holds exactly
    (a double: which prints back as the same decimal); true and false; for strings any scalar, as it was written.
    """
    if value is None:
        return True, None
    if isinstance(value, (dict, list)):
        return False, None
    if to == "string":
        return True, clean(value) if isinstance(value, str) and not isinstance(value, Num) else dumps(value)
    if to == "boolean":
        if isinstance(value, bool):
            return True, value
        return (True, value == "true") if value in ("true", "false") else (False, None)
    text = value if isinstance(value, str) else dumps(value)
    if isinstance(value, bool) or len(text) > 400 or not _NUMBER.fullmatch(text):
        return False, None
    try:
        exact = Decimal(text)
        if to == "double":
            number = float(text)
            return (True, number) if number - number == 0 and Decimal(repr(number)) == exact else (False, None)
        if exact.adjusted() > 18 or exact != exact.to_integral_value():
            return False, None
        number = int(exact)
    except ArithmeticError:
        return False, None
    return (True, number) if -_LONG <= number < _LONG else (False, None)


def ingest_body(body: dict, targets: list[Target]) -> tuple[list, str | None, dict[str, int]]:
    """(values of the targets, rescued fields as a JSON object of path to value or None, kinds of each path)."""
    fields: dict[str, object] = {}
    layout: dict[str, int] = {}
    for path, value in field_paths(body):
        layout[path] = layout.get(path, 0) | kind(value)
        while path in fields:  # keys with dots may spell another chain's path
            path += "#"
        fields[path] = value
    used, values = set(), []
    for target in targets:
        got = None
        for path in target.paths:
            if path in fields:
                fits, value = cast(fields[path], target.type)
                if fits:
                    used.add(path)
                    if got is None:
                        got = value
                    elif value is not None and value != got:
                        used.discard(path)
        values.append(got)
    rescued = {p: v for p, v in fields.items() if p not in used and not (isinstance(v, dict) and v)}
    return values, clean(dumps(rescued)) if rescued else None, layout


def layout_text(layout: dict[str, int]) -> str:
    """One spelling of a layout: equal layouts are equal texts."""
    text = json.dumps(layout, sort_keys=True, separators=(",", ":"))
    # An escape of a lone surrogate can't be read back as UTF-8.
    return text if "\\ud" not in text else json.dumps({clean(p): layout[p] for p in sorted(layout)}, sort_keys=True, separators=(",", ":"))


def ingest(records: DataFrame, keys: list[str], body: str, targets: list[Target]) -> DataFrame:
    """keys, _whole, a column for each target, _rescued and _layout.

    A body that isn't one whole JSON object (null, blank, incomplete) is kept: _whole is false, the targets are
    null and _rescued holds the text itself as a JSON string, null for a null body. _layout is a JSON object of the body's
    field paths (see jsonwalk.field_paths for very long ones) and their kinds (bits of KINDS), null for a body that isn't whole.
    """
    kept = records.select(*keys, F.col(body).alias("_body"))
    schema = T.StructType([
        *(kept.schema[k] for k in keys), T.StructField("_whole", T.BooleanType()), *(T.StructField(t.name, _TYPES[t.type]) for t in targets), T.StructField("_rescued", T.StringType()), T.StructField("_layout", T.StringType()),
    ])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["_body"].tolist():
                value = whole_object(text if isinstance(text, str) else None)
                if value is None:
                    rows.append([False, *[None] * len(targets), dumps(clean(text)) if isinstance(text, str) else None, None])
                else:
                    values, rescued, layout = ingest_body(value, targets)
                    rows.append([True, *values, rescued, layout_text(layout)])
            out = pd.DataFrame(rows, columns=["_whole", *(t.name for t in targets), "_rescued", "_layout"], dtype=object)
            yield pd.concat([pdf[keys].reset_index(drop=True), out], axis=1)

    return kept.mapInPandas(run, schema)


def promote(ingested: DataFrame, target: Target) -> DataFrame:
    """ingested with one more typed column, filled by replaying the rescued values of an approved field.

    Replayed values leave the rescue column; those that don't fit the type stay in it.
    """
    last = ("_rescued", "_layout")
    schema = T.StructType([*(f for f in ingested.schema if f.name not in last), T.StructField(target.name, _TYPES[target.type]), *(f for f in ingested.schema if f.name in last)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            values, rest = [], []
            for whole, text in zip(pdf["_whole"].tolist(), pdf["_rescued"].tolist()):
                got = None
                if whole and isinstance(text, str):
                    fields = whole_object(text)
                    for path in target.paths:
                        if path in fields:
                            fits, value = cast(fields[path], target.type)
                            if fits and (got is None or value is None or value == got):
                                got = value if got is None else got
                                del fields[path]
                    text = dumps(fields) if fields else None
                values.append(got)
                rest.append(text)
            yield pdf.assign(**{target.name: pd.Series(values, dtype=object), "_rescued": pd.Series(rest, dtype=object)})[schema.names]

    return ingested.mapInPandas(run, schema)


def field_catalogue(ingested: DataFrame, file_keys: list[str]) -> DataFrame:
    """file_keys, path, kinds (bits of KINDS), n: the fields of each file over its ingested whole bodies.

    Records of one layout are counted before it is read, in the partition first: what is taken apart and shuffled are the
    layouts of files, not records.
    """
    count = F.sum("n") if "n" in ingested.columns else F.count(F.lit(1))
    layouts = ingested.where("_layout is not null").groupBy(*file_keys, "_layout").agg(count.alias("n"))
    fields = layouts.select(*file_keys, "n", F.explode(F.from_json("_layout", "map<string,int>")).alias("path", "kinds"))
    return fields.groupBy(*file_keys, "path").agg(F.bit_or("kinds").alias("kinds"), F.sum("n").alias("n"))


def kind_names(bits: Column) -> Column:
    """The names of the kinds in a bit column, in the order of KINDS, joined by commas."""
    return F.concat_ws(",", *[F.when(bits.bitwiseAND(1 << i) > 0, name) for i, name in enumerate(KINDS)])


def changes(ingested: DataFrame, aliases: DataFrame) -> DataFrame:
    """feed_id, file_no, field_path, change, was, now: each file against the file before it in its feed.

    change is renamed, added, removed or retyped. The first file of a feed changes nothing. A file without any
    whole body has no fields, so what was there before it is removed. Rows without feed or file number are in no
    file. ingested, of ingest(), needs feed_id, feed_kind and file_no among its keys; aliases needs feed_kind, canonical_path,
    spelling_path.
    """
    placed = ingested.where("feed_id is not null and file_no is not null")
    # A file without whole bodies is a file too: its row has no path.
    counted = materialize(placed.groupBy("feed_id", "file_no", "_layout").agg(F.max("feed_kind").alias("feed_kind"), F.count(F.lit(1)).alias("n")), "layouts")
    files = counted.groupBy("feed_id", "file_no").agg(F.max("feed_kind").alias("feed_kind"))
    order = Window.partitionBy("feed_id").orderBy("file_no")
    files = files.withColumns({"before": F.lag("file_no").over(order), "after": F.lead("file_no").over(order)})
    paths = field_catalogue(counted, ["feed_id", "file_no"]).join(files, ["feed_id", "file_no"])
    # Each field is laid against the file that has it (1) and against the file after it (2).
    sides = paths.select("feed_id", "feed_kind", "path", F.explode(F.array(
        F.struct(F.when(F.col("before").isNotNull(), F.col("file_no")).alias("file_no"), F.col("kinds").alias("now"), F.lit(None).cast("int").alias("was")),
        F.struct(F.col("after").alias("file_no"), F.lit(None).cast("int").alias("now"), F.col("kinds").alias("was")),
    )).alias("s")).select("feed_id", "feed_kind", "path", "s.*").where("file_no is not null")
    both = sides.groupBy("feed_id", "feed_kind", "file_no", "path").agg(F.max("now").alias("now"), F.max("was").alias("was"))
    differs = both.where("now is null or was is null or (now <> was and now > 0 and was > 0)")
    known = aliases.select("feed_kind", F.col("canonical_path").alias("grp"), F.explode(F.array("spelling_path", "canonical_path")).alias("path")).distinct()
    state = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("retyped")
    told = differs.withColumn("change", state).join(known, ["feed_kind", "path"], "left")
    mates = Window.partitionBy("feed_id", "file_no", "grp")
    told = told.withColumns({
        "news": F.max((F.col("change") == "added").cast("int")).over(mates),
        "gone": F.max((F.col("change") == "removed").cast("int")).over(mates),
    })
    paired = F.col("grp").isNotNull() & (F.col("news") == 1) & (F.col("gone") == 1)
    # A path may be in several groups: one that pairs it is enough.
    told = told.groupBy("feed_id", "file_no", "path", "change", "was", "now").agg(F.max(paired).alias("paired"))
    told = told.withColumn("change", F.when(F.col("paired") & (F.col("change") == "added"), "renamed").when(F.col("paired") & (F.col("change") == "removed"), F.lit(None)).otherwise(F.col("change")))
    return told.where("change is not null").select("feed_id", "file_no", F.col("path").alias("field_path"), "change", kind_names(F.col("was")).alias("was"), kind_names(F.col("now")).alias("now"))
