"""Telemetry streams of concatenated, pretty-printed JSON objects."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from ..functions.scalars import rfc3339_seconds
from .lines import as_usage, count_of, number_of, used


_MARKS = re.compile(r'[{}"]')
_QUOTED = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)


def split_objects(text: str) -> list[tuple[int, int]]:
    """(start, end) of each whole top-level object, strings and escapes minded; an open object at the end is left out.

    Outside of objects quotes mean nothing. Only braces and quotes are looked at, strings are skipped whole.
    """
    out, depth, start, at = [], 0, -1, 0
    while m := _MARKS.search(text, at):
        at = m.end()
        if m[0] == "{":
            start = m.start() if depth == 0 else start
            depth += 1
        elif m[0] == "}" and depth:
            depth -= 1
            if depth == 0:
                out.append((start, at))
        elif m[0] == '"' and depth:
            string = _QUOTED.match(text, m.start())
            if string is None:
                break
            at = string.end()
    return out


@udtf(returnType="pos int, object string")
class SplitObjects:
    def eval(self, text: str):
        for n, (a, b) in enumerate(split_objects(text or "")):
            yield n, text[a:b]


def read_objects(spark, path: str) -> DataFrame:
    """file, pos, object of every whole object below path. A file is read as a whole, which bounds it by a task's memory."""
    spark.udtf.register("split_objects", SplitObjects)
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    raw.createOrReplaceTempView("_telemetry_files")
    return spark.sql("SELECT f.file, o.pos, o.object FROM _telemetry_files f, LATERAL split_objects(f.value) o")


_FIELDS = ["event.name", "event.timestamp", "model", "prompt_id", "session.id"]
_COUNTS = ["status_code", "input_token_count", "output_token_count", "cached_content_token_count", "thoughts_token_count", "total_token_count"]
_ATTRIBUTES = T.StructType([T.StructField("attributes", T.StructType([*(T.StructField(f, T.StringType()) for f in _FIELDS), *(T.StructField(f, T.DoubleType()) for f in _COUNTS)]))])


def telemetry_usage(objects: DataFrame, billing: str = "per_token") -> DataFrame:
    """Successful API responses of named models. Cached tokens are part of the prompt and are taken out of it.

    Identity is the prompt, the stamp and the total; a record without prompt id or stamp has none. Complete records without
    tokens are left out.
    """
    a = objects.select(F.monotonically_increasing_id().alias("seq"), F.from_json("object", _ATTRIBUTES).alias("o")).select("seq", "o.attributes.*")
    ok = F.col("status_code").isNull() | F.col("status_code").between(200, 299)
    rows = a.where((F.col("`event.name`") == "gemini_cli.api_response") & ok & (F.trim("model") != ""))
    cached = F.least(number_of("cached_content_token_count"), number_of("input_token_count"))
    total = F.coalesce(F.when(F.col("total_token_count") == F.floor("total_token_count"), F.col("total_token_count").cast("long")), F.lit(0))
    named = F.col("prompt_id").isNotNull() & F.col("`event.timestamp`").isNotNull()
    out = as_usage(
        rows, seq=F.col("seq"), event_id=F.when(named, F.concat_ws(":", F.lit("gemini"), "prompt_id", "`event.timestamp`", total.cast("string"))), provider=F.lit("gemini"), model=F.trim("model"), billing=F.lit(billing), input=number_of("input_token_count") - cached,
        output=number_of("output_token_count"), reasoning=number_of("thoughts_token_count"), cache_read=cached, created=F.coalesce(rfc3339_seconds(F.col("`event.timestamp`")), F.lit(0)), session_id=F.col("`session.id`"),
        incomplete=count_of("input_token_count").isNull() | count_of("output_token_count").isNull(),
    )
    return out.where(used())
