"""Nested records to flat parent and child tables (problem 6) with Merkle subtree identities.

Objects are canonicalised and hashed bottom-up: an object's text names its scalars, and its nested objects and
arrays by the hashes of what is in them. Identical objects are stored once; every occurrence is a bridge row that
links it to its parent's occurrence, with the array it stands in and its ordinals. The scalars of the stored objects
are rows of their own, typed, so that the flat tables can be queried.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsonwalk import Num, canonical, clean, digest, whole_object
from ..session import materialize

_OCC = T.StructType([
    T.StructField("rec_id", T.LongType()), T.StructField("node", T.IntegerType()), T.StructField("parent_node", T.IntegerType()), T.StructField("hash", T.BinaryType()), T.StructField("parent_hash", T.BinaryType()),
    T.StructField("field", T.StringType()), T.StructField("path", T.StringType()), T.StructField("item_pos", T.StringType()), T.StructField("ordinal", T.IntegerType()), T.StructField("in_array", T.BooleanType()), T.StructField("canonical", T.StringType()),
])
#: An object that makes up more than one occurrence in so many is joined by broadcast.
HOT_PARTS = 1024
#: Rows and characters that a worker holds back before it hands a batch on.
BATCH_ROWS, BATCH_CHARS = 20_000, 16 << 20


def occurrences_of(body: dict) -> Iterator[tuple]:
    """(node, parent node, hash, parent hash, field, path, item_pos, ordinal, in an array, canonical text) of every object.

    Node 0 is the record itself; a parent comes before its children. field is the key under the parent, `[]` after it
    for each array entered. Of an array's element path is the dotted keys from the top to the array, `[]` after each
    enclosing array's key, and item_pos its positions in those arrays; other objects have neither. Both are made when a row
    is handed on: a body of one chain, however deep, holds no more than its own length at a time.
    """
    parents: list[int | None] = [None]
    fields, places, ordinals, inside = [""], [()], [0], [False]
    hashes: list[bytes | None] = [None]
    texts: list[str | None] = [None]

    # Depth first without recursion: an object waits for the canonical forms of what is in it.
    todo: list[tuple] = [("open", body, 0, None, None)]
    forms: dict[int, dict] = {}
    while todo:
        act, value, node, into, key = todo.pop()[:5]
        if act == "open":
            form: dict = {}
            forms[node] = form
            todo.append(("close", value, node, into, key))
            for i, (k, child) in reversed(list(enumerate(value.items()))):
                if isinstance(child, dict):
                    number = len(parents)
                    todo.append(("open", child, number, form, k))
                    parents.append(node)
                    fields.append(k)
                    places.append(())
                    ordinals.append(i)
                    inside.append(False)
                    hashes.append(None)
                    texts.append(None)
                elif isinstance(child, list):
                    form[k] = [None] * len(child)
                    arrays = [(child, form[k], k, ())]
                    while arrays:  # arrays in arrays: their objects are children of this node
                        items, held, name, at = arrays.pop()
                        for j, item in enumerate(items):
                            if isinstance(item, dict):
                                number = len(parents)
                                todo.append(("open", item, number, held, j))
                                parents.append(node)
                                fields.append(name + "[]")
                                places.append((*at, j))
                                ordinals.append(j)
                                inside.append(True)
                                hashes.append(None)
                                texts.append(None)
                            elif isinstance(item, list):
                                held[j] = [None] * len(item)
                                arrays.append((item, held[j], name + "[]", (*at, j)))
                            else:
                                held[j] = item
                else:
                    form[k] = child
        else:
            text = canonical(forms.pop(node))
            hashes[node], texts[node] = digest(text), text
            if into is not None:
                into[key] = {"#": hashes[node].hex()}
    for node, parent in enumerate(parents):
        path = pos = None
        if inside[node]:
            keys, spots, at = [fields[node][:-2]], [places[node]], parent
            while at is not None and at != 0:
                keys.append(fields[at])
                spots.append(places[at])
                at = parents[at]
            path, pos = ".".join(reversed(keys)), ".".join(str(j) for spot in reversed(spots) for j in spot)
        yield node, parent, hashes[node], None if parent is None else hashes[parent], fields[node], path, pos, ordinals[node], inside[node], texts[node]


def occurrences(records: DataFrame, key: str, body: str) -> DataFrame:
    """Every object of every whole body, with its canonical text. Bodies that aren't whole JSON objects have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        size = 0
        for pdf in batches:
            for rec, text in zip(pdf["rec"].tolist(), pdf["body"].tolist()):
                value = whole_object(text if isinstance(text, str) else None)
                if value is None:
                    continue
                for x in occurrences_of(value):
                    rows.append((rec, *x))
                    size += len(x[9]) + (len(x[5]) if x[5] else 0)
                    if len(rows) >= BATCH_ROWS or size >= BATCH_CHARS:
                        yield _frame(rows)
                        rows, size = [], 0
        yield _frame(rows)

    return records.select(F.col(key).cast("long").alias("rec"), F.col(body).alias("body")).mapInPandas(run, _OCC)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_OCC.names)
    for c in ("field", "path"):
        out[c] = pd.Series([clean(p) if isinstance(p, str) else None for p in out[c]], dtype=object)
    out["parent_node"] = out["parent_node"].astype("Int32")
    return out


def objects(occ: DataFrame) -> DataFrame:
    """hash, canonical, n: every distinct object once; in canonical, {"#": hash} stands for a nested object."""
    return occ.groupBy("hash").agg(F.first("canonical").alias("canonical"), F.count(F.lit(1)).alias("n"))


def bridge(occ: DataFrame) -> DataFrame:
    """The parent-child rows: one for each occurrence, record roots included (parent_node null)."""
    return occ.drop("canonical")


def values_of(text: str) -> Iterator[tuple]:
    """(field, item_pos, type, value) of the scalars of a canonical object, those in its arrays included.

    type is string, number, boolean or null; value is the string itself, else its JSON spelling, null for null. An
    empty array is a row of type `empty`. Nested objects are rows of the bridge, not values.
    """
    for key, child in whole_object(text).items():
        todo = [(key, (), child)]
        while todo:
            name, at, v = todo.pop()
            if isinstance(v, list):
                todo += [(name + "[]", (*at, j), item) for j, item in reversed(list(enumerate(v)))]
                if not v:
                    yield name, ".".join(map(str, at)), "empty", None
            elif not isinstance(v, dict):
                kind = "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, Num) else "string"
                yield name, ".".join(map(str, at)), kind, None if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def values(stored: DataFrame) -> DataFrame:
    """hash, field, item_pos, type, value: a row for each scalar of each stored object (objects() gives those)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, size = [], 0
            for key, text in zip(pdf["hash"].tolist(), pdf["canonical"].tolist()):
                for field, pos, kind, value in values_of(text):
                    rows.append((key, clean(field), pos, kind, None if value is None else clean(value)))
                size += len(text)
                if size >= BATCH_CHARS:
                    yield pd.DataFrame(rows, columns=["hash", "field", "item_pos", "type", "value"])
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=["hash", "field", "item_pos", "type", "value"])

    return stored.select("hash", "canonical").mapInPandas(run, "hash binary, field string, item_pos string, type string, value string")


def flat(occ: DataFrame) -> DataFrame:
    """rec_id, array_path, item_pos, field, value_pos, type, value: the scalars of every object that stands in an array.

    The bridge and the values of the distinct objects, joined by hash. Objects that are more than one occurrence in HOT_PARTS, of
    which there can be no more than that, are joined by broadcast.
    """
    stored = materialize(objects(occ), "objects")
    total = stored.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") > max(total // HOT_PARTS, 1000)
    links = bridge(occ).where("in_array").select("rec_id", F.col("path").alias("array_path"), "item_pos", "hash")
    told = lambda some: values(some).withColumnRenamed("item_pos", "value_pos")
    hot = stored.where(is_hot)
    if hot.isEmpty():
        return links.join(told(stored), "hash").drop("hash")
    cold = links.join(F.broadcast(hot.select("hash")), "hash", "left_anti").join(told(stored.where(~is_hot)), "hash")
    return cold.unionByName(links.join(F.broadcast(told(hot)), "hash")).drop("hash")


def rebuild(texts: dict[str, str], top: str) -> object:
    """The JSON value of a hash, put together again from the stored objects (hash in hex to canonical text)."""
    out: dict = {}
    todo: list[tuple] = [({"#": top}, out, "")]
    while todo:
        value, into, key = todo.pop()
        if isinstance(value, dict):  # in a stored object every dict stands for one
            into[key] = {}
            todo += [(child, into[key], k) for k, child in reversed(whole_object(texts[value["#"]]).items())]
        elif isinstance(value, list):
            into[key] = [None] * len(value)
            todo += [(child, into[key], j) for j, child in enumerate(value)]
        else:
            into[key] = value
    return out[""]
