"""Strict JSON reading, writing and walking, used inside Python workers. Numbers keep their spelling; depth has no limit."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from json.encoder import encode_basestring_ascii


class Num(str):
    """A JSON number as it was written."""

    __slots__ = ()


def _refuse(name: str):
    raise ValueError(f"{name} is not JSON")


_DECODER = json.JSONDecoder(parse_constant=_refuse, parse_int=Num, parse_float=Num)
_BLANK = re.compile(r"[ \t\r\n]*")
_SCALAR = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null", re.ASCII)
_WORDS = {"true": True, "false": False, "null": None}
_STRING = json.decoder.scanstring


def _deep(text: str) -> object:
    """The value of a JSON text, read without recursion; ValueError if it is none."""
    at, out = _BLANK.match(text, 0).end(), None
    stack: list = []  # open containers; beside an object the key that waits for its value
    while True:
        c = text[at : at + 1]
        value = None
        if c == "{" or c == "[":
            value = {} if c == "{" else []
            at = _BLANK.match(text, at + 1).end()
            if text[at : at + 1] == ("}" if c == "{" else "]"):
                at += 1
            else:
                stack.append([value, None])
                if c == "{":
                    at = _key(text, at, stack)
                continue
        elif c == '"':
            value, at = _STRING(text, at + 1, True)
        elif m := _SCALAR.match(text, at):
            at = m.end()
            value = _WORDS[m[0]] if m[0] in _WORDS else Num(m[0])
        else:
            raise ValueError("no value")
        while True:  # value is whole: put it into what is open, and close what ends here
            at = _BLANK.match(text, at).end()
            if not stack:
                out = value
                if at != len(text):
                    raise ValueError("more text")
                return out
            into, key = stack[-1]
            if isinstance(into, dict):
                into[key] = value
            else:
                into.append(value)
            c = text[at : at + 1]
            if c == ",":
                at = _BLANK.match(text, at + 1).end()
                if isinstance(into, dict):
                    at = _key(text, at, stack)
                break
            if c != ("}" if isinstance(into, dict) else "]"):
                raise ValueError("not closed")
            value, at = stack.pop()[0], at + 1


def _key(text: str, at: int, stack: list) -> int:
    if text[at : at + 1] != '"':
        raise ValueError("no key")
    stack[-1][1], at = _STRING(text, at + 1, True)
    at = _BLANK.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError("no colon")
    return _BLANK.match(text, at + 1).end()


def whole_object(body: str | None) -> dict | None:
    """The object if body is one whole JSON object, else None (null, blank, cut short, array, scalar).

    Of a key that occurs twice in one object the last value counts. Numbers are Num, of any length.
    """
    if not body:
        return None
    text = body.strip(" \t\r\n")
    if not text.startswith("{"):
        return None
    try:
        value, end = _DECODER.raw_decode(text)
    except RecursionError:
        try:
            value, end = _deep(text), len(text)
        except ValueError:
            return None
    except ValueError:
        return None
    return value if end == len(text) else None


def clean(text: str) -> str:
    """text with lone surrogates, which no UTF-8 column can hold, replaced."""
    return text.encode("utf-8", "surrogatepass").decode("utf-8", "replace") if not text.isascii() else text


class _Mark(str):
    __slots__ = ()


_OPEN, _CLOSE, _BEGIN, _END, _COMMA = (_Mark(x) for x in "{}[],")


def _shallow(v, sort: bool) -> str:
    t = type(v)
    if t is str:
        return encode_basestring_ascii(v)
    if t is Num:
        return v
    if t is dict:
        items = sorted(v.items()) if sort else v.items()
        return "{" + ",".join([encode_basestring_ascii(k) + ":" + _shallow(x, sort) for k, x in items]) + "}"
    if t is list:
        return "[" + ",".join([_shallow(x, sort) for x in v]) + "]"
    return "null" if v is None else "true" if v is True else "false" if v is False else json.dumps(v)


def dumps(value, sort: bool = False) -> str:
    """JSON text in ASCII without blanks, of any depth, numbers as they were written; keys in order if sort."""
    try:
        return _shallow(value, sort)
    except RecursionError:
        return _any_depth(value, sort)


def _any_depth(value, sort: bool) -> str:
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        if isinstance(v, (_Mark, Num)):
            out.append(v)
        elif isinstance(v, str):
            out.append(encode_basestring_ascii(v))
        elif v is None or isinstance(v, bool):
            out.append("null" if v is None else "true" if v else "false")
        elif isinstance(v, dict):
            todo.append(_CLOSE)
            items = sorted(v.items(), reverse=True) if sort else reversed(v.items())
            for i, (k, child) in enumerate(items):
                if i:
                    todo.append(_COMMA)
                todo.append(child)
                todo.append(_Mark(encode_basestring_ascii(k) + ":"))
            out.append("{")
        elif isinstance(v, (list, tuple)):
            todo.append(_END)
            for i, child in enumerate(reversed(v)):
                if i:
                    todo.append(_COMMA)
                todo.append(child)
            out.append("[")
        else:
            out.append(json.dumps(v))
    return "".join(out)


def canonical(value) -> str:
    """One spelling of equal JSON values: sorted keys, no blanks. Numbers are equal if they are spelled alike."""
    return dumps(value, sort=True)


KINDS = ("string", "number", "boolean", "object", "array")


def kind(value) -> int:
    """A bit of KINDS; 0 for null."""
    if value is None:
        return 0
    if isinstance(value, bool):
        return 4
    if isinstance(value, str):
        return 2 if isinstance(value, Num) else 1
    if isinstance(value, dict):
        return 8
    return 16 if isinstance(value, list) else 2


#: A dotted path longer than this is spelled as its beginning and a hash of all of it, so that a body nested n deep
#: doesn't have n * n characters of paths.
LONG_PATH, SHORT_PATH = 2048, 512


def field_paths(value: dict) -> Iterator[tuple[str, object]]:
    """(dotted path, value) of every key, objects included, arrays not entered."""
    stack = [("", value)]
    while stack:
        prefix, node = stack.pop()
        for key, child in node.items():
            path = prefix + key
            if len(path) > LONG_PATH:
                path = f"{path[:SHORT_PATH]}#{hashlib.blake2b(path.encode('utf-8', 'surrogatepass'), digest_size=16).hexdigest()}"
            yield path, child
            if isinstance(child, dict):
                stack.append((path + ".", child))


def digest(text: str) -> bytes:
    """16 bytes that identify a canonical text."""
    return hashlib.blake2b(text.encode("ascii"), digest_size=16).digest()
