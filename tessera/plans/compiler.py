"""Syntax tree to a Catalyst predicate over frames."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import tokens
from tessera.plans.parser import Node


def predicate(node: Node, match: str = "token") -> Column:
    """A boolean column over frames (search_text, uri, track, labels, ts and, if used, tags).

    ``match`` "token" compares whole tokens, "substring" any part of the lower-case text. Null text matches no word.
    """
    low = F.lower(F.coalesce("search_text", F.lit("")))
    if node.kind == "and":
        return reduce(lambda a, b: a & b, [predicate(p, match) for p in node.parts])
    if node.kind == "or":
        return reduce(lambda a, b: a | b, [predicate(p, match) for p in node.parts])
    if node.kind == "not":
        return ~predicate(node.parts[0], match)
    if node.kind == "all":
        return F.lit(True)
    if node.kind == "word":
        if match == "substring":
            return low.contains(node.value)
        return F.array_contains(tokens(F.col("search_text")), node.value)
    if node.kind == "phrase":
        return low.contains(node.value)
    if node.kind == "wildcard":
        pattern = "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in node.value) + "$"
        return F.exists(tokens(F.col("search_text")), lambda t: t.rlike(pattern))
    if node.kind == "uri":
        return F.coalesce(F.lower("uri") == node.value, F.lit(False))
    if node.kind == "scope":
        return F.coalesce(F.col("uri").startswith(node.value), F.lit(False))
    if node.kind == "track":
        return F.coalesce(F.lower("track") == node.value, F.lit(False))
    if node.kind in ("tag", "label"):
        return F.coalesce(F.exists("labels", lambda x: F.lower(x) == node.value), F.lit(False))
    if node.kind == "date":
        test = F.lit(True)
        if node.low is not None:
            test = test & (F.col("ts") >= node.low)
        if node.high is not None:
            test = test & (F.col("ts") <= node.high)
        return F.coalesce(test, F.lit(False))
    raise ValueError(f"unknown kind {node.kind}")


def uri_filter(value: str) -> Column:
    """A request's uri: with a fragment it must be equal, else a prefix; case-insensitive."""
    low = F.lower("uri")
    return low == value.lower() if "#" in value else low.startswith(value.lower())


def time_travel(as_of_frame: int | None = None, as_of_ts: int | None = None) -> Column:
    """Frames as of an id or a time, inclusive."""
    test = F.lit(True)
    if as_of_frame is not None:
        test = test & (F.col("frame_id") <= as_of_frame)
    if as_of_ts is not None:
        test = test & (F.col("ts") <= as_of_ts)
    return test
