"""Tolerant JSON functions for model output."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

FENCE = r"(?s)```(?:json)?\s*(.*?)```"


def unfenced(c: Column) -> Column:
    inner = F.regexp_extract(c, FENCE, 1)
    return F.regexp_replace(F.when(F.length(inner) > 0, inner).otherwise(c), r"^\s+|\s+$", "")


def braced(c: Column) -> Column:
    """From the first `{` to the last `}`; null without both."""
    return F.nullif(F.regexp_extract(unfenced(c), r"(?s)\{.*\}", 0), F.lit(""))


def repaired(c: Column) -> Column:
    """Backslashes that start no JSON escape are doubled."""
    return F.regexp_replace(c, r'\\(?![\\"/bfnrtu])', r"\\\\")


def parses(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


def lenient(c: Column) -> Column:
    """The first of raw text, fenced text and braces that parses, as it is or with its backslashes repaired; else null."""
    tries = [c, unfenced(c), braced(c)]
    tries += [repaired(x) for x in tries]
    return F.coalesce(*[F.when(parses(x), x) for x in tries])


def scores(c: Column, keys: tuple[str, ...]) -> Column:
    """map<string, double> of the keys; null unless each is there and a number. No range is checked."""
    parsed = F.from_json(lenient(c), "map<string,string>")
    got = F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[parsed[k].try_cast("double") for k in keys]))
    return F.when(F.forall(F.map_values(got), lambda x: x.isNotNull()), got)


def relevance(c: Column) -> Column:
    """False for NOT_RELEVANT; true for RELEVANT and for whatever cannot be read."""
    x = F.upper(F.trim(c))
    return F.when(x.startswith("NOT_RELEVANT"), False).otherwise(True)


def passage_ids(c: Column) -> Column:
    """A JSON object whose key that names a passage is called passage_id."""
    m = F.from_json(c, "map<string,string>")
    return F.transform_keys(m, lambda k, v: F.when(F.lower(k).contains("passage"), "passage_id").otherwise(k))


def outermost(text: str | None) -> str | None:
    """The first balanced object or array that parses, heeding strings and escapes."""
    if text is None:
        return None
    decoder = json.JSONDecoder()
    for i, ch in enumerate(text):
        if ch in "{[":
            try:
                value, _ = decoder.raw_decode(text, i)
            except ValueError:
                continue
            return json.dumps(value, ensure_ascii=False)
    return None


@F.pandas_udf(StringType())
def extract(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(outermost)


@F.pandas_udf(StringType())
def canonical(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The whole text, or its fence, as indented JSON; null if neither parses."""

    def one(text: str | None) -> str | None:
        for t in (text or "", (text or "").strip().removeprefix("```json").removeprefix("```").removesuffix("```")):
            try:
                return json.dumps(json.loads(t), indent=2, ensure_ascii=False)
            except ValueError:
                pass
        return None

    for s in parts:
        yield s.map(one)
