"""Typed values as VARIANT, and JSON for people to read."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def typed_value(scalar: Column) -> Column:
    """A scalar of front matter (kind, value) as VARIANT: a number, a truth value, null or text."""
    kind, value = scalar["kind"], scalar["value"]
    # a number as JSON spells it: no zeros before it
    number = F.regexp_replace(value, r"\A(-?)0+(?=\d)", "$1")
    text = F.regexp_replace(F.to_json(F.struct(value.alias("v"))), r'\A\{"v":|\}\z', "")
    return F.try_parse_json(F.when(kind == "null", "null").when(kind.isin("int", "float"), number).when(kind == "boolean", value).otherwise(text))


def json_object(entries: Column) -> Column:
    """An array of (key, json) as the text of one JSON object, in order; an empty array is {}."""
    quoted = lambda e: F.regexp_replace(F.to_json(F.struct(e["key"].alias("v"))), r'\A\{"v":|\}\z', "")
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e), F.lit(":"), e["json"])), ","), F.lit("}"))


@F.pandas_udf(T.StringType())
def pretty_json(texts: pd.Series) -> pd.Series:
    """JSON with two blanks a level, keys in their order, characters as they are; null for what is no JSON."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text), indent=2, ensure_ascii=False)
        except ValueError:
            return None

    return texts.map(one)
