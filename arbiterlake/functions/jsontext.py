"""JSON inside free text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def _first_object(texts: pd.Series) -> pd.Series:
    decoder = json.JSONDecoder()

    def find(text):
        at = text.find("{") if text else -1
        while at >= 0:
            try:
                value, _ = decoder.raw_decode(text, at)
                return json.dumps(value, ensure_ascii=False, sort_keys=True)
            except ValueError:
                at = text.find("{", at + 1)
        return None

    return texts.map(find)


def first_object(c: Column) -> Column:
    """The first balanced JSON object of a text, keys sorted; null if there is none or the text is a JSON array."""
    return F.when(F.ltrim(c).startswith("["), F.lit(None)).otherwise(_first_object(c))


def whole(c: Column) -> Column:
    """True if the text is exactly one JSON value, false for null.

    Spark's parsers stop after the first value and ignore what follows ("12 words" gives 12). So the text is
    parsed as the first of a list whose second element is the text's own hash, which it cannot hold itself.
    """
    mark = F.sha2(c, 256)
    pair = F.try_parse_json(F.concat(F.lit("["), c, F.lit(',"'), mark, F.lit('"]')))
    return F.coalesce(F.try_variant_get(pair, "$[1]", "string") == mark, F.lit(False))


def fenced_object(c: Column) -> Column:
    """What stands from the first brace to the last, if it parses."""
    inner = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)\{.*\}", 0)
    return F.when((inner != "") & whole(inner), inner)


#: A JSON string literal; a colon after it makes it a key. Possessive throughout, so no text is too long for it.
_LITERAL = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*+:?'


def parses(c: Column) -> Column:
    """True if the text is JSON other than null (objects that repeat a key are not)."""
    maybe = F.coalesce(c, F.lit("")).rlike(r'^\s*+(?:[\[{"0-9-]|true|false)')
    return F.when(maybe, whole(c)).otherwise(False)


def string_values(c: Column) -> Column:
    """All string values of a JSON text, at whatever depth, in the order of the text; null if it does not parse.

    Values stand in the text as they are ordered in it, so their literals are enough: no schema, no walk, no
    worker. The literals that no colon follows are decoded together as one JSON list.
    """
    values = F.filter(F.regexp_extract_all(c, F.lit(_LITERAL), F.lit(0)), lambda m: ~F.endswith(m, F.lit(":")))
    return F.when(parses(c), F.from_json(F.concat(F.lit("["), F.array_join(values, ","), F.lit("]")), "array<string>"))


def canonical(c: Column) -> Column:
    """The JSON text with keys sorted at every depth and no blanks between; a text that does not parse as it is.

    Object fields of a VARIANT are held in the order of their names, so writing it sorts them. Numbers come in
    their shortest form (1.50 as 1.5).
    """
    return F.coalesce(F.when(whole(c), F.to_json(F.try_parse_json(c))), c)


def list_or_scalar(c: Column) -> Column:
    """Elements of a JSON list, or the text itself as the one element; empty for no text."""
    none = F.array().cast("array<string>")
    text = F.trim(F.coalesce(c, F.lit("")))
    return F.when(text == "", none).otherwise(F.coalesce(F.when(text.startswith("["), F.from_json(text, "array<string>")), F.array(text)))


def sorted_json(*columns: str) -> Column:
    """The columns as a JSON object with sorted keys."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(columns))))
