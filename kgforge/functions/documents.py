"""Properties and responses as JSON."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def dump_properties(properties: Column) -> Column:
    """A map as JSON with sorted keys and no spaces."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(properties))))


def load_properties(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


#: Deeper responses are no answer.
DEEPEST = 500


def too_deep(text: str, at: int) -> bool:
    """Whether more than DEEPEST brackets open one after the other from here, which a decoder would follow one by one."""
    return len(text) - at > DEEPEST and not text[at : at + DEEPEST + 1].strip("[")


def first_json(text: str) -> str | None:
    """The text if it is JSON, else the first object or array that can be read from some brace or bracket on."""
    decoder = json.JSONDecoder()
    try:
        json.loads(text)
        return text
    except (ValueError, RecursionError):
        pass
    last = {"{": text.rfind("}"), "[": text.rfind("]")}
    for m in re.finditer(r"[{\[]", text):
        at = m.start()
        if at < last[m[0]] and not too_deep(text, at):  # else it has no end, or none that can be read
            try:
                return text[at : decoder.raw_decode(text, at)[1]]
            except (ValueError, RecursionError):
                pass
    return None


@pandas_udf(StringType())
def _first_json(text: pd.Series) -> pd.Series:
    return text.map(first_json, na_action="ignore")


def decode_response(text: Column) -> Column:
    """A variant: strict JSON where that works; only the rest is searched in Python."""
    strict = F.try_parse_json(text)
    return F.coalesce(strict, F.try_parse_json(_first_json(F.when(strict.isNull(), text))))


def unwrap_singleton(value: Column) -> Column:
    """Of a list of one its element, of a variant."""
    is_list = F.startswith(F.schema_of_variant(value), F.lit("ARRAY"))
    one = is_list & F.try_variant_get(value, "$[0]", "variant").isNotNull() & F.try_variant_get(value, "$[1]", "variant").isNull()
    return F.when(one, F.try_variant_get(value, "$[0]", "variant")).otherwise(value)


def items_of(response: Column, key: str) -> Column:
    """The objects of a response, which is a list or an object with the list under the key; null if it is neither."""
    kind = F.schema_of_variant(response)
    inner = F.try_variant_get(response, f"$.{key}", "array<variant>")
    listed = F.when(F.startswith(kind, F.lit("ARRAY")), F.try_variant_get(response, "$", "array<variant>")).otherwise(inner)
    return F.filter(listed, lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT")))
