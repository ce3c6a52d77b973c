"""What pages hold in their scripts: JSON objects after a marker, and JSON-LD. Small helpers over Arrow batches; the rest is columns."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

#: Strings in either quotes, with escapes, as one; braces; and a quote that nothing closes.
_TOKENS = re.compile(r""""[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|[{}"']""", re.S)


def balanced_object(text: str, marker: str) -> str | None:
    """The object that begins at the first brace after a marker, up to the brace that closes it; braces in strings are none. One pass."""
    at = text.find(marker)
    start = text.find("{", at + len(marker)) if at >= 0 else -1
    depth = 0
    for token in _TOKENS.finditer(text, start) if start >= 0 else ():
        sign = token[0]
        if sign == "{":
            depth += 1
        elif sign == "}":
            depth -= 1
            if not depth:
                return text[start : token.end()]
        elif len(sign) == 1:
            return None
    return None


def embedded_json(html: Column, marker: str) -> Column:
    """The object after a marker in a page's script as VARIANT; null if there is none or it does not parse."""

    @F.pandas_udf(StringType())
    def found(values: pd.Series) -> pd.Series:
        return values.map(lambda x: balanced_object(x, marker), na_action="ignore")

    return F.try_parse_json(found(html))


#: Keys of JSON-LD that tell a date, in this order, and types whose name is an author.
DATE_KEYS = ["datePublished", "dateCreated", "uploadDate", "dateModified"]
_AUTHOR_TYPES = re.compile("person|organization", re.I)


def _types(record: dict) -> list[str]:
    said = record.get("@type")
    return [x for x in (said if isinstance(said, list) else [said]) if isinstance(x, str)]


def _author_values(value, named: bool) -> Iterator[str]:
    """Names that a value may tell; named: it is the value of author or creator."""
    if isinstance(value, str):
        if named:
            yield value
    elif isinstance(value, list):
        for x in value:
            yield from _author_values(x, named)
    elif isinstance(value, dict):
        for key in ("author", "creator"):
            yield from _author_values(value.get(key), True)
        if isinstance(value.get("name"), str) and (named or any(map(_AUTHOR_TYPES.search, _types(value)))):
            yield value["name"]


def records(value) -> Iterator[dict]:
    """The objects of a parsed text, each before those that it holds, in the order of the text."""
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            yield x
        if isinstance(x, dict | list):
            stack += list(x.values() if isinstance(x, dict) else x)[::-1]


def read_json_ld(blocks: list[str]) -> tuple[list[str], list[str], list[str]]:
    """Author names, dates and types of JSON-LD texts, in the order in which they are tried; texts that do not parse tell none."""
    authors, dates, types = {}, {}, {}
    for block in blocks:
        try:
            for record in records(json.loads(block)):
                authors.update(dict.fromkeys(_author_values(record, False)))
                dates.update(dict.fromkeys(x for k in DATE_KEYS if isinstance(x := record.get(k), str)))
                types.update(dict.fromkeys(x.lower() for x in _types(record)))
        except (ValueError, RecursionError):
            continue
    return list(authors), list(dates), list(types)


@F.pandas_udf(StructType().add("authors", ArrayType(StringType())).add("dates", ArrayType(StringType())).add("types", ArrayType(StringType())))
def json_ld(blocks: pd.Series) -> pd.DataFrame:
    """authors, dates and types of each page's JSON-LD texts (an array), at any depth."""
    return pd.DataFrame([read_json_ld([x for x in b if x] if b is not None else []) for b in blocks], columns=["authors", "dates", "types"])
