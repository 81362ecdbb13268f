"""Model output that should be JSON: fences, text around it, truncation."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r"^```(?:json)?\s*|\s*```$", re.IGNORECASE)
_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)
_CLOSER = {"[": "]", "{": "}"}


def balanced(text: str) -> str:
    """Truncated JSON with its open string and brackets closed and a trailing comma dropped."""
    rest = _STRING.sub("", text)
    if '"' in rest:  # what follows the unmatched quote is inside the open string
        rest, text = rest[: rest.index('"')], text + '"'
    open_ = []
    for bracket in re.findall(r"[][{}]", rest):
        if bracket in _CLOSER:
            open_.append(bracket)
        elif open_ and _CLOSER[open_[-1]] == bracket:
            open_.pop()
    return text.rstrip().rstrip(", \t\r\n") + "".join(_CLOSER[b] for b in reversed(open_))


def parsed(raw: str | None, opener: str) -> tuple[object, bool]:
    """(value, whether it was repaired) of the first ``opener`` on; (None, False) if nothing parses."""
    text = _FENCE.sub("", (raw or "").strip()).strip()
    begin = text.find(opener)
    if begin < 0:
        return None, False
    text = text[begin:]
    end = text.rfind(_CLOSER[opener])
    for attempt, repaired in ((text[: end + 1] if end >= 0 else text, False), (balanced(text), True)):
        try:
            return json.loads(attempt), repaired
        except ValueError:
            continue
    return None, False


def _table(raw: str | None) -> dict | None:
    value, repaired = parsed(raw, "{")
    if not isinstance(value, dict) or not isinstance(value.get("headers"), list) or not isinstance(value.get("rows"), list):
        return None
    headers = [str(h) for h in value["headers"]]
    rows = [[str(c) if c is not None else "" for c in [*r, *[""] * len(headers)][: len(headers)]] for r in value["rows"] if isinstance(r, list)]
    if not headers or not rows:
        return None
    title = value.get("title")
    return {"title": title if isinstance(title, str) else None, "headers": headers, "rows": rows, "repaired": repaired}


_TABLE = "struct<title:string,headers:array<string>,rows:array<array<string>>,repaired:boolean>"


def repaired_json(raw: Column) -> Column:
    """The text made parseable as far as closing what is open does."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else balanced(t))

    return run(raw)


def model_table(raw: Column) -> Column:
    """struct(title, headers, rows, repaired); null without headers and rows; rows padded or cut to the headers."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(_table(t)))

    return F.from_json(run(raw), _TABLE)


def suggestions(raw: Column, limit: int = 3) -> Column:
    """Non-empty strings of an array, ``limit`` at most; the last one of a repaired array is dropped."""

    def one(text: str | None) -> list[str]:
        value, repaired = parsed(text, "[")
        out = [s.strip() for s in value if isinstance(s, str) and s.strip()] if isinstance(value, list) else []
        return (out[:-1] if repaired else out)[:limit]

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(raw)


def last_event(stream: Column) -> Column:
    """The last ``data:`` line of an event stream that is a message with a result or an error."""
    lines = F.transform(F.filter(F.split(stream, r"\r?\n"), lambda x: F.startswith(x, F.lit("data: "))), lambda x: F.trim(F.substring(x, 7, 1 << 30)))
    good = F.filter(lines, lambda x: F.get_json_object(x, "$.result").isNotNull() | F.get_json_object(x, "$.error").isNotNull())
    return F.try_element_at(good, F.lit(-1))
