"""Strict JSON text: parsing without silent repairs, canonical writing, and the text keys built on Unicode rules."""

from __future__ import annotations

import json
import math
import unicodedata
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Message texts.
DUPLICATE_KEY = "duplicate JSON object key: {}"
NON_FINITE = "non-finite JSON number: {}"


class StrictJsonError(ValueError):
    """Text that is JSON only to a lenient reader. ``syntax`` tells a malformed text from a forbidden value."""

    def __init__(self, message: str, syntax: bool = False):
        super().__init__(message)
        self.syntax = syntax


def _unique(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    found = dict(pairs)
    if len(found) < len(pairs):
        names = [name for name, _ in pairs]
        raise StrictJsonError(DUPLICATE_KEY.format(next(n for i, n in enumerate(names) if n in names[:i])))
    return found


def _constant(name: str) -> Any:
    raise StrictJsonError(NON_FINITE.format(name))


def strict_loads(text: str) -> Any:
    """Parse JSON; duplicate keys, NaN and infinities, and text after the value are errors."""
    try:
        return json.loads(text, parse_constant=_constant, object_pairs_hook=_unique)
    except json.JSONDecodeError as error:
        raise StrictJsonError(error.msg, syntax=True) from error
    except RecursionError as error:
        raise StrictJsonError("too deeply nested", syntax=True) from error


def canonical(value: Any, spaced: bool = False, ascii_only: bool = False) -> str:
    """One text for equal values: sorted keys, no blanks unless ``spaced``, raw Unicode unless ``ascii_only``."""
    separators = None if spaced else (",", ":")
    return json.dumps(value, sort_keys=True, separators=separators, ensure_ascii=ascii_only, allow_nan=False)


def check_values(value: Any, field: str) -> None:
    """ValueError for anything that JSON text can't hold as it is: keys that are no text, containers other than lists and
    mappings, numbers that aren't finite."""
    left = [value]
    while left:
        each = left.pop()
        if isinstance(each, dict):
            if not all(isinstance(key, str) for key in each):
                raise ValueError(f"{field} contains a non-string object key")
            left += each.values()
        elif isinstance(each, list):
            left += each
        elif isinstance(each, (tuple, set, frozenset)):
            raise ValueError(f"{field} contains an unsupported {type(each).__name__}")
        elif each is not None and not isinstance(each, (bool, str, int, float)):
            raise ValueError(f"{field} contains unsupported JSON value type: {type(each).__name__}")
        elif isinstance(each, float) and not math.isfinite(each):
            raise ValueError(f"{field} contains non-finite number")


def has_non_finite(value: Any) -> bool:
    if isinstance(value, dict):
        return any(map(has_non_finite, value.values()))
    if isinstance(value, list):
        return any(map(has_non_finite, value))
    return isinstance(value, float) and not math.isfinite(value)


def clean(text: str) -> str:
    return unicodedata.normalize("NFC", text).strip()


@F.pandas_udf(T.StringType())
def nfc_strip(text: pd.Series) -> pd.Series:
    """NFC, then Unicode blanks trimmed; null stays null."""
    return text.map(clean, na_action="ignore")


@F.pandas_udf(T.StringType())
def nfc_casefold(text: pd.Series) -> pd.Series:
    """The key under which queries count as duplicates."""
    return text.map(lambda t: clean(t).casefold(), na_action="ignore")


def canonical_json(spaced: bool = False, ascii_only: bool = False):
    """A column function: canonical text of JSON text, null where the text isn't strict JSON."""

    @F.pandas_udf(T.StringType())
    def write(text: pd.Series) -> pd.Series:
        def one(t: str) -> str | None:
            try:
                return canonical(strict_loads(t), spaced, ascii_only)
            except ValueError:
                return None

        return text.map(one, na_action="ignore")

    return write


@F.pandas_udf(T.StructType([T.StructField("value", T.StringType()), T.StructField("error", T.StringType())]))
def strict_parse(text: pd.Series) -> pd.DataFrame:
    """Canonical text of strict JSON, or why it is none."""

    def one(t: str | None) -> tuple[str | None, str | None]:
        if t is None:
            return None, None
        try:
            return canonical(strict_loads(t)), None
        except ValueError as error:
            return None, str(error)

    return pd.DataFrame([one(t) for t in text], columns=["value", "error"])
