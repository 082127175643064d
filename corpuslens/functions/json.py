"""JSON text and variants: cut-off objects, containment, a digest that key order and spacing do not change."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpuslens.functions import text as T

#: Fixed value: a Markdown fence around an answer.
FENCE = r"(?i)^```(?:json)?\s*|\s*```$"
NUMERIC = ("TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression of a value that is worked out once a row, however often the expression names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# ---------------------------------------------------------------------------------------------------
# objects in answers


def _masked(text: Column) -> Column:
    """The text with escaped characters masked (same length)."""
    return F.when(text.contains("\\"), F.regexp_replace(text, r"(?s)\\.", "__")).otherwise(text)


def _pieces(masked: Column) -> Column:
    """Strings, brackets and what lies between."""
    return F.regexp_extract_all(masked, F.lit(r'"[^"]*"?|[{}\[\]]|[^"{}\[\]]+'), F.lit(0))


def _scan(pieces: Column) -> Column:
    """One pass over the pieces: still open brackets (the innermost closer first), where the first value ends, an open
    string, a closer that does not fit."""
    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("at"), F.lit(0).alias("end"), F.lit(False).alias("cut"), F.lit(False).alias("bad"))

    def step(s: Column, p: Column) -> Column:
        opener, closer = p.isin("{", "["), p.isin("}", "]") & (s["open"] != "")
        fits = F.left(s["open"], F.lit(1)) == p
        rest = F.substring(s["open"], 2, 1_000_000)
        opened = F.when(opener, F.concat(F.when(p == "{", "}").otherwise("]"), s["open"])).when(closer & fits, rest).otherwise(s["open"])
        after = s["at"] + F.length(p)
        moved = F.struct(
            opened.alias("open"), after.alias("at"), F.when(closer & fits & (rest == ""), after).otherwise(0).alias("end"),
            (p.startswith('"') & ((F.length(p) == 1) | ~p.endswith('"'))).alias("cut"), (closer & ~fits).alias("bad"),
        )
        return F.when((s["end"] > 0) | s["bad"], s).otherwise(moved)

    return F.aggregate(pieces, start, step)


def _value(text: Column, may_be_cut: bool) -> Column:
    """The first bracketed value of a text that begins with one, as a variant; null when it is none.

    What follows a finished value is ignored. Brackets that are missing at the end are added; a string is never closed.
    """

    def whole(s: Column) -> Column:
        cut = F.concat(text, s["open"]) if may_be_cut else F.lit(None).cast("string")
        return F.when(s["bad"], F.lit(None).cast("string")).when(s["end"] > 0, F.substring(text, F.lit(1), s["end"])).when(~s["cut"] & (s["open"] != ""), cut)

    return F.try_parse_json(let(_scan(_pieces(_masked(text))), whole))


def object_of(raw: Column) -> Column:
    """The JSON object of an answer as a variant: fenced, with words around it, or cut off before its closing brackets.

    Null when the answer begins with another whole JSON value, when a string or a value is cut, or when brackets do not
    fit. Text after a whole object is ignored.
    """

    def of_body(body: Column) -> Column:
        # Both patterns ask for the beginning alone; a string may be as long as the text.
        plain = F.when(body.startswith('"'), _masked(body).rlike(r'^"[^"]*"')).otherwise(F.left(body, F.lit(5)).rlike(r"^(-?\d|true|false|null)"))
        other = plain | (body.startswith("[") & _value(body, False).isNotNull())
        start = F.instr(body, "{")
        found = let(F.substring(body, start, F.length(body)), lambda candidate: _value(candidate, True))
        return F.when(~other & (start > 0), let(found, lambda v: F.when(F.coalesce(F.schema_of_variant(v), F.lit("")).startswith("OBJECT"), v)))

    stripped = T.strip(T.text_or_empty(raw))
    return let(let(stripped, lambda t: F.when(t.contains("```"), T.strip(F.regexp_replace(t, FENCE, ""))).otherwise(t)), of_body)


# ---------------------------------------------------------------------------------------------------
# digest


@F.pandas_udf(StringType())
def canonical_json(values: pd.Series) -> pd.Series:
    """JSON text with sorted keys at every depth and no spaces; null for what is no JSON. Depth has no bound, so
    built-in expressions cannot say this."""

    def canonical(value: str | None) -> str | None:
        try:
            return None if value is None else json.dumps(json.loads(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except (ValueError, RecursionError):
            return None

    return values.map(canonical)


def json_digest(value: Column) -> Column:
    """SHA-256 of the canonical form of JSON text."""
    return F.sha2(canonical_json(value), 256)


# ---------------------------------------------------------------------------------------------------
# containment


def kind_of(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("MISSING"))


def _is_number(kind: Column) -> Column:
    return kind.isin(*NUMERIC) | kind.startswith("DECIMAL")


def member(v: Column, key: str) -> Column:
    if "'" in key or "\\" in key:  # a path cannot say these
        return F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(key))
    return F.try_variant_get(v, f"$['{key}']", "variant")


def contains(v: Column, pattern: Any) -> Column:
    """Whether a variant contains a constant pattern.

    An object contains one whose every member it contains under the same key; an array contains one each of whose
    elements one of its own contains, whatever the order and number; scalars are contained when equal, numbers by
    value. At the top an array contains a scalar that is one of its elements.
    """
    if isinstance(pattern, (dict, list)):
        return _contains(v, pattern)
    listed = kind_of(v).startswith("ARRAY") & _some(v, pattern)
    return F.coalesce(_contains(v, pattern) | listed, F.lit(False))


def _elements(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))


def _some(v: Column, pattern: Any) -> Column:
    return F.exists(_elements(v), lambda e: _contains(e, pattern))


def _contains(v: Column, pattern: Any) -> Column:
    kind = kind_of(v)
    if isinstance(pattern, dict):
        all_in = kind.startswith("OBJECT")
        for key, value in pattern.items():
            all_in = all_in & _contains(member(v, key), value)
    elif isinstance(pattern, list):
        all_in = kind.startswith("ARRAY")
        for value in pattern:
            all_in = all_in & _some(v, value)
    elif pattern is None:
        all_in = kind == "VOID"
    elif isinstance(pattern, bool):
        all_in = (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(pattern))
    elif isinstance(pattern, str):
        all_in = (kind == "STRING") & (F.try_variant_get(v, "$", "string") == F.lit(pattern))
    else:
        all_in = _is_number(kind) & (F.try_variant_get(v, "$", "double") == F.lit(float(pattern)))
    return F.coalesce(all_in, F.lit(False))


def scalar_text(v: Column) -> Column:
    """A scalar with its kind, so that equal scalars and no others have equal texts; null for objects and arrays."""
    kind = kind_of(v)
    text = F.try_variant_get(v, "$", "string")
    return (
        F.when(kind == "VOID", "null").when(kind == "STRING", F.concat(F.lit("s"), text)).when(kind == "BOOLEAN", F.concat(F.lit("b"), text))
        .when(_is_number(kind), F.concat(F.lit("n"), F.try_variant_get(v, "$", "double").cast("string")))
    )


def leaves_of(pattern: Any, path: str = "$") -> list[tuple[str, Any]]:
    """Path and scalar of each leaf of a pattern; array places are not part of a path."""
    if isinstance(pattern, dict):
        return [leaf for key, value in pattern.items() for leaf in leaves_of(value, f"{path}.{key}")]
    if isinstance(pattern, list):
        return [leaf for value in pattern for leaf in leaves_of(value, f"{path}[]")]
    return [(path, pattern)]
