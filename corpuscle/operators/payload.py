"""Loose payloads: field readers with defaults, column-major tables, JSON cells."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import PandasUDFType


def number(value: Column) -> Column:
    """A number, 0 of what is none."""
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def non_negative(value: Column) -> Column:
    return F.greatest(number(value), F.lit(0.0))


def text(value: Column) -> Column:
    return F.coalesce(value.try_cast("string"), F.lit(""))


def record(value: Any) -> dict:
    return value if isinstance(value, dict) else {}


def records(value: Any) -> list[dict]:
    """Rows of a payload: {cols, rows}, {cols, groups} with shared fields, or {columns, rows}."""
    payload = record(value)
    if "groups" in payload:
        columns, out = [str(c) for c in payload.get("cols") or []], []
        for group in payload["groups"]:
            shared = {k: v for k, v in group.items() if k not in ("rows", "qn_prefix")}
            for row in group.get("rows") or []:
                fields = dict(zip(columns, row, strict=False))
                if group.get("qn_prefix") and fields.get("qn"):
                    fields["qn"] = group["qn_prefix"] + str(fields["qn"])
                out.append(shared | fields)
        return out
    columns = payload.get("cols") or payload.get("columns") or []
    return [dict(zip(map(str, columns), row, strict=False)) for row in payload.get("rows") or []]


def required(rows: list[dict], columns: list[str], header: list[str]) -> list[dict] | None:
    """``rows``, or None where the header lacks a column: a mismatch isn't an empty answer."""
    return rows if set(columns) <= set(header) else None


def cell(value: Any) -> str:
    """A cell as text; text that is JSON opens, lists join by a bar."""
    if isinstance(value, str):
        try:
            inner = json.loads(value)
        except ValueError:
            return value
        return value if isinstance(inner, (int, float)) and not isinstance(inner, bool) else cell(inner)
    if isinstance(value, list):
        return " | ".join(cell(v) for v in value)
    if isinstance(value, dict):
        return json.dumps(value, sort_keys=True, ensure_ascii=False)
    return "" if value is None else json.dumps(value)


def count_items(value: Any) -> int:
    """Items of all arrays of a JSON value; an item that is a row counts once."""
    if isinstance(value, list):
        return sum(count_items(v) if isinstance(v, list) else 1 for v in value)
    if isinstance(value, dict):
        return sum(count_items(v) for v in value.values())
    return 0


def item_count(value: Column) -> Column:
    """``count_items`` of JSON texts, over batches; 0 of what is no JSON."""

    def counts(texts: pd.Series) -> pd.Series:
        def one(x: str | None) -> int:
            try:
                return count_items(json.loads(x or "null"))
            except ValueError:
                return 0

        return texts.map(one).astype("int32")

    return F.pandas_udf(counts, "int", PandasUDFType.SCALAR)(value)
