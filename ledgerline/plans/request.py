"""The JSON request API: actions index, query and count."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from .engine import Engine


def _text(request: dict, key: str) -> str:
    value = request.get(key) or ""
    if not isinstance(value, str):
        raise ValueError(f"{key} must be text")
    return value


def _int(request: dict, key: str) -> int:
    value = request.get(key) or 0
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValueError(f"{key} must be a number")
    return int(value)


def execute_request(spark: SparkSession, request: dict | str) -> dict:
    """Runs one request; {"status": "ok", ...} or {"status": "error", "error": ...}.

    index: csv, cols (JSON text or list; a nested list is composite), indexDir or out, sep.
    query: csv, indexDir, where, groupBy, aggCol, aggFunc, limit, offset, countOnly, explain; "data" is a DataFrame of groups or locators.
    count: the same, giving "count".
    """
    try:
        request = json.loads(request) if isinstance(request, str) else dict(request)
        action, path = _text(request, "action") or "query", _text(request, "csv")
        if not path:
            raise ValueError("csv is required")
        engine = Engine(spark, _text(request, "indexDir") or _text(request, "out") or None, _text(request, "sep") or ",")
        if action == "index":
            cols = request.get("cols") or []
            cols = json.loads(cols) if isinstance(cols, str) else cols
            for c in cols:
                engine.create_index(path, [c] if isinstance(c, str) else c)
            return {"status": "ok"}
        if action not in ("query", "count"):
            raise ValueError(f"unknown action: {action}")
        count = action == "count" or bool(request.get("countOnly"))
        query = engine.find(path, locators=not path.endswith(".parquet") and not count).where(request.get("where")).limit(_int(request, "limit")).offset(_int(request, "offset"))
        if group := _text(request, "groupBy"):
            query = query.group_by(group).aggregate("count" if count else _text(request, "aggFunc"), _text(request, "aggCol") or None)
        elif func := _text(request, "aggFunc"):
            query = query.aggregate(func, _text(request, "aggCol") or None)
        if request.get("explain"):
            return {"status": "ok", "plan": query.explain()}
        if count:
            return {"status": "ok", "count": query.count()}
        return {"status": "ok", "data": query.all() if query.keys or query.func or "line" not in query.df.columns else query.locators()}
    except (ValueError, KeyError, json.JSONDecodeError) as e:
        return {"status": "error", "error": str(e)}
