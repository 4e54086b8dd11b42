"""Canonical and identity JSON of free-form records.

Records with a declared schema should use ``to_json`` of a struct whose fields are
in sorted order. These helpers are for free-form JSON text, whose keys are not
known, and run as Arrow-batched pandas UDFs.
"""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values -------------------------------------------------------------
VOLATILE_FIELDS = ["generated_at", "timestamp", "updated_at", "created_at", "mtime", "host", "hostname", "run_id"]
PATH_FIELDS = ["path", "absolute_path", "abs_path", "file"]
OUTSIDE_ROOT = "<outside-root>"
# -------------------------------------------------------------------------------


def canonical_json(text: Column) -> Column:
    """Compact JSON with sorted keys."""

    @F.pandas_udf(T.StringType())
    def convert(series: pd.Series) -> pd.Series:
        dump = lambda value: json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        return series.map(lambda t: None if t is None else dump(json.loads(t)))

    return convert(text)


def identity_json(text: Column, root: str | None = None) -> Column:
    """Canonical JSON without volatile fields and with paths relative to ``root``."""
    volatile, path_fields, outside = list(VOLATILE_FIELDS), list(PATH_FIELDS), OUTSIDE_ROOT

    def normal_path(raw: str) -> str:
        path = raw.replace("\\", "/").strip()
        while path.startswith("./"):
            path = path[2:]
        if root is None:
            return path
        base = root.replace("\\", "/").rstrip("/")
        if path.startswith(base):
            return path[len(base):].lstrip("/")
        return outside if path.startswith("/") or path[1:2] == ":" else path

    def identity(value):
        if isinstance(value, dict):
            return {
                k: normal_path(v) if k in path_fields and isinstance(v, str) else identity(v)
                for k, v in value.items()
                if k not in volatile
            }
        if isinstance(value, list):
            return [identity(v) for v in value]
        return value

    @F.pandas_udf(T.StringType())
    def convert(series: pd.Series) -> pd.Series:
        dump = lambda value: json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
        return series.map(lambda t: None if t is None else dump(identity(json.loads(t))))

    return convert(text)


@F.pandas_udf(T.StringType())
def _nfd(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFD", t))


def nfd(text: Column) -> Column:
    """Canonical decomposition, which Spark has no built-in for."""
    return _nfd(text)
