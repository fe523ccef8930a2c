"""Bounded previews of unknown records."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Preview limits.
MAX_STRING = 4096
MAX_ITEMS = 20
MAX_KEYS = 50
MAX_DEPTH = 6


def bounded_raw(line: Column) -> Column:
    """Struct (raw, raw_truncated): JSON text with long strings, arrays, objects and deep levels replaced by markers.

    Everything the workers run is local to this function, so they need no installed package.
    """
    limits = (MAX_STRING, MAX_ITEMS, MAX_KEYS, MAX_DEPTH)

    def bound(value, depth: int):
        if isinstance(value, str):
            if len(value) <= limits[0]:
                return value, False
            return {"truncated": True, "type": "string", "length": len(value)}, True
        if isinstance(value, list):
            pairs = [bound(v, depth + 1) for v in value[:limits[1]]]
            cut = len(value) > limits[1]
            tail = [{"truncated": True, "type": "array", "remainingItems": len(value) - limits[1]}] if cut else []
            return [v for v, _ in pairs] + tail, cut or any(t for _, t in pairs)
        if isinstance(value, dict):
            if depth >= limits[3]:
                return {"truncated": True, "type": "object", "keys": len(value)}, True
            out, cut = {}, len(value) > limits[2]
            for key in list(value)[:limits[2]]:
                out[key], child_cut = bound(value[key], depth + 1)
                cut = cut or child_cut
            if len(value) > limits[2]:
                out["__truncated"] = {"truncated": True, "type": "object", "remainingKeys": len(value) - limits[2]}
            return out, cut
        return value, False

    @F.pandas_udf("raw string, raw_truncated boolean")
    def preview(texts: pd.Series) -> pd.DataFrame:
        rows = [bound(json.loads(text), 0) for text in texts]
        return pd.DataFrame({
            "raw": [json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v, _ in rows],
            "raw_truncated": [True if cut else None for _, cut in rows],
        })

    return preview(line)
