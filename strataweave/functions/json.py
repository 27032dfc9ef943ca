"""JSON containment, as a filter on JSON text."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains(document: Column, wanted: Mapping) -> Column:
    """Whether every key of wanted, at any depth, has its value in document; {} is in every document."""
    return _within(document, "$", wanted)


def _within(document: Column, path: str, wanted: Mapping) -> Column:
    held = F.lit(True)
    for key, value in wanted.items():
        at = f"{path}.{key}"
        if isinstance(value, Mapping):
            held &= _within(document, at, value)
            continue
        expected = value if isinstance(value, str) else json.dumps(value, separators=(",", ":"))
        held &= F.coalesce(F.get_json_object(document, at) == F.lit(expected), F.lit(False))
    return held


def merged(fields: dict[str, Column]) -> Column:
    """Fields as JSON text; of equal names the later stands."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))
