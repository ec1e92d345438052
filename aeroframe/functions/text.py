"""Text and JSON helpers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import DATUMS


def identifier_ok(name: Column) -> Column:
    return name.rlike("^[A-Za-z0-9_]+$")


def datum(text: Column) -> Column:
    """The vertical datum a text names, whatever its case; null if none."""
    upper = F.upper(F.trim(text))
    return F.when(upper.isin(*DATUMS), upper)


def filled(template: Column, values: dict[str, Column]) -> Column:
    """A template with its {name} places filled."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def without_fence(text: Column) -> Column:
    """A reply without a code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def json_reply(text: Column, schema: str) -> Column:
    """struct(status, value): REFUSED if the reply has an ``error``, INVALID if it is no JSON object, else OK."""
    clean = without_fence(text)
    value = F.from_json(clean, schema)
    error = F.get_json_object(clean, "$.error")
    status = F.when(error.isNotNull(), "REFUSED").when(F.get_json_object(clean, "$").isNull(), "INVALID").otherwise("OK")
    return F.struct(status.alias("status"), value.alias("value"))


def message(kind: Column, payload: Column) -> Column:
    """A tagged message: {"type": ..., "payload": ...}."""
    return F.to_json(F.struct(kind.alias("type"), payload.alias("payload")))
