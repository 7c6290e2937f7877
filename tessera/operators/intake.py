"""Requests as JSON: making, strict binding, and responses without passwords."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import json as J
from tessera.functions.text import js_trim, text
from tessera.sources.schemas import REQUEST_FIELDS, RESPONSE

TRIMMED = ("first_name", "last_name", "email")


def request(forms: DataFrame, *keep: str) -> DataFrame:
    """The fields that are sent: names and email trimmed, passwords as they are, no consent."""
    fields = [(js_trim(F.col(f)) if f in TRIMMED else text(F.col(f))).alias(f) for f in REQUEST_FIELDS]
    return forms.select(*keep, *fields)


def request_json() -> Column:
    return F.to_json(F.struct(*REQUEST_FIELDS), {"ignoreNullFields": "false"})


def is_bound(body: Column) -> Column:
    """Whether a body is one JSON object with all fields, each of them a string; other keys don't matter.

    Of a key that is given twice the last one counts, and nothing may follow the object.
    """
    text = J.body_text(body)
    both = F.struct(J.fields(text, REQUEST_FIELDS).alias("found"), J.fields(text, REQUEST_FIELDS, "string").alias("raw"))
    strings = J.let(both, lambda b: functools.reduce(Column.__and__, [J.is_string(b["found"][f], b["raw"][f]) for f in REQUEST_FIELDS]))
    return F.coalesce(J.is_object(text) & strings, F.lit(False))


def bind(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Bodies that bind, with their fields as columns."""
    got = bodies.where(is_bound(F.col(body))).withColumn(body, J.fields(J.body_text(F.col(body)), REQUEST_FIELDS, "string"))
    return got.withColumns({f: F.col(body)[f] for f in REQUEST_FIELDS}).drop(body)


def response(accepted: DataFrame) -> DataFrame:
    """message and data for each accepted request; no password in either."""
    return accepted.select(F.lit("Signup successful").alias("message"), F.struct(*TRIMMED).alias("data")).to(RESPONSE)
