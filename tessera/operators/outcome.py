"""What a form shows after its request was answered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import json as J

# What the pages show.
FORGOT_PASSWORD = "Password reset functionality will be added later."
ERROR_CLASS = "form-message error-message"
DEFAULT, FAILED, UNREACHABLE = "Signup successful.", "Signup failed. Please try again.", "Unable to connect to the server."


def truthy(c: Column) -> Column:
    """A text that is neither null nor empty."""
    return F.coalesce(c, F.lit("")) != ""


def message_text(value: Column, raw: Column) -> Column:
    """What a page shows for an answer's message, or the default where it counts as false.

    value: the message as a variant, raw: its JSON text. Numbers, lists and objects are
    shown as ECMAScript turns them to text. An object with a key ``toString`` can't be:
    the page's attempt fails, and what it shows then is that the server wasn't reached.
    A list that holds an object with a key twice is resolved from its text.
    """
    kind, is_list = J.kind(value), lambda v: J.kind(v).startswith("ARRAY")
    number = F.try_variant_get(value, "$", "double")
    odd = lambda v: J.kind(v).startswith("OBJECT") & F.array_contains(F.json_object_keys(F.to_json(v)), "toString")
    listed = J.let(J.leaves(value, raw), lambda found: F.when(F.exists(found, lambda v: F.coalesce(odd(v), F.lit(False))), UNREACHABLE).otherwise(F.array_join(F.transform(found, J.leaf_text), ",")))
    return (
        F.when(value.isNull() & (raw.isNull() | ~raw.rlike(r"^[\[{]")), DEFAULT)
        .when((kind == "VOID") | (raw == "") | ((kind == "BOOLEAN") & (raw == "false")) | (~kind.isin("STRING", "BOOLEAN") & (number == 0)), DEFAULT)
        .when(kind == "STRING", raw)
        .when(kind.startswith("OBJECT") | (value.isNull() & raw.startswith("{")), F.when(F.array_contains(F.json_object_keys(raw), "toString"), UNREACHABLE).otherwise(J.OBJECT_TEXT))
        .when(is_list(value), listed)
        .when(value.isNull(), J.list_text(raw))
        .otherwise(J.leaf_text(value))
    )


def signup_outcome(status: Column, body: Column) -> Column:
    """The body is parsed first; then 2xx shows its message or a default, the rest failed.

    No status, a body that isn't JSON, and null for a 2xx body count as unreachable. Only
    objects have a message; of several in one the last counts.
    """

    text = J.body_text(body)
    message = F.struct(J.field(text, "message").alias("found"), J.field(text, "message", "string").alias("raw"))
    return (
        F.when(status.isNull() | ~F.coalesce(J.is_json(text), F.lit(False)), UNREACHABLE)
        .when(~status.between(200, 299), FAILED)
        .when(J.begins(text, "null"), UNREACHABLE)  # one JSON value, as the text is here, is null if it begins so
        .when(~J.begins(text, r"\{"), DEFAULT)
        .otherwise(J.let(message, lambda m: message_text(J.value(m["found"], m["raw"]), m["raw"])))
    )


def forgot_password(clicks: DataFrame) -> DataFrame:
    """``clicks`` on the link, with the form's message and its class: the same ones each time."""
    return clicks.withColumns({"message": F.lit(FORGOT_PASSWORD), "message_class": F.lit(ERROR_CLASS)})
