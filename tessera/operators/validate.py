"""Field rules of the sign-up and login forms: one message or null per field.

All fields' rules always run, so errors add up; a form is valid when none fired.
The messages are fixed values. Sign-up and login differ in wording and in the password rule on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import LEAST_LENGTH, is_blank, is_email, is_strong_password, js_trim, text, u16_length

SIGNUP_ERRORS = ("e_first_name", "e_last_name", "e_email", "e_password", "e_confirm_password", "e_terms")


def first_message(*cases: tuple[Column, str]) -> Column:
    """The message of the first condition that holds, or null."""
    out = F
    for condition, message in cases:
        out = out.when(condition, F.lit(message))
    return out.otherwise(F.lit(None).cast("string"))


def signup_errors() -> dict[str, Column]:
    c = F.col
    return {
        "e_first_name": first_message((is_blank(c("first_name")), "First name is required.")),
        "e_last_name": first_message((is_blank(c("last_name")), "Last name is required.")),
        "e_email": first_message((is_blank(c("email")), "Email address is required."), (~is_email(js_trim(c("email"))), "Please enter a valid email address.")),
        "e_password": first_message(
            (text(c("password")) == "", "Password is required."),
            (~is_strong_password(c("password")), "Password must be at least 8 characters and contain a letter and number."),
        ),
        "e_confirm_password": first_message(
            (text(c("confirm_password")) == "", "Please confirm your password."),
            (text(c("password")) != text(c("confirm_password")), "Passwords do not match."),
        ),
        "e_terms": first_message((~F.coalesce(c("terms"), F.lit(False)), "You must accept the Terms and Conditions.")),
    }


def login_email_error(c: Column) -> Column:
    return first_message((is_blank(c), "Email is required."), (~is_email(js_trim(c)), "Please enter a valid email."))


def login_password_error(c: Column) -> Column:
    return first_message((text(c) == "", "Password is required."), (u16_length(c) < LEAST_LENGTH, f"Password must be at least {LEAST_LENGTH} characters."))


def validate_signup(forms: DataFrame) -> DataFrame:
    """``forms`` with a message column per field and is_valid."""
    return forms.withColumns(signup_errors()).withColumn("is_valid", F.coalesce(*SIGNUP_ERRORS).isNull())


def validate_login(forms: DataFrame) -> DataFrame:
    """``forms`` with e_email, e_password, is_valid and the form's message."""
    out = forms.withColumns({"e_email": login_email_error(F.col("email")), "e_password": login_password_error(F.col("password"))})
    out = out.withColumn("is_valid", F.col("e_email").isNull() & F.col("e_password").isNull())
    return out.withColumn("message", F.when(F.col("is_valid"), F.lit("Login successful!")).otherwise(F.lit("Please fix the errors above.")))


def errors_long(validated: DataFrame, key: str) -> DataFrame:
    """(key, field, message) for each message of validated sign-ups."""
    pairs = F.array(*[F.struct(F.lit(e[2:]).alias("field"), F.col(e).alias("message")) for e in SIGNUP_ERRORS])
    return validated.select(key, F.inline(F.filter(pairs, lambda p: p["message"].isNotNull())))


def field_states(validated: DataFrame, key: str) -> DataFrame:
    """(key, field, message, input_error) for each field of validated sign-ups.

    A field without a fault shows an empty message. The box of a faulty field is marked
    (input_error), but for the terms, whose message alone is set and cleared.
    """
    states = F.array(*[F.struct(F.lit(e[2:]).alias("field"), F.coalesce(e, F.lit("")).alias("message"), (F.col(e).isNotNull() if e != "e_terms" else F.lit(False)).alias("input_error")) for e in SIGNUP_ERRORS])
    return validated.select(key, F.inline(states))
