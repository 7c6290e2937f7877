"""Record types of account forms, and readers of submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

REQUEST_FIELDS = ("first_name", "last_name", "email", "password", "confirm_password")

REQUEST = T.StructType([T.StructField(f, T.StringType()) for f in REQUEST_FIELDS])
SIGNUP_FORM = T.StructType([*REQUEST.fields, T.StructField("terms", T.BooleanType())])
LOGIN_FORM = T.StructType([T.StructField("email", T.StringType()), T.StructField("password", T.StringType()), T.StructField("remember", T.BooleanType())])
RESPONSE = T.StructType(
    [
        T.StructField("message", T.StringType(), False),
        T.StructField("data", T.StructType([T.StructField(f, T.StringType()) for f in REQUEST_FIELDS[:3]]), False),
    ]
)


def as_forms(rows: DataFrame, form: T.StructType, *keep: str) -> DataFrame:
    """``rows`` as forms of a type, after the columns ``keep``.

    Other columns go, a missing field is null, and a field of a type that can't be
    stored as the form's is an error.
    """
    return rows.to(T.StructType([*(rows.schema[k] for k in keep), *form.fields]))


def read_forms(spark: SparkSession, path: str, form: T.StructType) -> DataFrame:
    """Forms from JSON lines; a line that is no object gives a form of nulls."""
    return spark.read.schema(form).json(path)


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """One JSON body per line of text files, as (body)."""
    return spark.read.text(path).withColumnRenamed("value", "body")


def stream_bodies(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream over files that arrive in a folder."""
    return spark.readStream.text(path).withColumnRenamed("value", "body")
