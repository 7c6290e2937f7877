"""Queries over account records, and the same in SQL.

The driver's tables have no forms, so forms are derived from ``customer`` and input
events from ``events`` by expressions that Spark SQL and DuckDB both read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import EDGE_WS, EMAIL, LINE_END, WS, is_empty
from tessera.operators import intake, outcome, sessions, validate
from tessera.sources.schemas import LOGIN_FORM, SIGNUP_FORM, as_forms

DAY_MICROS = 86_400_000_000

SIGNUP_FORMS = """
SELECT c_custkey,
  CASE WHEN c_custkey % 11 = 0 THEN '  ' ELSE concat('  ', substring(c_name, 1, 8), ' ') END AS first_name,
  CASE WHEN c_custkey % 13 = 0 THEN '' ELSE substring(c_name, 10) END AS last_name,
  CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN concat('u', CAST(c_custkey AS VARCHAR(20)), '@host')
    WHEN 2 THEN concat(' u', CAST(c_custkey AS VARCHAR(20)), '@h.example ') ELSE concat('u', CAST(c_custkey AS VARCHAR(20)), '@h.example') END AS email,
  CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'letters only' WHEN 2 THEN 'a1' ELSE concat(c_mktsegment, CAST(c_custkey AS VARCHAR(20))) END AS password,
  CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'other'
    ELSE CASE WHEN c_custkey % 5 > 2 THEN concat(c_mktsegment, CAST(c_custkey AS VARCHAR(20))) ELSE 'letters only' END END AS confirm_password,
  c_custkey % 4 <> 0 AS terms
FROM {customer}
"""

LOGIN_FORMS = """
SELECT c_custkey,
  CASE c_custkey % 5 WHEN 0 THEN '  ' WHEN 1 THEN 'no at sign' WHEN 2 THEN concat(' ', c_mktsegment, '@h.example ') ELSE concat('u', CAST(c_custkey AS VARCHAR(20)), '@h.example') END AS email,
  CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'short' ELSE concat(c_mktsegment, '-login') END AS password
FROM {customer}
"""

#: Whole requests are built around ``whole``; what binds differs in repeated keys, blanks and what follows.
BODIES = """
SELECT c_custkey, CASE c_custkey % 17
  WHEN 0 THEN 'not json' WHEN 1 THEN '[1]' WHEN 2 THEN '"a"'
  WHEN 3 THEN concat('{{"first_name":"', c_name, '","last_name":"x","email":"e","password":"p"}}')
  WHEN 4 THEN concat('{{"first_name":', CAST(c_custkey AS VARCHAR(20)), ',"last_name":"x","email":"e","password":"p","confirm_password":"p"}}')
  WHEN 5 THEN '{{"first_name":"f","last_name":null,"email":"e","password":"p","confirm_password":"p"}}'
  WHEN 6 THEN concat('{{"first_name":"', c_name, '","last_name":"","email":"e","password":"p","confirm_password":"q","more":[1]}}')
  WHEN 7 THEN concat(whole, ' x') WHEN 8 THEN concat(whole, '{{"a":1}}') WHEN 9 THEN concat('[', whole, ']') WHEN 10 THEN concat(whole, ']')
  WHEN 11 THEN concat(' ', whole, '  ')
  WHEN 12 THEN concat('{{"first_name":"a","first_name":"b",', substring(whole, 2))
  WHEN 13 THEN concat(substring(whole, 1, length(whole) - 1), ',"email":5}}')
  WHEN 14 THEN concat(substring(whole, 1, length(whole) - 1), ',"more":{{"a":1,"a":2}}}}')
  WHEN 15 THEN concat('{{"email":{{"a":1,"a":2}},', substring(whole, 2))
  ELSE whole END AS body
FROM (SELECT c_custkey, c_name, concat('{{"first_name":"', c_name, '","last_name":"x","email":"e","password":"p","confirm_password":"p"}}') AS whole FROM {customer})
"""

ANSWERS = """
SELECT event_id,
  CASE event_id % 7 WHEN 0 THEN 200 WHEN 1 THEN 201 WHEN 2 THEN 299 WHEN 3 THEN 300 WHEN 4 THEN 422 WHEN 5 THEN 200 END AS status,
  CASE event_id % 31 WHEN 0 THEN '{{"message":"hi"}}' WHEN 1 THEN '{{"message":""}}' WHEN 2 THEN '{{}}' WHEN 3 THEN '{{"message":null}}'
    WHEN 4 THEN '{{"message":0}}' WHEN 5 THEN '{{"message":false}}' WHEN 6 THEN 'null' WHEN 7 THEN '{{"detail":[]}}' WHEN 8 THEN 'oops'
    WHEN 9 THEN '{{"message":"Welcome"}}' WHEN 10 THEN '{{"message":"hi"}}{{' WHEN 11 THEN '{{"message":"hi"}}]' WHEN 12 THEN '{{"message":"a","message":"b"}}'
    WHEN 13 THEN '{{"message":[1,2]}}' WHEN 14 THEN '{{"message":{{"a":1}}}}' WHEN 15 THEN '{{"message":[]}}' WHEN 16 THEN '{{"message":1e21}}'
    WHEN 17 THEN '{{"message":12345678901234567890}}' WHEN 18 THEN '{{"message":[1,[2,null,[]],{{"b":[3]}},"x",true,-1.5e-7]}}'
    WHEN 19 THEN concat('{{"message":', CAST(event_id AS VARCHAR(20)), '.125}}') WHEN 20 THEN '{{"message":-0.0}}' WHEN 21 THEN '{{"message":true}}'
    WHEN 22 THEN '[{{"message":"x"}}]' WHEN 23 THEN ' {{"message":"sp"}} ' WHEN 24 THEN '"message"' WHEN 25 THEN '{{"message":0.000001}}'
    WHEN 26 THEN '{{"message":{{"toString":1}}}}' WHEN 27 THEN '{{"message":"b","message":0}}' WHEN 28 THEN '{{"message":1e400}}'
    WHEN 29 THEN '{{"message":0.00000012}}' END AS body
FROM {events}
"""

INPUTS = """
SELECT user_id, ts, event_id, event_type,
  CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN '  ' WHEN 2 THEN concat('u', CAST(event_id AS VARCHAR(20)))
    WHEN 3 THEN concat('u', CAST(event_id AS VARCHAR(20)), '@h.example') ELSE ' a@b.c ' END AS value,
  CASE event_id % 7 WHEN 0 THEN '' WHEN 1 THEN ' ' WHEN 2 THEN 'short' WHEN 3 THEN '        ' ELSE concat('password-', CAST(event_id AS VARCHAR(20))) END AS password,
  event_id % 3 <> 0 AS remember
FROM {events}
"""


def _derived(spark: SparkSession, sf_dir: str, sql: str, table: str) -> DataFrame:
    return spark.sql(sql.format(**{table: f"parquet.`{sf_dir}/{table}.parquet`"}))


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_forms(_derived(spark, sf_dir, SIGNUP_FORMS, "customer"), SIGNUP_FORM, "c_custkey")


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, INPUTS, "events")


def _micros():
    return F.unix_micros(F.col("ts").cast("timestamp")).alias("micros")


def signup_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate_signup(_forms(spark, sf_dir)).select("c_custkey", *validate.SIGNUP_ERRORS, "is_valid")


def signup_errors_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.errors_long(signup_validate(spark, sf_dir), "c_custkey")


def signup_accept_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = validate.validate_signup(_forms(spark, sf_dir)).where("is_valid")
    return intake.response(intake.request(valid)).select("message", "data.*")


def signup_request_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intake.request(_forms(spark, sf_dir), "c_custkey").select("c_custkey", intake.request_json().alias("body"))


def signup_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, BODIES, "customer").select("c_custkey", intake.is_bound(F.col("body")).alias("bound"))


def login_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = as_forms(_derived(spark, sf_dir, LOGIN_FORMS, "customer"), LOGIN_FORM, "c_custkey")
    return validate.validate_login(forms).select("c_custkey", "e_email", "e_password", "message")


def signup_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, ANSWERS, "events").select("event_id", outcome.signup_outcome(F.col("status"), F.col("body")).alias("outcome"))


def typing_current_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _inputs(spark, sf_dir).select("user_id", _micros(), "event_id", "value")
    return sessions.current_errors(events, "user_id", "micros", "event_id", "value").select("user_id", "event_id", "current_error")


def toggle_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = _inputs(spark, sf_dir).where("event_type = 'click'").select("user_id", _micros(), "event_id")
    return sessions.visibility(clicks, "user_id", "micros", "event_id").select("user_id", "event_id", "visible")


def submit_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    submits = _inputs(spark, sf_dir).where("event_type = 'signup'").select("user_id", _micros(), "event_id")
    return sessions.accepted_submits(submits, "user_id", "micros", "event_id", DAY_MICROS).groupBy("user_id").agg(F.count("*").alias("n_accepted"))


def typing_password_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _inputs(spark, sf_dir).select("user_id", _micros(), "event_id", "password")
    shown = sessions.current_errors(events, "user_id", "micros", "event_id", "password", validate.login_password_error, is_empty)
    return shown.select("user_id", "event_id", "current_error")


def signup_field_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.field_states(signup_validate(spark, sf_dir), "c_custkey")


def forgot_password(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcome.forgot_password(_inputs(spark, sf_dir).where("event_type = 'error'").select("event_id"))


def _login_events(inputs: DataFrame) -> DataFrame:
    return inputs.select("user_id", _micros(), "event_id", F.col("value").alias("email"), "password", "remember", (F.col("event_type") == "signup").alias("is_submit"))


def stored_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.stored_history(_login_events(_inputs(spark, sf_dir)), "user_id", "micros", "event_id", "is_submit", DAY_MICROS)


def remembered_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = sessions.remembered(_login_events(_inputs(spark, sf_dir)), "user_id", "micros", "event_id", "is_submit", DAY_MICROS)
    return stored.where(outcome.truthy(F.col("email")))


def restored_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    loads = _inputs(spark, sf_dir).where("event_type = 'view'").select("user_id", "event_id", _micros())
    return sessions.restored(loads, stored_history(spark, sf_dir), "user_id", "micros").select("user_id", "event_id", "email", "remember")


def email_rule_on_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("text").contains("@"))
    tokens = F.filter(F.split("text", f"[{WS}]+"), lambda t: t.contains("@"))
    return docs.select("doc_id", F.explode(tokens).alias("token")).where(F.col("token").rlike(EMAIL))


QUERIES = {
    "signup_validate": signup_validate,
    "signup_errors_long": signup_errors_long,
    "signup_accept_redacted": signup_accept_redacted,
    "signup_request_json": signup_request_json,
    "signup_bind": signup_bind,
    "login_validate": login_validate,
    "signup_outcome": signup_outcome,
    "signup_field_states": signup_field_states,
    "forgot_password": forgot_password,
    "typing_current_error": typing_current_error,
    "typing_password_error": typing_password_error,
    "toggle_state": toggle_state,
    "submit_suppress": submit_suppress,
    "stored_history": stored_history,
    "remembered_email": remembered_email,
    "restored_session": restored_session,
    "email_rule_on_text": email_rule_on_text,
}


def _trim(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '{EDGE_WS}', '', 'g')"


def _u16(c: str) -> str:
    return f"(length({c}) + len(regexp_extract_all({c}, '[\\x{{10000}}-\\x{{10FFFF}}]')))"


def _email_error(c: str, missing: str, wrong: str) -> str:
    return f"CASE WHEN {_trim(c)} = '' THEN '{missing}' WHEN NOT regexp_matches({_trim(c)}, '{EMAIL}') THEN '{wrong}' END"


_DOUBLE = "TRY_CAST(({v}) ->> '$' AS DOUBLE)"


def _number(x: str) -> str:
    """A double that isn't zero in the notation of pages."""
    shown = f"CAST(abs({x}) AS VARCHAR)"
    return f"""(SELECT CASE WHEN isinf({x}) THEN 'Infinity' WHEN k <= n AND n <= 21 THEN rpad(d, CAST(n AS INTEGER), '0') WHEN n > 0 AND n <= 21 THEN d[:n] || '.' || d[n + 1:]
    WHEN n > -6 AND n <= 0 THEN '0.' || repeat('0', -n) || d ELSE d[1] || CASE WHEN k > 1 THEN '.' || d[2:] ELSE '' END || 'e' || CASE WHEN n > 1 THEN '+' ELSE '-' END || CAST(abs(n - 1) AS VARCHAR) END
  FROM (SELECT trim(w, '0') AS d, length(trim(w, '0')) AS k, i + e - (length(w) - length(ltrim(w, '0'))) AS n FROM (
    SELECT replace(split_part({shown}, 'e', 1), '.', '') AS w, length(split_part(split_part({shown}, 'e', 1), '.', 1)) AS i, coalesce(TRY_CAST(split_part({shown}, 'e', 2) AS INTEGER), 0) AS e)))"""


def _shown(kind: str, v: str) -> str:
    number = _DOUBLE.format(v=v)
    return f"""CASE {kind} WHEN 'NULL' THEN '' WHEN 'ARRAY' THEN '' WHEN 'OBJECT' THEN '[object Object]' WHEN 'VARCHAR' THEN {v} ->> '$' WHEN 'BOOLEAN' THEN {v} ->> '$'
  ELSE CASE WHEN {number} = 0 THEN '0' WHEN {number} < 0 THEN '-' || {_number(number)} ELSE {_number(number)} END END"""


def _odd(v: str) -> str:
    return f"coalesce(json_type({v}) = 'OBJECT' AND list_contains(json_keys({v}), 'toString'), FALSE)"


_FORMS = SIGNUP_FORMS.format(customer="customer")
_VALID = f"""
SELECT *, coalesce(e_first_name, e_last_name, e_email, e_password, e_confirm_password, e_terms) IS NULL AS is_valid FROM (
SELECT *, CASE WHEN {_trim("first_name")} = '' THEN 'First name is required.' END AS e_first_name,
  CASE WHEN {_trim("last_name")} = '' THEN 'Last name is required.' END AS e_last_name,
  {_email_error("email", "Email address is required.", "Please enter a valid email address.")} AS e_email,
  CASE WHEN password = '' THEN 'Password is required.'
    WHEN NOT ({_u16("password")} >= 8 AND regexp_matches(password, '[A-Za-z]') AND regexp_matches(password, '[0-9]') AND NOT regexp_matches(password, '{LINE_END}'))
    THEN 'Password must be at least 8 characters and contain a letter and number.' END AS e_password,
  CASE WHEN confirm_password = '' THEN 'Please confirm your password.' WHEN password <> confirm_password THEN 'Passwords do not match.' END AS e_confirm_password,
  CASE WHEN NOT terms THEN 'You must accept the Terms and Conditions.' END AS e_terms
FROM ({_FORMS}))
"""
_INPUTS = INPUTS.format(events="events")
#: Submits that pass both rules, then from one that is taken to the next one after its delay; the
#: form's last event before the delay ends tells what is stored from then on, until the next one does.
_HISTORY = f"""
SELECT user_id, t + {DAY_MICROS} AS since, lead(t + {DAY_MICROS}) OVER (PARTITION BY user_id ORDER BY t) AS until, CASE WHEN remember THEN email END AS email FROM (
  SELECT user_id, t, remember, {_trim("value")} AS email, row_number() OVER (PARTITION BY user_id, t ORDER BY ts DESC, event_id DESC) AS k
  FROM ({_INPUTS}) JOIN (
    WITH RECURSIVE v AS (SELECT DISTINCT user_id, epoch_us(ts) AS t FROM ({_INPUTS})
        WHERE event_type = 'signup' AND regexp_matches({_trim("value")}, '{EMAIL}') AND {_u16("password")} >= 8),
      a AS (SELECT user_id, min(t) AS t FROM v GROUP BY user_id
        UNION ALL SELECT a.user_id, (SELECT min(v.t) FROM v WHERE v.user_id = a.user_id AND v.t >= a.t + {DAY_MICROS}) FROM a WHERE a.t IS NOT NULL)
    SELECT user_id, t FROM a WHERE t IS NOT NULL) USING (user_id)
  WHERE epoch_us(ts) >= t AND epoch_us(ts) < t + {DAY_MICROS})
WHERE k = 1
"""
_FIELDS = ("first_name", "last_name", "email", "password", "confirm_password")

ORACLE_SQL = {
    "signup_validate": f"SELECT c_custkey, e_first_name, e_last_name, e_email, e_password, e_confirm_password, e_terms, is_valid FROM ({_VALID})",
    "signup_errors_long": " UNION ALL ".join(f"SELECT c_custkey, '{e[2:]}' AS field, {e} AS message FROM ({_VALID}) WHERE {e} IS NOT NULL" for e in validate.SIGNUP_ERRORS),
    "signup_accept_redacted": f"SELECT 'Signup successful' AS message, {_trim('first_name')} AS first_name, {_trim('last_name')} AS last_name, {_trim('email')} AS email FROM ({_VALID}) WHERE is_valid",
    "signup_request_json": f"""SELECT c_custkey, CAST(to_json(struct_pack(first_name := {_trim("first_name")}, last_name := {_trim("last_name")}, email := {_trim("email")},
  password := password, confirm_password := confirm_password)) AS VARCHAR) AS body FROM ({_FORMS})""",
    "signup_bind": f"""SELECT c_custkey, CASE WHEN json_valid(body) AND json_type(CASE WHEN json_valid(body) THEN body END) = 'OBJECT' THEN {" AND ".join(f"coalesce((SELECT arg_max(e.type, e.rowid) FROM json_each(CASE WHEN json_valid(body) THEN body END) e WHERE e.key = '{f}') = 'VARCHAR', FALSE)" for f in _FIELDS)} ELSE FALSE END AS bound
FROM ({BODIES.format(customer="customer")})""",
    "login_validate": f"""SELECT c_custkey, e_email, e_password, CASE WHEN e_email IS NULL AND e_password IS NULL THEN 'Login successful!' ELSE 'Please fix the errors above.' END AS message FROM (
SELECT c_custkey, {_email_error("email", "Email is required.", "Please enter a valid email.")} AS e_email,
  CASE WHEN password = '' THEN 'Password is required.' WHEN {_u16("password")} < 8 THEN 'Password must be at least 8 characters.' END AS e_password
FROM ({LOGIN_FORMS.format(customer="customer")}))""",
    "signup_outcome": f"""WITH a AS MATERIALIZED (SELECT event_id, status, CASE WHEN json_valid(body) THEN body END AS body, coalesce(json_valid(body), FALSE) AS ok FROM ({ANSWERS.format(events="events")})),
m AS (SELECT DISTINCT body, (SELECT arg_max(e.value, e.rowid) FROM json_each(body) e WHERE e.key = 'message') AS v FROM a WHERE ok AND json_type(body) = 'OBJECT'),
l AS (SELECT body, string_agg({_shown("t.type", "t.value")}, ',' ORDER BY t.rowid) AS text, bool_or({_odd("t.value")}) AS odd
  FROM m, json_tree(v) t WHERE json_type(v) = 'ARRAY' AND regexp_full_match(t.fullkey, '\\$(\\[[0-9]+\\])+') AND (t.type <> 'ARRAY' OR json_array_length(t.value) = 0) GROUP BY body),
x AS (SELECT body, CASE json_type(v) WHEN 'VARCHAR' THEN nullif(v ->> '$', '') WHEN 'BOOLEAN' THEN nullif(v ->> '$', 'false') WHEN 'ARRAY' THEN CASE WHEN odd THEN '{outcome.UNREACHABLE}' ELSE coalesce(text, '') END
    WHEN 'OBJECT' THEN CASE WHEN {_odd("v")} THEN '{outcome.UNREACHABLE}' ELSE '[object Object]' END
    ELSE CASE WHEN v IS NULL OR json_type(v) = 'NULL' OR {_DOUBLE.format(v="v")} = 0 THEN NULL ELSE {_number(_DOUBLE.format(v="v"))} END END AS shown FROM m LEFT JOIN l USING (body))
SELECT event_id, CASE WHEN status IS NULL OR NOT ok THEN '{outcome.UNREACHABLE}' WHEN status NOT BETWEEN 200 AND 299 THEN '{outcome.FAILED}'
  WHEN json_type(body) = 'NULL' THEN '{outcome.UNREACHABLE}' ELSE coalesce(shown, '{outcome.DEFAULT}') END AS outcome
FROM a LEFT JOIN x USING (body)""",
    "typing_current_error": f"""SELECT user_id, event_id, nullif(last_value(e IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS current_error
FROM (SELECT *, CASE WHEN {_trim("value")} <> '' THEN coalesce({_email_error("value", "Email is required.", "Please enter a valid email.")}, '') END AS e FROM ({_INPUTS}))""",
    "typing_password_error": f"""SELECT user_id, event_id, nullif(last_value(e IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS current_error
FROM (SELECT *, CASE WHEN password <> '' THEN CASE WHEN {_u16("password")} < 8 THEN 'Password must be at least 8 characters.' ELSE '' END END AS e FROM ({_INPUTS}))""",
    "signup_field_states": " UNION ALL ".join(f"SELECT c_custkey, '{e[2:]}' AS field, coalesce({e}, '') AS message, {e} IS NOT NULL AND {e != 'e_terms'} AS input_error FROM ({_VALID})" for e in validate.SIGNUP_ERRORS),
    "forgot_password": "SELECT event_id, 'Password reset functionality will be added later.' AS message, 'form-message error-message' AS message_class FROM events WHERE event_type = 'error'",
    "toggle_state": f"""SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) % 2 = 1 AS visible
FROM ({_INPUTS}) WHERE event_type = 'click'""",
    "submit_suppress": f"""WITH RECURSIVE e AS (SELECT DISTINCT user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'signup'),
a AS (SELECT user_id, min(t) AS t FROM e GROUP BY user_id
  UNION ALL SELECT a.user_id, (SELECT min(e.t) FROM e WHERE e.user_id = a.user_id AND e.t >= a.t + {DAY_MICROS}) FROM a WHERE a.t IS NOT NULL)
SELECT user_id, count(t) AS n_accepted FROM a GROUP BY user_id""",
    "stored_history": f"SELECT user_id, since, until, email FROM ({_HISTORY})",
    "remembered_email": f"SELECT user_id, email FROM ({_HISTORY}) WHERE until IS NULL AND coalesce(email, '') <> ''",
    "restored_session": f"""SELECT i.user_id, i.event_id, nullif(s.email, '') AS email, coalesce(s.email, '') <> '' AS remember
FROM ({_INPUTS}) i LEFT JOIN ({_HISTORY}) s ON s.user_id = i.user_id AND s.since <= epoch_us(i.ts) AND (s.until IS NULL OR epoch_us(i.ts) < s.until) WHERE i.event_type = 'view'""",
    "email_rule_on_text": f"SELECT doc_id, token FROM (SELECT doc_id, unnest(string_split_regex(text, '[{WS}]+')) AS token FROM documents) WHERE regexp_matches(token, '{EMAIL}')",
}
