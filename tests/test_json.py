"""Strict JSON reading and the text of values, against vectors and a second implementation."""

from __future__ import annotations

import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from tessera.functions import json as J
from tessera.operators import intake, outcome

FULL = '{"first_name":"f","last_name":"l","email":"e","password":"p","confirm_password":"p"}'


def _rows(spark, values, make, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r.x for r in sorted(df.select("k", make(F.col("v")).alias("x")).collect())]


BODIES = {
    FULL: True, " \t" + FULL + "\r\n": True, "﻿" + FULL: True, FULL + " x": False, FULL + "{": False, FULL + "]": False, FULL + "," + FULL: False, f"[{FULL}]": False,
    '{"first_name":"a",' + FULL[1:]: True, FULL[:-1] + ',"email":1}': False, '{"email":1,' + FULL[1:]: True, '{"email":{"a":1,"a":2},' + FULL[1:]: True,
    FULL[:-1] + ',"more":{"a":1,"a":[2]}}': True, FULL[:-1] + ',"more":NaN}': False, FULL[:-1] + ",'more':1}": False, FULL[:-1] + ",}": False, FULL + "//": False,
    FULL[:-1] + ',"email":{"a":1,"a":2}}': False, FULL.replace('"f"', "null"): False, FULL.replace('"first_name":"f",', ""): False, FULL.replace('"f"', '"\t"'): False, FULL.replace('"f"', '"\\u0041"'): True, "": False, "  ": False, "null": False,
}


def test_bodies_bind_to_the_letter(spark):
    assert _rows(spark, BODIES, intake.is_bound) == list(BODIES.values())
    twice = '{"first_name":"a",' + FULL[1:-1] + ',"email":"last"}'
    got = intake.bind(spark.createDataFrame([(1, twice), (2, FULL + "x"), (3, None)], "k int, body string")).collect()
    assert [(r.k, r.first_name, r.email) for r in got] == [(1, "f", "last")]


MESSAGES = {
    '"hi"': "hi", '""': None, "0": None, "-0": None, "-0.0": None, "0e5": None, "false": None, "null": None, "true": "true", '"0"': "0", '"false"': "false", '" "': " ",
    "[1,2]": "1,2", '{"a":1}': "[object Object]", "{}": "[object Object]", "[]": "", "[[]]": "", "[null]": "", "[0]": "0", "[[1,[2,null]],{},\"x,y\",false]": "1,2,,[object Object],x,y,false",
    "1e21": "1e+21", "1e20": "100000000000000000000", "12345678901234567890": "12345678901234567000", "0.000001": "0.000001", "1e-7": "1e-7", "-1.50": "-1.5", "1e400": "Infinity", "-1e400": "-Infinity",
    "123456789012345678901234567890123456789012345": "1.2345678901234567e+44", "5e-324": "5e-324", "0.1": "0.1", "9007199254740993": "9007199254740992", '"{"': "{", '["[","{"]': "[,{", '"a\\nb"': "a\nb",
    '{"toString":1}': outcome.UNREACHABLE, '[1,{"toString":null}]': outcome.UNREACHABLE, '{"a":1,"a":2}': "[object Object]", '[{"a":1,"a":2},7.0,null,["x"]]': "[object Object],7,,x",
}


def test_messages_show_as_a_page_shows_them(spark):
    bodies = [f'{{"message":"no","message":{m}}}' for m in MESSAGES]
    want = [outcome.DEFAULT if x is None else x for x in MESSAGES.values()]
    assert _rows(spark, bodies, lambda v: outcome.signup_outcome(F.lit(200), v)) == want


@pytest.mark.parametrize(
    ("status", "body", "shown"),
    [
        (200, '{"message":"hi"}{', outcome.UNREACHABLE), (200, '{"message":"hi"}]', outcome.UNREACHABLE), (404, '{"message":"hi"}x', outcome.UNREACHABLE), (404, '{"message":"hi"}', outcome.FAILED),
        (200, '[{"message":"hi"}]', outcome.DEFAULT), (200, '"message"', outcome.DEFAULT), (200, " null ", outcome.UNREACHABLE), (200, "nullx", outcome.UNREACHABLE), (500, "null", outcome.FAILED), (200, None, outcome.UNREACHABLE),
    ],
)
def test_answers_are_read_before_their_status(spark, status, body, shown):
    assert _rows(spark, [body], lambda v: outcome.signup_outcome(F.lit(status), v)) == [shown]


def _ecmascript(x: float) -> str:
    """By Python's shortest digits."""
    if x == 0 or math.isinf(x):
        return "0" if x == 0 else "Infinity" if x > 0 else "-Infinity"
    mantissa, _, power = repr(abs(x)).partition("e")
    front, _, back = mantissa.partition(".")
    n = len(front) + int(power or 0) - (len(front + back) - len((front + back).lstrip("0")))
    d = (front + back).strip("0")
    k = len(d)
    if k <= n <= 21:
        out = d + "0" * (n - k)
    elif 0 < n <= 21:
        out = d[:n] + "." + d[n:]
    elif -6 < n <= 0:
        out = "0." + "0" * -n + d
    else:
        out = d[0] + ("." + d[1:] if k > 1 else "") + "e" + ("+" if n > 1 else "-") + str(abs(n - 1))
    return ("-" if x < 0 else "") + out


def test_number_text(spark):
    r = random.Random(1)
    values = [0.0, -0.0, math.inf, -math.inf, 5e-324, 1.7976931348623157e308, 5.684341886080802e-14, 2e-3, 1e23, 0.1 + 0.2, 2**-44, 9007199254740993.0]
    values += [x for x in (struct.unpack("<d", struct.pack("<Q", r.getrandbits(64)))[0] for _ in range(2000)) if not math.isnan(x)]
    values += [round(r.uniform(-1e6, 1e6), r.randrange(8)) for _ in range(500)] + [s * 10.0**k for k in range(-30, 30) for s in (1, -1.5)]
    assert _rows(spark, values, J.number_text, "double") == list(map(_ecmascript, values))


def test_json_is_what_a_reader_takes(spark):
    r = random.Random(2)
    pieces = ["{", "}", "[", "]", ",", ":", '"a"', '"b"', "1", "-2.5e3", "null", "true", " ", "\n", '"\\u00e9"', "x", '"', "01"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(1, 7))) for _ in range(3000)] + ['{"a":{"a":[1,{"b":null}]}}', "1],[2", '1,"x"],[']

    def reads(t):
        try:
            json.loads(t)
        except ValueError:
            return False
        return True

    assert _rows(spark, texts, J.is_json) == list(map(reads, texts))
