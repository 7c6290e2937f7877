"""JSON texts read to the letter of the grammar, and the text that a page shows for a value.

Native column expressions. Spark's JSON functions pass over what follows a value, and its
variants refuse keys that are given twice; these functions refuse the first and take the
last of the second, as a page's and a server's readers do. NaN and infinities, which only
some readers know, are refused; so is what is nested deeper than Spark's parser goes (1,000).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
_STRING = r'"(?:[^"\\]|\\.)*+"'
OBJECT_TEXT = "[object Object]"


def let(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make(value)``, with the value worked out once."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def body_text(body: Column) -> Column:
    """A body without the byte order mark that decoding takes off."""
    return F.regexp_replace(body, r"^\x{FEFF}", "")


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing else.

    The text is read as the first of two elements of a list, the second being its own
    digest: what follows the value, whatever it is, keeps the digest from being second.
    """
    mark = F.md5(text)
    both = F.from_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')), "array<string>", _STRICT)
    return F.coalesce((F.size(both) == 2) & (F.get(both, F.lit(1)) == mark), F.lit(False))


def begins(text: Column, pattern: str) -> Column:
    """Whether a text's value begins with what a pattern matches; of one JSON value that tells its kind."""
    return text.rlike(rf"^[\t\n\r ]*{pattern}")


def is_object(text: Column) -> Column:
    return begins(text, r"\{") & is_json(text)


def field(text: Column, name: str, kind: str = "variant") -> Column:
    """A field of an object's text, the last of that name, as a type; null where there is none or it is null.

    As a variant it is the one before if the last holds an object with a key twice, which
    variants can't: ``is_string`` and ``value`` see to that.
    """
    return F.from_json(text, f"`{name}` {kind}", _STRICT)[name]


def fields(text: Column, names: tuple[str, ...], kind: str = "variant") -> Column:
    """Several of an object's fields as a struct, as ``field`` gives them, read at once."""
    return F.from_json(text, ", ".join(f"`{n}` {kind}" for n in names), _STRICT)


def is_string(found: Column, raw: Column) -> Column:
    """Whether the last field of a name, found as a variant and as a string, is a string."""
    return F.coalesce((kind(found) == "STRING") & (F.try_variant_get(found, "$", "string") == raw), F.lit(False))


def value(found: Column, raw: Column) -> Column:
    """The last field of a name as a variant; null for a list or object that a variant can't hold."""
    return F.when(raw.rlike(r"^[\[{]") & ~is_string(found, raw), F.try_parse_json(raw)).otherwise(found)


def kind(value: Column) -> Column:
    """The type of a variant: STRING, BOOLEAN, BIGINT, DECIMAL(..), DOUBLE, ARRAY<..>, OBJECT<..>, VOID."""
    return F.schema_of_variant(value)


def number_text(x: Column) -> Column:
    """A double as ECMAScript writes it: the fewest digits that give it back, exponents from 21 digits and 7 places on."""

    def shortest(p: Column) -> Column:
        """Digits (a long) and the place of the point before them, for p of 17 digits or fewer."""
        digits, point, size = p["digits"], p["point"], F.length(p["digits"])
        whole = digits.cast("bigint")

        def cut(k: Column) -> Column:
            unit = F.pow(F.lit(10), size - k).cast("bigint")
            return _div(whole + _div(unit, F.lit(2)), unit)

        enough = lambda k: F.concat(cut(k).cast("string"), F.lit("E"), (point - k).cast("string")).cast("double") == p["size"]
        # the digits given are nearly always the fewest; if one less doesn't do, fewer don't
        fewest = F.when((size == 1) | ~enough(size - 1), size).otherwise(F.get(F.filter(F.sequence(F.lit(1), size), enough), F.lit(0)))
        return let(fewest, lambda k: F.struct(cut(k).cast("string").alias("digits"), (point - k).alias("scale")))

    def written(s: Column) -> Column:
        d = F.rtrim(s["digits"], F.lit("0"))
        k, n = F.length(d), F.length(s["digits"]) + s["scale"]
        power = F.concat(F.lit("e"), F.when(n > 1, "+").otherwise("-"), F.abs(n - 1).cast("string"))
        return (
            F.when((k <= n) & (n <= 21), F.rpad(d, n, "0"))
            .when((n > 0) & (n <= 21), F.concat(F.substr(d, F.lit(1), n), F.lit("."), F.substr(d, n + 1)))
            .when((n > -6) & (n <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -n), d))
            .when(k == 1, F.concat(d, power))
            .otherwise(F.concat(F.substr(d, F.lit(1), F.lit(1)), F.lit("."), F.substr(d, F.lit(2)), power))
        )

    def positive(size: Column) -> Column:
        shown = size.cast("string")
        mantissa, power = F.split_part(shown, F.lit("E"), F.lit(1)), F.coalesce(F.split_part(shown, F.lit("E"), F.lit(2)).try_cast("int"), F.lit(0))
        front = F.split_part(mantissa, F.lit("."), F.lit(1))
        every = F.concat(front, F.split_part(mantissa, F.lit("."), F.lit(2)))
        digits = F.rtrim(F.ltrim(every, F.lit("0")), F.lit("0"))
        point = F.length(front) + power - (F.length(every) - F.length(F.ltrim(every, F.lit("0"))))
        return let(let(F.struct(digits.alias("digits"), point.alias("point"), size.alias("size")), shortest), written)

    sign = F.when(x < 0, "-").otherwise("")
    infinite = F.abs(x) == float("inf")
    whole = (F.abs(x) < float(1 << 53)) & (F.floor(x) == x)
    return F.when(whole, x.cast("bigint").cast("string")).when(infinite, F.concat(sign, F.lit("Infinity"))).otherwise(F.concat(sign, let(F.abs(x), positive)))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def leaf_text(value: Column) -> Column:
    """The text of a variant that is no list."""
    return let(
        value,
        lambda v: F.when(v.isNull() | (kind(v) == "VOID"), "")
        .when(kind(v).isin("STRING", "BOOLEAN"), F.try_variant_get(v, "$", "string"))
        .when(kind(v).startswith("OBJECT"), OBJECT_TEXT)
        .otherwise(number_text(F.try_variant_get(v, "$", "double"))),
    )


def leaves(value: Column, text: Column) -> Column:
    """The elements of a variant list whose JSON text is known, lists among them resolved; empty ones count as empty strings."""
    marks = F.regexp_extract_all(F.regexp_replace(text, _STRING, ""), F.lit(r"[\[\]]"), F.lit(0))
    none = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def deeper(at: Column, mark: Column) -> Column:
        now = at["now"] + F.when(mark == "[", 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most"))

    depth = F.aggregate(marks, none, deeper, lambda at: at["most"])

    def resolved(found: Column, _: Column) -> Column:
        inner = lambda e: F.try_variant_get(e, "$", "array<variant>")
        one = lambda e: F.when(kind(e).startswith("ARRAY"), F.when(F.size(inner(e)) == 0, F.array(F.parse_json(F.lit('""')))).otherwise(inner(e))).otherwise(F.array(e))
        return F.flatten(F.transform(found, one))

    return F.aggregate(F.sequence(F.lit(1), depth), F.array(value), resolved)


def list_text(text: Column) -> Column:
    """The same as text, for a list that has no variant, as an object in it has a key twice.

    Strings can't be told there from what they look like: one that begins with a brace is
    taken for an object, and one that begins with a bracket for a list.
    """
    open_ones = F.lit(r"[\[]")
    depth = F.size(F.regexp_extract_all(text, open_ones, F.lit(0)))
    inner = lambda e: F.coalesce(F.from_json(e, "array<string>", _STRICT), F.array(e))
    one = lambda e: F.when(e.startswith("["), F.when(F.size(inner(e)) == 0, F.array(F.lit(""))).otherwise(inner(e))).otherwise(F.array(e))
    found = F.aggregate(F.sequence(F.lit(1), depth), F.array(text), lambda acc, _: F.flatten(F.transform(acc, one)))
    number = lambda e: F.when(e.rlike(r"^-?[0-9][0-9.eE+-]*\z"), number_text(e.try_cast("double"))).otherwise(e)
    return F.array_join(F.transform(found, lambda e: F.when(e.isNull(), "").when(e.startswith("{"), OBJECT_TEXT).otherwise(F.coalesce(number(e), e))), ",")
