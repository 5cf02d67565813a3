"""Canonical JSON of any column: keys sorted at every level, no blanks, ASCII only. All runs inside the JVM.

The form is that of a plain JSON writer: nulls are written, numbers have an exponent below 1e-4 and from 1e16 on, and
characters outside printable ASCII are lower-case escapes of their UTF-16 units. Dates, timestamps and decimals are
written as quoted text. Doubles have the JVM's digits: those read back the same, but before Java 19 there is sometimes one
more of them than the shortest form needs (-1.25e22 becomes -1.2499999999999999e+22).
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of JSON: the UTF-16 units with a short escape.
SHORT = {"0022": '\\"', "005C": "\\\\", "0008": "\\b", "0009": "\\t", "000A": "\\n", "000C": "\\f", "000D": "\\r"}


def json_string(c: Column) -> Column:
    """The text in quotes, escaped; null stays null."""

    def written(unit: Column) -> Column:
        out = F.when(unit.between("0020", "007E"), F.decode(F.unhex(F.substring(unit, 3, 2)), "UTF-8")).otherwise(F.concat(F.lit("\\u"), F.lower(unit)))
        for code, escape in SHORT.items():
            out = F.when(unit == code, F.lit(escape)).otherwise(out)
        return out

    units = F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit("(.{4})"), 1)
    plain = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    text = F.when(c.rlike(r"[^ -~]"), F.array_join(F.transform(units, written), "")).otherwise(plain)
    return F.concat(F.lit('"'), text, F.lit('"'))


def json_number(c: Column) -> Column:
    """A double as text: the JVM writes exponents from 1e7 on and below 1e-3, this form from 1e16 on and below 1e-4."""
    s = c.cast("string")
    sign, digits = F.regexp_extract(s, r"^-?", 0), F.regexp_replace(F.regexp_replace(s, r"E.*$", ""), r"(\.0$)|[-.]", "")
    power = F.regexp_extract(s, r"E(-?\d+)$", 1).try_cast("int")
    whole = F.concat(sign, F.rpad(F.substring(digits, F.lit(1), power + 1), power + 1, F.lit("0")), F.lit("."), F.coalesce(F.nullif(F.substring(digits, power + 2, F.length(digits)), F.lit("")), F.lit("0")))
    small = F.concat(sign, F.lit("0.000"), digits)
    mantissa = F.concat(sign, F.substring(digits, 1, 1), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), F.length(digits)))).otherwise(""))
    exponent = F.concat(F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))
    return F.when(power.isNull(), s).when(power.between(0, 15), whole).when(power == -4, small).otherwise(F.concat(mantissa, exponent))


def canonical_json(c: Column, kind: T.DataType) -> Column:
    """The column as canonical JSON text; kind is its type (``df.schema[name].dataType``)."""
    if isinstance(kind, T.StructType):
        order = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(F.lit(json.dumps(f.name) + ":"), canonical_json(c.getField(f.name), f.dataType)) for f in order]
        out = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.MapType):
        entry = lambda k: F.concat(json_string(k.cast("string")), F.lit(":"), canonical_json(F.element_at(c, k), kind.valueType))
        out = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys(c)), entry), ","), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = json_number(c.cast("double"))
    elif isinstance(kind, (T.BooleanType, T.IntegralType)):
        out = c.cast("string")
    else:
        out = json_string(c.cast("string"))
    return F.when(c.isNull(), F.lit("null")).otherwise(out)
