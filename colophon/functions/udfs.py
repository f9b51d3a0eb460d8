"""What Spark has no function for: composition of marks, BLAKE2b and canonical JSON, on Arrow batches."""

from __future__ import annotations

import hashlib
import json
import math
import unicodedata

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@pandas_udf(StringType())
def blake2b(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else hashlib.blake2b(t.encode()).hexdigest())


def _number(x: float) -> str:
    """Shortest round-trip digits in the notation that RFC 8785 takes from ECMAScript."""
    if not math.isfinite(x):
        raise ValueError("no JSON for non-finite numbers")
    if x == 0:
        return "0"
    sign, x = ("-", -x) if x < 0 else ("", x)
    mantissa, _, exponent = f"{x!r}e0".partition("e") if "e" not in repr(x) else repr(x).partition("e")
    whole, _, part = mantissa.partition(".")
    exponent = int(exponent.rstrip("e0") or 0) if exponent.endswith("e0") else int(exponent)
    digits = (whole + part).lstrip("0")
    point = len(whole) + exponent - (len(whole + part) - len((whole + part).lstrip("0")))
    digits = digits.rstrip("0")
    n = len(digits)
    if n <= point <= 21:
        body = digits + "0" * (point - n)
    elif 0 < point <= 21:
        body = f"{digits[:point]}.{digits[point:]}"
    elif -6 < point <= 0:
        body = "0." + "0" * -point + digits
    else:
        e = point - 1
        body = digits[0] + (f".{digits[1:]}" if n > 1 else "") + f"e{'+' if e > 0 else '-'}{abs(e)}"
    return sign + body


def canonical_json(value) -> str:
    """RFC 8785: members sorted by UTF-16 units, no white space, ECMAScript numbers."""
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    if isinstance(value, int):
        return str(value) if abs(value) < 1 << 53 else _number(float(value))
    if isinstance(value, float):
        return _number(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, list):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be"))) + "}"


@pandas_udf(StringType())
def jcs(text: pd.Series) -> pd.Series:
    """Canonical form of a JSON text; null if it can't be read or has no canonical form."""

    def one(t):
        try:
            return None if t is None else canonical_json(json.loads(t))
        except ValueError:
            return None

    return text.map(one)
