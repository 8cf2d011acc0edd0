"""JSON operators over JSON text, compiled to VARIANT expressions.

Results are text: ``get`` and ``path`` give compact JSON with sorted keys, ``get_text`` and ``path_text`` unquoted text. A
missing member and a JSON null are SQL NULL; malformed JSON raises.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

_TYPE = {str: "STRING", bool: "BOOLEAN"}


def step(key: str | int) -> str:
    return f"[{key}]" if isinstance(key, int) else '["' + key.replace("\\", "\\\\").replace('"', '\\"') + '"]'


def path_of(text: str) -> str | None:
    """'{a,b,0}' as a VARIANT path; digits are array positions; None for an empty path."""
    parts = [p.strip() for p in text.strip().strip("{}").split(",") if p.strip()]
    return "$" + "".join(step(int(p) if p.isdigit() else p) for p in parts) if parts else None


def _at(doc: Column, path: str | None, kind: str) -> Column:
    return F.try_variant_get(F.parse_json(doc), path, kind) if path else F.lit(None).cast("string" if kind == "string" else "variant")


def get(doc: Column, key: str | int) -> Column:
    return path(doc, "$" + step(key))


def get_text(doc: Column, key: str | int) -> Column:
    return path_text(doc, "$" + step(key))


def path(doc: Column, where: str | None) -> Column:
    where = path_of(where) if where and not where.startswith("$") else where
    return F.nullif(F.to_json(_at(doc, where, "variant")), F.lit("null"))


def path_text(doc: Column, where: str | None) -> Column:
    where = path_of(where) if where and not where.startswith("$") else where
    return _at(doc, where, "string")


def _member(doc: Column, path: Column, text: bool) -> Column:
    """A path known only to each row; the variant functions take one from a column."""
    found = F.try_variant_get(F.parse_json(doc), path, "string" if text else "variant")
    return found if text else F.nullif(F.to_json(found), F.lit("null"))


def _quoted(key: Column) -> Column:
    return F.concat(F.lit('["'), F.replace(F.replace(key, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"]'))


def get_dynamic(doc: Column, key: Column, whole: bool, text: bool = False) -> Column:
    """``get`` with a key for each row: an array position where ``whole``, else a member's name."""
    where = F.concat(F.lit("$["), key.cast("string"), F.lit("]")) if whole else F.concat(F.lit("$"), _quoted(key.cast("string")))
    return _member(doc, where, text)


def path_dynamic(doc: Column, where: Column, text: bool = False) -> Column:
    """``path`` with a '{a,b,0}' for each row."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(F.trim(where), r"^[{]+|[}]+$", ""), ","), F.trim), lambda p: p != "")
    steps = F.transform(parts, lambda p: F.when(F.regexp_like(p, F.lit("^[0-9]+$")), F.concat(F.lit("["), p, F.lit("]"))).otherwise(_quoted(p)))
    return _member(doc, F.when(F.size(parts) > 0, F.concat(F.lit("$"), F.array_join(steps, ""))), text)


def within(doc: str, needle: str) -> bool:
    """Literal @> literal."""
    return _within(json.loads(doc), json.loads(needle))


def has_key(doc: Column, key: str | Column) -> Column:
    """An object's top-level member, or a string element of an array; false for scalars."""
    items = F.try_variant_get(F.parse_json(doc), "$", "array<variant>")
    inside = F.exists(items, lambda x: (F.schema_of_variant(x) == "STRING") & (x.try_cast("string") == key))
    return F.when(doc.isNotNull(), F.coalesce(F.array_contains(F.json_object_keys(doc), key), F.lit(False)) | F.coalesce(inside, F.lit(False)))


def _contains(v: Column, needle) -> Column:
    """Recursive containment of a literal: objects by member, arrays in any order, scalars by type and value."""
    if isinstance(needle, dict):
        ok = F.schema_of_variant(v).startswith("OBJECT")
        for k, x in needle.items():
            ok = ok & F.coalesce(_contains(F.try_variant_get(v, "$" + step(k), "variant"), x), F.lit(False))
        return F.coalesce(ok, F.lit(False))
    items = v.try_cast("array<variant>")
    if isinstance(needle, list):
        ok = F.schema_of_variant(v).startswith("ARRAY")
        for x in needle:
            ok = ok & F.coalesce(_any(items, x), F.lit(False))
        return F.coalesce(ok, F.lit(False))
    return F.coalesce(_scalar(v, needle), F.lit(False)) | F.coalesce(_any(items, needle), F.lit(False))


def _any(items: Column, x) -> Column:
    def one(i: Column) -> Column:
        return _contains(i, x) if isinstance(x, dict | list) else F.coalesce(_scalar(i, x), F.lit(False))

    return F.exists(items, one)


def _scalar(v: Column, x) -> Column:
    kind = F.schema_of_variant(v)
    if x is None:
        return kind == "VOID"
    if isinstance(x, bool | str):
        return (kind == _TYPE[type(x)]) & (v.try_cast("string") == (str(x).lower() if isinstance(x, bool) else x))
    if isinstance(x, int):
        return (kind == "BIGINT") & (v.try_cast("bigint") == x)
    return (kind.startswith("DECIMAL") | (kind == "DOUBLE")) & (v.try_cast("double") == x)


def contains(doc: Column, needle: str) -> Column:
    """doc @> needle, the needle a literal JSON text; null for a null doc."""
    return F.when(doc.isNotNull(), _contains(F.parse_json(doc), json.loads(needle)))


def _within(a, b) -> bool:
    if isinstance(b, dict):
        return isinstance(a, dict) and all(k in a and _within(a[k], v) for k, v in b.items())
    if isinstance(b, list):
        return isinstance(a, list) and all(any(_within(x, y) for x in a) for y in b)
    if isinstance(a, list):
        return any(not isinstance(x, dict | list) and _within(x, b) for x in a)
    return type(a) is type(b) and a == b


def contains_dynamic(doc: Column, needle: Column) -> Column:
    """doc @> needle with a needle for each row, the one case without a built-in form: an Arrow-batched function."""
    import pandas as pd

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else _within(json.loads(x), json.loads(y)) for x, y in zip(a, b, strict=True)], dtype=object)

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "boolean")(doc, needle)
