"""Statements to lazy DataFrames. Only names and types are settled here; Catalyst plans the rest."""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemill.functions import json as J
from lakemill.operators import relops as R
from lakemill.plans.dialect import ParseError, Select
from lakemill.plans.errors import ShapeError

_BINARY = {"=": operator.eq, "<>": operator.ne, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "and": operator.and_, "or": operator.or_, "+": operator.add, "-": operator.sub, "*": operator.mul}
_AGGREGATE: dict[str, Callable[[Column], Column]] = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}


def _literal(e) -> object:
    if e[0] != "lit":
        raise ParseError("a literal is needed here")
    return e[1]


def column(e, df: DataFrame | None = None) -> Column:
    """The Column of an expression; ``df`` tells the types that settle what / means."""
    op = e[0]
    if op == "col":
        return F.col(e[1])
    if op == "lit":
        return F.lit(e[1]).cast("long") if type(e[1]) is int else F.lit(e[1])
    if op == "agg":
        return F.count(F.lit(1)) if e[2] is None else _AGGREGATE[e[1]](column(e[2], df))
    if op == "not":
        return ~column(e[1], df)
    if op == "isnull":
        return column(e[1], df).isNull()
    if op == "in":
        own = column(e[1], df)
        return own.isin(*[column(x, df) for x in e[2]])
    if op == "between":
        return column(e[1], df).between(column(e[2], df), column(e[3], df))
    if op == "like":
        return F.like(column(e[1], df), column(e[2], df), F.lit("\x01"))
    if op == "case":
        out = reduce(lambda c, arm: c.when(column(arm[0], df), column(arm[1], df)), e[1], F)
        return out if e[2] is None else out.otherwise(column(e[2], df))
    if op in ("->", "->>", "#>", "#>>", "?") and e[2][0] != "lit":
        other = column(e[2], df)
        if op == "?":
            return J.has_key(column(e[1], df), other.cast("string"))
        if op in ("->", "->>"):
            whole = df is not None and isinstance(df.select(other.alias("k")).schema[0].dataType, T.IntegralType)
            return J.get_dynamic(column(e[1], df), other, whole, text=op == "->>")
        return J.path_dynamic(column(e[1], df), other, text=op == "#>>")
    if op in ("->", "->>"):
        return (J.get if op == "->" else J.get_text)(column(e[1], df), _literal(e[2]))
    if op in ("#>", "#>>"):
        return (J.path if op == "#>" else J.path_text)(column(e[1], df), str(_literal(e[2])))
    if op == "?":
        return J.has_key(column(e[1], df), str(_literal(e[2])))
    if op in ("@>", "<@"):
        doc, needle = (e[1], e[2]) if op == "@>" else (e[2], e[1])
        if doc[0] == needle[0] == "lit":
            return F.lit(J.within(doc[1], needle[1]))
        return J.contains(column(doc, df), needle[1]) if needle[0] == "lit" else J.contains_dynamic(column(doc, df), column(needle, df))
    a, b = column(e[1], df), column(e[2], df)
    if op == "/":
        whole = df is None or all(isinstance(f.dataType, T.IntegralType) for f in df.select(a.alias("a"), b.alias("b")).schema)
        return F.call_function("div", a, b) if whole else _float_division(a, b)
    return _BINARY[op](a, b)


def _float_division(a: Column, b: Column) -> Column:
    """IEEE: a zero divisor gives infinities or NaN."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a == 0, float("nan"))
    return F.when(b == 0, by_zero).otherwise(a / F.nullif(b, F.lit(0.0)))


def _has_aggregate(e) -> bool:
    return isinstance(e, tuple | list) and (len(e) > 0 and e[0] == "agg" or any(_has_aggregate(x) for x in e))


def _renamed(e, of: dict):
    """``e`` with group keys and aggregates replaced by the columns that hold them."""
    if isinstance(e, tuple) and repr(e) in of:
        return ("col", of[repr(e)])
    return type(e)(_renamed(x, of) for x in e) if isinstance(e, tuple | list) else e


def _aggregates(e, found: list) -> None:
    if isinstance(e, tuple) and e and e[0] == "agg":
        if e not in found:
            found.append(e)
    elif isinstance(e, tuple | list):
        for x in e:
            _aggregates(x, found)


def _as_grouped(e, keys: list):
    """``e`` with columns spelled as the group keys spell them: with a table's name or without."""
    if isinstance(e, tuple) and (e in keys or e[:1] in (("agg",), ("lit",))):
        return e
    if isinstance(e, tuple) and e[:1] == ("col",):
        own = e[1].split(".")
        same = [k for k in keys if k[0] == "col" and k[1].split(".")[-1] == own[-1] and (len(own) == 1) != ("." not in k[1])]
        return same[0] if len(same) == 1 else e
    return type(e)(_as_grouped(x, keys) for x in e) if isinstance(e, tuple | list) else e


def _ungrouped(e, keys: list) -> str | None:
    """The first column that is neither under a group key nor under an aggregate."""
    if not isinstance(e, tuple | list) or e in keys or (isinstance(e, tuple) and e[:1] in (("agg",), ("lit",))):
        return None
    if isinstance(e, tuple) and e[:1] == ("col",):
        return e[1]
    return next((x for x in (_ungrouped(y, keys) for y in e) if x), None)


def _named(e, alias: str | None, k: int) -> str:
    if alias:
        return alias
    if e[0] == "col":
        return e[1].split(".")[-1]
    if e[0] == "agg":
        return f"{e[1].upper()}({'*' if e[2] is None else e[2][1] if e[2][0] == 'col' else 'expr'})"
    return f"?column?{k}"


def _sides(e, alias: str, own: set[str]) -> set[bool]:
    """The sides of a join that ``e`` names: True is the side of the table ``alias`` with the columns ``own``."""
    if isinstance(e, tuple) and e[:1] == ("col",):
        *of, name = e[1].lower().split(".")
        return {of[0] == alias.lower() if of else name in own}
    return set().union(*(_sides(x, alias, own) for x in e)) if isinstance(e, tuple | list) else set()


def _conjuncts(e) -> list:
    return _conjuncts(e[1]) + _conjuncts(e[2]) if e[0] == "and" else [e]


def _arms(e, is_key: Callable[[tuple], bool]) -> list | None:
    """Conditions of which each holds a key, an equality between the sides, and that are together ``e``; None where there are none."""
    own = _conjuncts(e)
    if any(map(is_key, own)):
        return [e]
    if e[0] == "or":
        if any(is_key(x) and x in _conjuncts(e[2]) for x in _conjuncts(e[1])):
            return [e]  # Catalyst takes a common key out of an OR
        a, b = _arms(e[1], is_key), _arms(e[2], is_key)
        return a + b if a and b else None
    for k, x in enumerate(own if len(own) > 1 else []):
        if arms := _arms(x, is_key):
            return [reduce(lambda a, b: ("and", a, b), own[:k] + own[k + 1 :], arm) for arm in arms]
    return None


def source(s: Select, table: Callable[[str], DataFrame]) -> DataFrame:
    """FROM: joins left-deep as written; USING keeps both copies."""
    df, left = None, []
    for kind, name, alias, on, using in s.source:
        other = table(name).alias(alias)
        if df is None:
            df = other
        elif using:
            owner = lambda c: next(a for a, cols in left if c in cols)
            df = R.join(df, other, reduce(operator.and_, [F.col(f"{owner(c)}.{c}") == F.col(f"{alias}.{c}") for c in using]), kind)
        else:
            types = df.crossJoin(other) if on is not None else None  # never run: its schema settles what / means
            own = {n.lower() for n in other.columns}
            is_key = lambda e: e[0] == "=" and sorted(map(tuple, (_sides(x, alias, own) for x in e[1:]))) == [(False,), (True,)]  # noqa: B023, E731
            arms = on and _arms(on, is_key) or []
            if len(arms) > 1:
                df = R.join_any(df, other, [column(e, types) for e in arms], kind)
            else:
                df = R.join(df, other, None if on is None else column(on, types), kind)
        left.append((alias, other.columns))
    return df


def block(s: Select, table: Callable[[str], DataFrame]) -> DataFrame:
    df = source(s, table)
    if s.where is not None:
        df = df.where(column(s.where, df))
    items = s.items
    order = s.order if not s.combined else []
    if items is not None:
        named = [(e, _named(e, a, k)) for k, (e, a) in enumerate(items, 1)]
        by_name = {n: e for e, n in named}
        order = [(by_name.get(e[1], e) if e[0] == "col" else e, down) for e, down in order]
    if s.group or s.having is not None or items is not None and any(_has_aggregate(e) for e, _ in items):
        if items is None:
            raise ParseError("* can't be grouped")
        for e, n in named:
            if loose := _ungrouped(_as_grouped(e, s.group), s.group):
                raise ShapeError(f"{loose} in {n} is neither in GROUP BY nor in an aggregate")
        named, order = [(_as_grouped(e, s.group), n) for e, n in named], [(_as_grouped(e, s.group), down) for e, down in order]
        having = _as_grouped(s.having, s.group)
        found: list = []
        _aggregates([e for e, _ in named] + [having] + [e for e, _ in order], found)
        of = {repr(g): f"__g{k}" for k, g in enumerate(s.group)} | {repr(a): f"__a{k}" for k, a in enumerate(found)}
        aggs = [column(a, df).alias(of[repr(a)]) for a in found]
        keys = [column(g, df).alias(of[repr(g)]) for g in s.group]
        df = df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()
        named, order = [(_renamed(e, of), n) for e, n in named], [(_renamed(e, of), down) for e, down in order]
        if s.having is not None:
            df = df.where(column(_renamed(having, of), df))
    keys = [column(e, df).desc_nulls_last() if down else column(e, df).asc_nulls_first() for e, down in order]
    if items is None:
        out = df.orderBy(*keys) if keys else df
        out = out.distinct() if s.distinct else out
    elif s.distinct and keys:
        own = {repr(e): n for e, n in named}
        if all(repr(e) in own for e, _ in order):
            out = df.select(*[column(e, df).alias(n) for e, n in named]).distinct()
            out = out.orderBy(*[F.col(own[repr(e)]).desc_nulls_last() if down else F.col(own[repr(e)]).asc_nulls_first() for e, down in order])
        else:
            hidden = [(F.max if down else F.min)(f"__o{k}").alias(f"__o{k}") for k, (_, down) in enumerate(order)]
            out = df.select(*[column(e, df).alias(n) for e, n in named], *[column(e, df).alias(f"__o{k}") for k, (e, _) in enumerate(order)])
            out = out.groupBy(*[n for _, n in named]).agg(*hidden)
            out = out.orderBy(*[F.col(f"__o{k}").desc_nulls_last() if down else F.col(f"__o{k}").asc_nulls_first() for k, (_, down) in enumerate(order)]).select(*[n for _, n in named])
    else:
        out = (df.orderBy(*keys) if keys else df).select(*[column(e, df).alias(n) for e, n in named])
        out = out.distinct() if s.distinct else out
    return out


def select(s: Select, table: Callable[[str], DataFrame]) -> DataFrame:
    df = block(s, table)
    for op, all_, other in s.combined:
        right = block(other, table)
        if op == "union":
            df = R.union(df, right, all_)
        elif op == "intersect":
            df = df.intersectAll(right) if all_ else R.intersect(df, right)
        else:
            df = df.exceptAll(right) if all_ else R.except_(df, right)
    if s.combined and s.order:
        df = df.orderBy(*[column(e, df).desc_nulls_last() if down else column(e, df).asc_nulls_first() for e, down in s.order])
    return R.limit(df, s.limit, s.offset)
