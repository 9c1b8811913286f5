"""Typed values over Spark columns, with missing kept apart from null.

A value whose type is known is a native column, so that filters reach the scan;
a union of types is a tagged struct.  SQL NULL in a native column means missing or
null, as ``null_is`` says; in a tagged one it means missing.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

SQL_TYPE = {"string": "string", "number": "double", "boolean": "boolean", "bigint": "decimal(38,0)"}
_PART = {"string": "s", "number": "n", "boolean": "b", "bigint": "i"}
ITEM = "struct<t:string,s:string,n:double,b:boolean,i:decimal(38,0)>"
TAGGED = "struct<t:string,s:string,n:double,b:boolean,i:decimal(38,0),m:array<struct<t:string,s:string,n:double,b:boolean,i:decimal(38,0)>>>"


class BigInt(int):
    """An integer literal of the bigint type."""


def tag_of(x) -> str:
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "boolean"
    if isinstance(x, (BigInt, Decimal)):
        return "bigint"
    if isinstance(x, (int, float)):
        return "number"
    if isinstance(x, str):
        return "string"
    raise TypeError(f"not a scalar: {x!r}")


def item_row(x) -> dict:
    """A scalar as a tagged item."""
    t = tag_of(x)
    row = {"t": t, "s": None, "n": None, "b": None, "i": None}
    if t != "null":
        row[_PART[t]] = {"string": str, "number": float, "boolean": bool, "bigint": lambda v: Decimal(int(v))}[t](x)
    return row


def tagged_row(x):
    """A Python attribute value as a tagged struct; a list becomes its items."""
    if isinstance(x, (list, tuple)):
        return {"t": "many", "s": None, "n": None, "b": None, "i": None, "m": [item_row(v) for v in x]}
    return {**item_row(x), "m": None}


@dataclass(frozen=True)
class Value:
    """col with its representation: ``tag`` for a native type, None for a tagged struct."""

    col: Column
    tag: str | None = None
    many: bool = False
    null_is: str = "missing"
    literal: bool = False

    # -- presence ---------------------------------------------------------
    def missing(self) -> Column:
        if self.literal or (self.tag is not None and self.null_is != "missing"):
            return F.lit(self.tag == "missing")
        return self.col.isNull()

    def is_null(self) -> Column:
        if self.tag == "null":
            return F.lit(True)
        if self.tag is not None:
            return self.col.isNull() if self.null_is == "null" else F.lit(False)
        return F.coalesce(self.col["t"] == "null", F.lit(False))

    def present(self) -> Column:
        return ~self.missing()

    # -- representations --------------------------------------------------
    def item(self) -> Column:
        """The value as a tagged item; SQL NULL if missing."""
        if self.tag is None:
            return F.when(self.col.isNotNull(), F.struct(*[self.col[p].alias(p) for p in "tsnbi"]))
        if self.tag in ("null", "missing"):
            return F.lit(None).cast(ITEM) if self.tag == "missing" else _item("null", None)
        made = _item(self.tag, self.col)
        if self.null_is == "null":
            return F.when(self.col.isNull(), _item("null", None)).otherwise(made)
        return F.when(self.col.isNotNull(), made)

    def plain(self) -> Column:
        """The value as one comparable text-free column: native, or its item."""
        return self.col if self.tag not in (None, "null", "missing") else self.item()

    # -- comparisons of expressions (never NULL) --------------------------
    def __eq__(self, other):
        return equal(self, lift(other))

    def __ne__(self, other):
        return ~equal(self, lift(other))

    def __lt__(self, other):
        return _ordered(self, lift(other), lambda c: c < 0)

    def __le__(self, other):
        return _ordered(self, lift(other), lambda c: c <= 0)

    def __gt__(self, other):
        return _ordered(self, lift(other), lambda c: c > 0)

    def __ge__(self, other):
        return _ordered(self, lift(other), lambda c: c >= 0)

    __hash__ = None


def _item(tag: str, col) -> Column:
    parts = [F.lit(tag).alias("t")]
    for t, p in _PART.items():
        parts.append((col if t == tag else F.lit(None)).cast(SQL_TYPE[t]).alias(p))
    return F.struct(*parts)


def literal(x) -> Value:
    t = tag_of(x)
    if t == "null":
        return Value(F.lit(None), "null", null_is="null", literal=True)
    if t == "bigint":
        return Value(F.lit(Decimal(int(x))).cast("decimal(38,0)"), t, literal=True)
    return Value(F.lit(x), t, literal=True)


MISSING = Value(None, "missing", literal=True)


def lift(x) -> Value:
    return x if isinstance(x, Value) else literal(x)


def native(col: Column, tag: str, many: bool = False, null_is: str = "missing") -> Value:
    return Value(col, tag, many, null_is)


def tagged(col: Column, many: bool = False) -> Value:
    return Value(col, None, many)


def _not_nan(v: Value) -> Column | None:
    """Only floating columns can hold NaN; the test costs nothing elsewhere."""
    return ~F.isnan(v.col.cast("double")) if v.tag == "number" and not v.literal else None


#: Where a comparison keeps a condition that is true for the same rows and that a scan understands.
_KEEPS = "_loom_keeps"


def keeping(cond: Column) -> Column:
    """A condition for rows to stay: unlike the value it may be null instead of false, and reaches the scan."""
    return cond.__dict__.get(_KEEPS, cond)


def equal(a: Value, b: Value) -> Column:
    """Strict equality of expressions: no coercion; missing equals missing, null equals null; NaN equals nothing."""
    simple = {a.tag, b.tag} <= set(SQL_TYPE)
    if a.many or b.many:
        return F.lit(False)
    if a.tag == "missing" or b.tag == "missing":
        return (b if a.tag == "missing" else a).missing() if a.tag != b.tag else F.lit(True)
    if a.tag == "null" or b.tag == "null":
        return (b if a.tag == "null" else a).is_null()
    if simple and a.tag == b.tag:
        if a.null_is == b.null_is and not a.literal and not b.literal:
            out = a.col.eqNullSafe(b.col)
        else:
            out = F.coalesce(a.col == b.col, F.lit(False))
        guard = _not_nan(a)
        if guard is not None and not b.literal:
            return out & F.coalesce(guard, F.lit(True))
        if a.literal or b.literal:
            out.__dict__[_KEEPS] = a.col == b.col
        return out
    if simple:
        if a.literal or b.literal or a.null_is != b.null_is:
            return F.lit(False)
        return a.col.isNull() & b.col.isNull()
    x, y = a.item(), b.item()
    return x.eqNullSafe(y) & ~F.coalesce(F.isnan(x["n"]), F.lit(False))


def _text(v: Value) -> Column:
    """Text that stands for a value of mixed comparisons."""
    if v.tag == "null":
        return F.lit("null")
    if v.tag in SQL_TYPE:
        text = _number_text(v.col) if v.tag == "number" else v.col.cast("string")
        return F.coalesce(text, F.lit("null"))
    c = v.item()
    return F.coalesce(c["s"], _number_text(c["n"]), c["b"].cast("string"), c["i"].cast("string"), F.lit("null"))


def _number_text(c: Column) -> Column:
    d = c.cast("double")
    return F.when((d == F.floor(d)) & (F.abs(d) < 1e15), d.cast("bigint").cast("string")).otherwise(d.cast("string"))


def compared(a: Value, b: Value) -> Column:
    """-1, 0 or 1: missing last; equal types by value; anything else by text."""
    if a.tag in SQL_TYPE and a.tag == b.tag and a.tag != "boolean":
        by_value = F.when(a.col < b.col, -1).when(a.col > b.col, 1).otherwise(0)
        if a.null_is == "null" or b.null_is == "null":
            by_value = F.when(a.is_null() | b.is_null(), _by_text(a, b)).otherwise(by_value)
    elif None in (a.tag, b.tag):
        x, y = a.item(), b.item()
        parts = _by_text(a, b)
        for p, t in (("s", "string"), ("n", "number"), ("i", "bigint")):
            parts = F.when((x["t"] == t) & (y["t"] == t), F.when(x[p] < y[p], -1).when(x[p] > y[p], 1).otherwise(0)).otherwise(parts)
        by_value = parts
    else:
        by_value = _by_text(a, b)
    ma, mb = a.missing(), b.missing()
    return F.when(ma & mb, 0).when(ma, 1).when(mb, -1).otherwise(by_value)


def _by_text(a: Value, b: Value) -> Column:
    x, y = _text(a), _text(b)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def _ordered(a: Value, b: Value, test) -> Column:
    # plain comparison when neither side can be missing or null: it reaches the scan
    if a.tag in ("number", "string", "bigint") and a.tag == b.tag and (a.literal or b.literal):
        if (a if b.literal else b).null_is == "never":
            return _plain_order(a.col, b.col, test)
    return F.coalesce(test(compared(a, b)), F.lit(False))


def _plain_order(x: Column, y: Column, test) -> Column:
    """The comparison that ``test`` makes of a three-way result, said directly."""
    signs = tuple(bool(test(k)) for k in (-1, 0, 1))
    return {(True, False, False): x < y, (True, True, False): x <= y, (False, False, True): x > y, (False, True, True): x >= y}[signs]


def order_parts(v: Value) -> list[Column]:
    """Columns whose ascending order is that of :func:`compared`."""
    if v.tag in ("null", "missing"):
        return []
    gone = F.when(v.missing(), 1).otherwise(0)
    if v.tag in SQL_TYPE:
        col = F.coalesce(v.col.cast("string"), F.lit("null")) if v.tag == "boolean" else v.col
        return [col] if v.null_is == "never" else [gone, col.isNull().cast("int"), col]
    c = v.item()
    return [gone, c["n"].isNull().cast("int"), c["n"], c["i"], _text(v)]


def same_value_key(v: Value) -> Column:
    """Identity for distinct, groups and joins: types never mix; null, missing and NaN equal themselves."""
    return v.plain()


def same_value(a: Value, b: Value) -> Column:
    """Join condition of two keys; hashable, so it plans as an equi-join."""
    if a.tag in SQL_TYPE and a.tag == b.tag:
        if a.null_is == "never" or b.null_is == "never" or a.null_is != b.null_is:
            return a.col == b.col
        return a.col.eqNullSafe(b.col)
    return a.item().eqNullSafe(b.item())


# -- predicates of selectors: a missing value fails every comparison -------------


def _elements(v: Value):
    """(array column, element Value maker) of a many-valued attribute."""
    if v.tag is not None:
        return v.col, lambda c: Value(c, v.tag, null_is="never")
    return v.col["m"], lambda c: Value(c, None)


def matches(op: str, a: Value, b: Value) -> Column:
    """Selector comparison: never NULL, false on missing; arrays match by any element, != by none."""
    if a.many:
        arr, make = _elements(a)
        if op == "!=":
            test = F.forall(arr, lambda c: ~_scalar_match("=", make(c), b))
        elif op == "*=":
            test = F.exists(arr, lambda c: _scalar_match("=", make(c), b))
        else:
            test = F.exists(arr, lambda c: _scalar_match(op, make(c), b))
        return F.coalesce(test, F.lit(False))
    return _scalar_match(op, a, b)


def _never(v: Value) -> bool:
    return v.literal or v.null_is == "never"


def _scalar_match(op: str, a: Value, b: Value) -> Column:
    if op in ("=", "!="):
        native_pair = a.tag in SQL_TYPE and a.tag == b.tag
        if native_pair and (op == "=" or (a.null_is != "null" and b.null_is != "null")):
            test = a.col == b.col if op == "=" else a.col != b.col
            guard = _not_nan(a)
            if guard is not None and not b.literal:
                test = test & guard if op == "=" else test | ~guard
            return test if _never(a) and _never(b) else F.coalesce(test, F.lit(False))
        if op == "=":
            if "missing" in (a.tag, b.tag):
                return F.lit(False)
            if a.tag == "null" or b.tag == "null":
                return (b if a.tag == "null" else a).is_null()
            return equal(a, b) & a.present() & b.present()
        return a.present() & b.present() & ~equal(a, b)
    if op in ("<", "<=", ">", ">="):
        if a.tag in SQL_TYPE and b.tag in SQL_TYPE:
            if a.tag != b.tag:
                return F.lit(False)
            x, y = a.col, b.col
        else:
            i, j = a.item(), b.item()
            return F.coalesce(_any_part(op, i, j), F.lit(False))
        test = _relation(op, x, y)
        return test if _never(a) and _never(b) else F.coalesce(test, F.lit(False))
    text = {"^=": "startswith", "$=": "endswith", "*=": "contains"}[op]
    x, y = _string(a), _string(b)
    if x is None or y is None:
        return F.lit(False)
    return F.coalesce(getattr(x, text)(y), F.lit(False))


def _any_part(op, i, j) -> Column:
    out = F.lit(False)
    for p, t in (("s", "string"), ("n", "number"), ("i", "bigint")):
        out = out | F.coalesce((i["t"] == t) & (j["t"] == t) & _relation(op, i[p], j[p]), F.lit(False))
    return out


def _relation(op, x, y) -> Column:
    return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def _string(v: Value):
    if v.tag == "string":
        return v.col
    return v.col["s"] if v.tag is None and not v.many else (v.col["s"] if v.tag is None else None)


def matches_regex(a: Value, pattern: str) -> Column:
    if a.many:
        arr, make = _elements(a)
        return F.coalesce(F.exists(arr, lambda c: F.coalesce(_string(make(c)).rlike(pattern), F.lit(False))), F.lit(False))
    s = _string(a)
    return F.lit(False) if s is None else F.coalesce(s.rlike(pattern), F.lit(False))


def java_regex(body: str, flags: str) -> str:
    """A regular expression of selectors in Java's dialect; ValueError for what has no counterpart."""
    if set(flags) - set("dgimsuvy") or len(set(flags)) != len(flags) or {"u", "v"} <= set(flags):
        raise ValueError(f"invalid flags {flags!r}")
    if "v" in flags:
        raise ValueError("the flag v has no counterpart here")
    out, i, in_class = [], 0, False
    while i < len(body):
        c = body[i]
        if c == "\\" and i + 1 < len(body):
            out.append("/" if body[i + 1] == "/" else body[i : i + 2])
            i += 2
            continue
        if in_class and c == "[":
            out.append("\\[")
        elif c == "$" and not in_class and "m" not in flags:
            out.append("\\z")
        else:
            out.append(c)
        if c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        i += 1
    inline = "".join(x for x in "ims" if x in flags)
    import re

    try:
        re.compile(body)
    except re.error as e:
        raise ValueError(str(e)) from e
    return (f"(?{inline})" if inline else "") + ("\\A" if "y" in flags else "") + "".join(out)
