"""Precision, recall and F1 of extracted answers, field by field.

The rules: scalars of an object count when they are required or the truth has
them, and so an optional value that only the prediction has is no error; lists
count as sets, when required or when the truth has elements; lists of objects
count as sets of whole objects, and each field as the set of its values over
all objects; a list against nothing doesn't count. Scalars compare with 1
equal to 1.0 and true, containers as JSON text with ordered keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..spec import MultipleSpec, NestedSpec, SimpleSpec, Spec, Variable
from .results import canonical_json


def _token(c: Column, kind: T.DataType) -> Column:
    """A value as comparable text; null for what counts as missing."""
    if isinstance(kind, T.ArrayType):
        return F.when(F.size(c) > 0, F.to_json(c))
    if isinstance(kind, T.StructType):
        return canonical_json(c, kind)
    if isinstance(kind, T.StringType):
        return F.when(c != "", F.concat(F.lit("s"), c))
    return c.cast("double").cast("string")


def _sets(t: Column, p: Column, path: str, counted: Column) -> Column:
    """One (field, tp, fp, fn), null where it isn't counted."""
    t, p = (F.array_distinct(F.filter(x, lambda v: v.isNotNull())) for x in (t, p))
    tp = F.size(F.array_intersect(t, p))
    return F.when(
        F.coalesce(counted, F.lit(False)),
        F.struct(F.lit(path).alias("field"), tp.cast("bigint").alias("tp"), (F.size(p) - tp).cast("bigint").alias("fp"), (F.size(t) - tp).cast("bigint").alias("fn")),
    )


def _present(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        return c.isNotNull() & (F.size(c) > 0)
    return c.isNotNull() & (c != "") if isinstance(kind, T.StringType) else c.isNotNull()


def _simple(t: Column, p: Column, variables: tuple[Variable, ...], prefix: tuple[str, ...], required: dict[str, bool]) -> list[Column]:
    out = []
    both = t.isNotNull() & p.isNotNull()
    for v in variables:
        path = ".".join((*prefix, v.name))
        need = F.lit(required.get(path, False))
        a, b, kind = t[v.name], p[v.name], v.spark_type
        if v.is_list:
            one = kind.elementType
            tokens = [F.transform(x, lambda i: _token(i, one)) for x in (a, b)]
            out.append(_sets(*tokens, path, both & a.isNotNull() & b.isNotNull() & (need | (F.size(a) > 0))))
        else:
            out.append(_sets(F.array(_token(a, kind)), F.array(_token(b, kind)), path, both & (need | _present(a, kind))))
    return out


def _values(items: Column, v: Variable) -> Column:
    """Values of a scalar variable in all objects."""
    return F.transform(items, lambda i: _token(i[v.name], v.spark_type))


def _lists(items: Column, v: Variable) -> Column:
    """Lists of a list variable in all objects, those that aren't null."""
    return F.transform(F.filter(items, lambda i: i[v.name].isNotNull()), lambda i: F.when(F.size(i[v.name]) > 0, F.to_json(i[v.name])))


def _objects(t: Column, p: Column, variables: tuple[Variable, ...], kind: T.StructType, path: tuple[str, ...], required: dict[str, bool]) -> list[Column]:
    both = t.isNotNull() & p.isNotNull()
    some = both & ((F.size(t) > 0) | (F.size(p) > 0))
    whole = [F.transform(x, lambda i: canonical_json(i, kind)) for x in (t, p)]
    name = ".".join(path)
    out = [_sets(*whole, name, some & (F.lit(required.get(name, False)) | (F.size(t) > 0)))]
    for v in variables:
        field = ".".join((*path, v.name))
        need = required.get(field, True)
        if not v.is_list:
            tokens = [_values(x, v) for x in (t, p)]
            out.append(_sets(*tokens, field, some & (F.lit(need) | (F.size(F.filter(tokens[0], lambda x: x.isNotNull())) > 0))))
        else:
            # lists inside objects: as sets of whole lists, at the same path
            tokens = [_lists(x, v) for x in (t, p)]
            out.append(_sets(*tokens, field, some & (F.lit(need) | (F.size(tokens[0]) > 0))))
    return out


def _fields(t: Column, p: Column, spec: Spec, path: tuple[str, ...], required: dict[str, bool]) -> list[Column]:
    if isinstance(spec, SimpleSpec):
        return _simple(t, p, spec.variables, path, required)
    if isinstance(spec, NestedSpec):
        inner = path if path else (spec.container,)
        a, b = (t, p) if path else (t[spec.container], p[spec.container])
        return _objects(a, b, spec.variables, spec.item_type, inner, required)
    assert isinstance(spec, MultipleSpec)
    return [f for n, s in spec.specs for f in _fields(t[n], p[n], s, (*path, n), required)]


def counts(pairs: DataFrame, spec: Spec, truth: str = "expected", found: str = "extracted", strict: bool = True) -> DataFrame:
    """(field, tp, fp, fn) for each row of pairs and each field that counts. strict: paths below `multiple` miss the required map, as published behaviour has it."""
    fields = F.array(*_fields(F.col(truth), F.col(found), spec, (), spec.required(strict=strict)))
    return pairs.select(F.explode(F.filter(fields, lambda f: f.isNotNull())).alias("f")).select("f.*")


def micro_average(counted: DataFrame) -> DataFrame:
    """(field, tp, fp, fn, precision, recall, f1) over all rows; 0 where there is nothing to divide by."""
    total = counted.groupBy("field").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return total.select("field", "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def evaluate(extracted: DataFrame, expected: DataFrame, spec: Spec, key: str, strict: bool = True) -> DataFrame:
    """Metrics of extracted (key, extracted) against expected (key, expected), over the keys that both have."""
    pairs = expected.select(key, "expected").join(extracted.select(key, "extracted"), key)
    return micro_average(counts(pairs, spec, strict=strict))
