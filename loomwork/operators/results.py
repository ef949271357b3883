"""Cleaned answers to rows, and back from chunks to records.

Merging: scalars by majority (ties go to the value that comes first), lists
and nested items one after another in the order of the chunks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SourceError
from ..spec import MultipleSpec, NestedSpec, SimpleSpec, Spec, Variable


def _wanted(df: DataFrame, column: str) -> None:
    if column not in df.columns:
        raise SourceError(f"no column {column!r}; there are {', '.join(df.columns)}", column=column)


def _any_value(c: Column, variables: tuple[Variable, ...]) -> Column:
    return c.isNotNull()


def explode(df: DataFrame, spec: Spec, column: str = "extracted") -> DataFrame:
    """A row for each item of a cleaned answer: fields become columns, lists stay lists, rows without an answer go.

    Of a `multiple` spec: rows of all parts, columns prefixed with the part's
    name, and schema_name. Parts may be wrapped in their container or not.
    """
    _wanted(df, column)
    rest = [F.col(f"`{c}`") for c in df.columns if c != column]
    if isinstance(spec, SimpleSpec):
        return df.where(F.col(column).isNotNull()).select(*rest, *[F.col(column)[v.name].alias(v.name) for v in spec.variables])
    if isinstance(spec, NestedSpec):
        items = df.select(*rest, F.explode(_items(df, column, spec)).alias("_item")).where("_item is not null")
        return items.select(*rest, *[F.col("_item")[v.name].alias(v.name) for v in spec.variables])
    assert isinstance(spec, MultipleSpec)
    inner = df.schema[column].dataType
    parts = []
    for name, s in spec.specs:
        one = df.withColumn("_part", F.col(column)[name])
        if isinstance(s, NestedSpec) and isinstance(inner[name].dataType, T.ArrayType):
            one = one.withColumn("_part", F.struct(F.col("_part").alias(s.container)))
        got = explode(one.select(*rest, "_part"), s, "_part")
        made = [c for c in got.columns if c not in df.columns]
        parts.append(got.select(*rest, *[F.col(f"`{c}`").alias(c if c == "schema_name" else f"{name}_{c}") for c in made]).withColumn("schema_name", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _items(df: DataFrame, column: str, spec: NestedSpec) -> Column:
    c = F.col(column)[spec.container]
    kind = df.schema[column].dataType[spec.container].dataType
    return c if isinstance(kind, T.ArrayType) else F.when(c.isNotNull(), F.array(c))


def majority(df: DataFrame, by: list[str], value: Column, order: str, name: str) -> DataFrame:
    """(by..., name): the most frequent value that isn't null, the earliest of equals. Two levels of partial aggregation, no list is collected."""
    return (
        df.select(*by, value.alias("_v"), F.col(order).alias("_o"))
        .where("_v is not null")
        .groupBy(*by, "_v")
        .agg(F.count("*").alias("_n"), F.min("_o").alias("_f"))
        .groupBy(*by)
        .agg(F.max_by("_v", F.struct(F.col("_n"), (-F.col("_f")).alias("_f"))).alias(name))
    )


def in_order(c: Column, order: str) -> Column:
    """Aggregate: all elements of arrays, rows in the given order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), c.alias("x"))))
    return F.flatten(F.transform(F.filter(rows, lambda r: r["x"].isNotNull()), lambda r: r["x"]))


def _vote(c: Column, order: str) -> Column:
    """Aggregate for the majority within a group that is aggregated with others: the values of a group are the answers of one record's chunks, so they are few."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), c.alias("x"))))
    values = F.transform(F.filter(rows, lambda r: r["x"].isNotNull()), lambda r: r["x"])
    distinct = F.array_distinct(values)
    counted = F.transform(distinct, lambda v, i: F.struct(F.size(F.filter(values, lambda w: w == v)).alias("n"), (-i).alias("f"), v.alias("x")))
    return F.array_max(F.transform(counted, lambda r: F.struct(r["n"], r["f"])))["f"], distinct


def _merged(answer: Column, spec: Spec, order: str) -> Column:
    if isinstance(spec, SimpleSpec):
        fields = []
        for v in spec.variables:
            c = answer[v.name]
            if v.is_list:
                fields.append(in_order(c, order).alias(v.name))
            else:
                at, distinct = _vote(c, order)
                fields.append(F.get(distinct, (-at).cast("int")).alias(v.name))
        return F.struct(*fields)
    if isinstance(spec, NestedSpec):
        return F.struct(in_order(answer[spec.container], order).alias(spec.container))
    assert isinstance(spec, MultipleSpec)
    return F.struct(*[_merged(answer[n], s, order).alias(n) for n, s in spec.specs])


def _merged_unwrapped(answer: Column, spec: MultipleSpec, order: str) -> Column:
    fields = []
    for n, s in spec.specs:
        if isinstance(s, NestedSpec):
            fields.append(in_order(answer[n], order).alias(n))
        elif isinstance(s, MultipleSpec):
            fields.append(_merged_unwrapped(answer[n], s, order).alias(n))
        else:
            fields.append(_merged(answer[n], s, order).alias(n))
    return F.struct(*fields)


def merge(df: DataFrame, spec: Spec, by: str = "record_id", column: str = "extracted", order: str = "chunk_id") -> DataFrame:
    """(by, column): the answers of each record's chunks made one, in one shuffle. Chunks without an answer don't count; a null `by` is no record."""
    _wanted(df, column)
    one = _merged_unwrapped(F.col(column), spec, order) if isinstance(spec, MultipleSpec) and _unwrapped(df, column, spec) else _merged(F.col(column), spec, order)
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(one.alias(column))


def _unwrapped(df: DataFrame, column: str, spec: MultipleSpec) -> bool:
    kind = df.schema[column].dataType
    return any(isinstance(s, NestedSpec) and isinstance(kind[n].dataType, T.ArrayType) for n, s in spec.specs) or all(not isinstance(s, NestedSpec) for _, s in spec.specs)


def with_metadata(results: DataFrame, metadata: DataFrame, key: str = "chunk_id") -> DataFrame:
    """results with the columns of metadata that they lack; what has no result stays out."""
    extra = [c for c in metadata.columns if c == key or c not in results.columns]
    return results.join(metadata.select(*extra), key, "left")


def canonical_json(c: Column, kind: T.DataType) -> Column:
    """JSON text with the keys of objects in order, at every depth."""

    def ordered(x: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StructType):
            return F.struct(*[ordered(x[f.name], f.dataType).alias(f.name) for f in sorted(t.fields, key=lambda f: f.name)])
        if isinstance(t, T.ArrayType):
            return F.transform(x, lambda i: ordered(i, t.elementType))
        return x

    return F.to_json(ordered(c, kind), {"ignoreNullFields": "false"})
