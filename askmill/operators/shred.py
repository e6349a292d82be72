"""Columnar shredding of nested records and the flat tables read back from it.

``shred`` turns every leaf of a nested schema into a column of (value, repetition level, definition
level) entries, the record format of columnar files: the repetition level says at which repeated
ancestor an entry continues, the definition level how much of its path is there. ``assemble`` rebuilds
the flat table of any repeated ancestor from those sequences alone; parents and children meet in the
ordinals that it recovers from the repetition levels.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "record_key"


@dataclass(frozen=True)
class Leaf:
    """A leaf path; ``steps`` are field names and "[]" for a list's elements."""

    steps: tuple[str, ...]
    type: T.DataType
    max_rep: int
    max_def: int

    @property
    def path(self) -> str:
        return ".".join(self.steps).replace(".[]", "[]")

    def slot_levels(self) -> list[int]:
        """For each repeated ancestor, the definition level from which an element stands in it."""
        levels, defined = [], 0
        for step in self.steps:
            defined += 1
            if step == "[]":
                levels.append(defined)
                defined += 1
        # a field adds one level when it is not null; a list element one for its slot, one for its value
        return levels


def leaves(schema: T.DataType, steps: tuple[str, ...] = (), rep: int = 0, defined: int = 0) -> list[Leaf]:
    """The leaf paths of a schema, depth first. Every node is optional."""
    if isinstance(schema, T.StructType):
        return [x for f in schema.fields for x in leaves(f.dataType, (*steps, f.name), rep, defined + 1)]
    if isinstance(schema, T.ArrayType):
        return leaves(schema.elementType, (*steps, "[]"), rep + 1, defined + 2)
    return [Leaf(steps, schema, rep, defined)]


def _text(value: Column, dtype: T.DataType) -> Column:
    """A leaf's value as a text from which it comes back exactly."""
    if isinstance(dtype, T.BinaryType):
        return F.hex(value)
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(value).cast("string")
    return value.cast("string")


def _value(text: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BinaryType):
        return F.unhex(text)
    if isinstance(dtype, T.TimestampType):
        return F.timestamp_micros(text.cast("bigint"))
    return text.cast(dtype)


def _entry(rep: Column, defined: int, value: Column) -> Column:
    return F.array(
        F.struct(rep.cast("int").alias("rep"), F.lit(defined).alias("def"), value.cast("string").alias("value"))
    )


def _levels(node: Column, schema: T.DataType, steps: tuple[str, ...], rep: Column, depth: int, defined: int) -> Column:
    """The entries that ``node`` contributes; ``defined`` is the level of its parent's presence."""
    absent = _entry(rep, defined, F.lit(None))
    if isinstance(schema, T.ArrayType):
        inner = F.flatten(
            F.transform(
                node,
                lambda x, i: _levels(
                    x, schema.elementType, steps[1:], F.when(i == 0, rep).otherwise(F.lit(depth + 1)), depth + 1, defined + 2
                ),
            )
        )
        empty = _entry(rep, defined + 1, F.lit(None))
        return F.when(node.isNull(), absent).when(F.size(node) == 0, empty).otherwise(inner)
    if isinstance(schema, T.StructType):
        field = schema[steps[0]]
        inner = _levels(node.getField(field.name), field.dataType, steps[1:], rep, depth, defined + 1)
        return F.when(node.isNull(), absent).otherwise(inner)
    return F.when(node.isNull(), absent).otherwise(_entry(rep, defined + 1, _text(node, schema)))


def shred(records: DataFrame, key: str = KEY, columns: list[str] | None = None) -> dict[str, DataFrame]:
    """One DataFrame (record_key, seq, rep, def, value) for each leaf path of the nested ``columns``.

    ``key`` must be unique and not null. All levels follow the standard three-level list encoding with
    every node optional, so a null list, an empty list, a null element and a null field stay distinct.
    Values are texts from which ``assemble`` gets them back exactly. Nothing is shuffled: the entries of a record come
    from expressions over its own row.
    """
    columns = columns or [c for c in records.columns if c != key]
    out = {}
    for name in columns:
        dtype = records.schema[name].dataType
        for leaf in leaves(T.StructType([T.StructField(name, dtype)])):
            # the record itself is always there, so that a top-level field starts from level 0
            sequence = _levels(F.col(f"`{name}`"), dtype, leaf.steps[1:], F.lit(0), 0, 0)
            out[leaf.path] = records.select(F.col(f"`{key}`").alias(KEY), F.posexplode(sequence).alias("seq", "e")).select(
                KEY, "seq", "e.rep", "e.def", "e.value"
            )
    return out


def assemble(shredded: dict[str, DataFrame], schema: T.StructType, ancestor: str) -> DataFrame:
    """The flat table of the repeated ``ancestor`` ("context[]", "context[].sentences[]").

    Columns: record_key, one ordinal ``i1``, ``i2``... for each repeated node down to the ancestor, and
    one column for each leaf under it that is not repeated further (named by the rest of its path, or
    ``value`` for a list of plain values), and ``present``, false for a null element. Ordinals count from
    0 in the lists as given, null elements included. Null and empty lists give no rows.

    The ordinals are running counts over the repetition levels: an entry starts a new element at level l
    where rep <= l, and a new parent where rep < l. Both are windows over the record's own entries in
    the order of ``seq``; a record is one row of the source, so the window is bounded by it.
    """
    depth = ancestor.count("[]")
    under = [x for x in leaves(schema) if x.path.startswith(ancestor) and x.max_rep == depth and x.path in shredded]
    deeper = [x for x in leaves(schema) if x.path.startswith(ancestor) and x.max_rep > depth and x.path in shredded]
    under = under or deeper[:1]
    keys = [KEY, *(f"i{k + 1}" for k in range(depth))]
    order = Window.partitionBy(KEY).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    parts = []
    for leaf in under:
        name = leaf.path[len(ancestor) :].lstrip(".") or "value"
        slots = leaf.slot_levels()
        rows = shredded[leaf.path].withColumns(
            {f"n{k}": F.sum((F.col("rep") <= k).cast("int")).over(order) for k in range(1, depth + 1)}
        )
        rows = rows.withColumns(
            {f"i{k}": F.col(f"n{k}") - F.max(F.when(F.col("rep") < k, F.col(f"n{k}"))).over(order) for k in range(1, depth + 1)}
        )
        rows = rows.where((F.col("def") >= slots[depth - 1]) & (F.col("rep") <= depth))
        value = F.when(F.col("def") == leaf.max_def, F.col("value")) if leaf.max_rep == depth else F.lit(None)
        parts.append(
            rows.select(
                *keys,
                F.lit(name).alias("field"),
                (F.col("def") > slots[depth - 1]).alias("present"),
                value.cast("string").alias("value"),
            )
        )
    names = [x.path[len(ancestor) :].lstrip(".") or "value" for x in under]
    long = parts[0]
    for more in parts[1:]:
        long = long.unionByName(more)
    picked = [
        _value(F.max(F.when(F.col("field") == n, F.col("value"))), leaf.type).alias(n)
        for n, leaf in zip(names, under, strict=True)
        if leaf.max_rep == depth
    ]
    return long.groupBy(*keys).agg(F.max("present").alias("present"), *picked)
