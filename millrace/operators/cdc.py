"""Change data capture: change logs with images, idempotent apply, bootstrap and tail, schema versions, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def change_log(writes: DataFrame, key: str, value: str, order: list[str], deleted: str = "is_delete") -> DataFrame:
    """(lsn order columns, op, key, before, after): inserts, updates and deletes that a sequence of writes amounts to.

    before is the value that was live, after the value that is. A delete of a key that isn't live is no change.
    """
    w = Window.partitionBy(key).orderBy(*order)
    now = F.when(~F.col(deleted), F.col(value))
    moved = writes.select(*order, F.col(key).alias("pk"), F.lag(now).over(w).alias("before"), now.alias("after"), F.coalesce(F.lag(~F.col(deleted)).over(w), F.lit(False)).alias("was"), (~F.col(deleted)).alias("is"))
    op = F.when(~F.col("was") & F.col("is"), "insert").when(F.col("was") & F.col("is"), "update").when(F.col("was"), "delete")
    return moved.withColumn("op", op).where("op is not null").drop("was", "is")


def changes_since(changes: DataFrame, lsn: int, tbl: str | None = None) -> DataFrame:
    """Changes after `lsn`, of one table or all, in order."""
    own = changes.where(F.col("lsn") > lsn)
    return (own.where(F.col("tbl") == tbl) if tbl is not None else own).orderBy("lsn")


def apply_changes(changes: DataFrame, key: str = "pk") -> DataFrame:
    """(pk, value, lsn): the rows after all changes. The newest lsn of a key wins whatever the order of arrival, so a
    change that comes again or late does no harm; deleted rows are gone."""
    last = changes.groupBy(key).agg(F.max_by(F.struct("op", "after"), "lsn").alias("c"), F.max("lsn").alias("lsn"))
    return last.where("c.op <> 'delete'").select(key, F.col("c.after").alias("value"), "lsn")


def take_snapshot(changes: DataFrame, upto: int) -> DataFrame:
    """Rows as of `upto`, in the form of changes at that lsn, to start a copy from."""
    rows = apply_changes(changes.where(F.col("lsn") <= upto))
    return rows.select(F.lit(upto).cast("long").alias("lsn"), F.lit("insert").alias("op"), "pk", F.lit(None).cast(rows.schema["value"].dataType).alias("before"), F.col("value").alias("after"))


def bootstrap_and_tail(changes: DataFrame, cut: int) -> DataFrame:
    """A copy from a snapshot at `cut` and the changes after it."""
    tail = changes.where(F.col("lsn") > cut).select("lsn", "op", "pk", "before", "after")
    return apply_changes(take_snapshot(changes, cut).unionByName(tail))


def cursor(applied: DataFrame, old: int) -> int:
    """Where to go on after `applied`: the largest lsn among them, or the old cursor if there are none."""
    most = applied.agg(F.max("lsn")).first()[0]
    return old if most is None else max(old, most)


def reconcile(source: DataFrame, copy: DataFrame, key: str = "pk", value: str = "value") -> DataFrame:
    """(key, kind, source, copy): keys that are missing in the copy, extra there, or unequal; values compare as text."""
    s = source.select(key, F.col(value).cast("string").alias("source"), F.lit(True).alias("in_source"))
    c = copy.select(key, F.col(value).cast("string").alias("copy"), F.lit(True).alias("in_copy"))
    kind = F.when(F.col("in_copy").isNull(), "missing").when(F.col("in_source").isNull(), "extra").when(~F.col("source").eqNullSafe(F.col("copy")), "unequal")
    return s.join(c, key, "full_outer").select(key, kind.alias("kind"), "source", "copy").where("kind is not null")


def patch(before: Column, change: Column) -> Column:
    """A row map with a patch laid over it."""
    return F.map_concat(F.map_filter(before, lambda k, v: ~F.map_contains_key(change, k)), change)


def reject_rekeying(change: Column, before: Column, key: str) -> Column:
    """The patch, or an error if it gives the primary key another value."""
    moved = F.map_contains_key(change, F.lit(key)) & ~F.element_at(change, F.lit(key)).eqNullSafe(F.element_at(before, F.lit(key)))
    return F.when(moved, F.raise_error(F.lit("a patch can't change the primary key")).cast("map<string,string>")).otherwise(change)


def schema_versions(ddl: DataFrame) -> DataFrame:
    """(tbl, version, columns) from DDL rows (tbl, seq, ordinal, action, name, type, default): create and add give a column, drop
    takes one; each version is the array of (name, type, default) in force, numbered from 1 by seq. `ordinal` orders the
    columns of one step."""
    steps = ddl.groupBy("tbl").agg(F.array_sort(F.collect_list(F.struct("seq", "ordinal", "action", "name", "type", "default"))).alias("steps"))
    grow = lambda acc, s: F.when(s["action"] == "drop", F.filter(acc, lambda c: c["name"] != s["name"])).otherwise(F.concat(acc, F.array(F.struct(s["name"].alias("name"), s["type"].alias("type"), s["default"].alias("default")))))
    none = F.array().cast("array<struct<name:string,type:string,default:string>>")
    numbered = steps.select("tbl", "steps", F.explode(F.array_distinct(F.transform("steps", lambda s: s["seq"]))).alias("seq"))
    taken = numbered.withColumn("steps", F.filter("steps", lambda s: s["seq"] <= F.col("seq")))
    return taken.select("tbl", (F.col("seq") - F.element_at("steps", 1)["seq"] + 1).cast("int").alias("version"), F.aggregate("steps", none, grow).alias("columns"))


def read_at_version(rows: DataFrame, columns: list[tuple[str, str, str | None]]) -> DataFrame:
    """Dynamic rows (pk, fields: map of texts) in a schema version: missing fields get their default, dropped ones go."""
    field = lambda name, kind, default: F.coalesce(F.element_at("fields", F.lit(name)), F.lit(default)).cast(kind if kind != "any" else "string").alias(name)
    return rows.select("pk", *[field(*c) for c in columns if c[0] != "pk"])


def add_column(rows: DataFrame, name: str, kind: str, default) -> DataFrame:
    """Rows with a further column; rows that have no value of their own get the default, whenever they came."""
    own = F.col(name) if name in rows.columns else F.lit(None)
    return rows.withColumn(name, F.coalesce(own.cast(kind), F.lit(default).cast(kind)))


def union_versions(old: DataFrame, new: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Rows of two schema versions together: columns that one lacks are null, or have their default."""
    union = old.unionByName(new, allowMissingColumns=True)
    return union.fillna({k: v for k, v in defaults.items() if v is not None})
