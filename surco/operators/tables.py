"""Keyed tables: latest rows, upserts, deletes and updates as new snapshots.

Every function returns the new state of a table from the old state and the
changes. Winners per key come from aggregates, which combine on the map side,
so a key with very many changes is reduced before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# ---- latest rows ----------------------------------------------------------

def _extreme(df: DataFrame, pick, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows compare by `order`, then by their other columns, so ties are settled."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(pick(F.struct(*order, *rest)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest `order` per key."""
    return _extreme(df, F.max, keys, order)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the least `order` per key."""
    return _extreme(df, F.min, keys, order)


def latest_non_null(df: DataFrame, keys: Sequence[str], column: str, order: Sequence[str]) -> DataFrame:
    """Latest present value of a column per key; keys without one drop out."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(*keys)
        .agg(F.max_by(column, F.struct(*order)).alias(column))
    )


def last_by_role(df: DataFrame, keys: Sequence[str], role: str, wanted: str, values: Sequence[str],
                 order: Sequence[str]) -> DataFrame:
    """Last values per key among the rows that play the wanted role."""
    rows = df.filter(F.col(role) == wanted).select(*keys, *order, *[c for c in values if c not in order])
    return keep_last(rows, keys, order).select(*keys, *values)


# ---- upserts --------------------------------------------------------------

def merge_latest(current: DataFrame | None, changes: DataFrame, keys: Sequence[str], update: Sequence[str],
                 order: Sequence[str], insert_only: Sequence[str] = (), skip_nulls: bool = False,
                 precedence: str = "arrival") -> DataFrame:
    """Upsert: `update` columns take the last change, `insert_only` the first value.

    precedence="arrival": any change beats the stored value.
    precedence="event": the greatest `order` wins, stored value included; the
    `order` columns then belong to both sides.
    skip_nulls: a null in a change leaves the stored value alone.
    """
    if precedence not in ("arrival", "event"):
        raise ValueError("precedence is 'arrival' or 'event'")
    columns = [*keys, *update, *insert_only]
    new = changes.select(*columns, F.struct(*order).alias("_at"), F.lit(1).alias("_new"))
    rows = new
    if current is not None:
        if precedence == "event":
            at = F.struct(*order)
        else:
            at = F.lit(None).cast(new.schema["_at"].dataType)
        rows = new.unionByName(current.select(*columns, at.alias("_at"), F.lit(0).alias("_new")))
    last = F.struct("_at", "_new") if precedence == "event" else F.struct("_new", "_at")
    picks = []
    for c in update:
        turn = F.when(F.col(c).isNotNull(), last) if skip_nulls else last
        picks.append(F.max_by(c, turn).alias(c))
    for c in insert_only:
        picks.append(F.min_by(c, F.struct("_new", "_at")).alias(c))
    return rows.groupBy(*keys).agg(*picks)


def sync_dimension(current: DataFrame, wanted: DataFrame, key: str, update: Sequence[str],
                   insert_only: Sequence[str], active: str = "activo") -> DataFrame:
    """Wanted rows become active, rows no longer wanted inactive; none is removed."""
    new = wanted.select(key, *[F.col(c).alias(f"_new_{c}") for c in [*update, *insert_only]], F.lit(True).alias("_in"))
    old = current.select(key, *update, *insert_only, F.lit(True).alias("_was"))
    both = old.join(new, key, "full_outer")
    present = F.coalesce("_in", F.lit(False))
    stored = F.coalesce("_was", F.lit(False))
    return both.select(
        key,
        *[F.when(present, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in update],
        *[F.when(stored, F.col(c)).otherwise(F.col(f"_new_{c}")).alias(c) for c in insert_only],
        present.alias(active),
    )


def missing_from(current: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    return current.join(wanted.select(key), key, "left_anti")


def mark_insertable(current: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str],
                    into: str = "accepted") -> DataFrame:
    """Flag the first row of every key that is not stored yet.

    `order` must tell the rows of a key apart.
    """
    firsts = rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    free = firsts.join(current.select(*keys), list(keys), "left_anti")
    won = F.coalesce(F.struct(*order) == F.col("_first"), F.lit(False))
    return rows.join(free, list(keys), "left").select(*rows.columns, won.alias(into))


def insert_if_absent(current: DataFrame, rows: DataFrame, keys: Sequence[str],
                     order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of an insert under a unique key."""
    marked = mark_insertable(current, rows, keys, order, "_won")
    return marked.filter("_won").drop("_won"), marked.filter("NOT _won").drop("_won")


# ---- deletes and updates --------------------------------------------------

def delete_by_key(df: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key (and owner, if part of it) is not listed."""
    return df.join(doomed.select(*keys), list(keys), "left_anti")


def deleted_by_key(df: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(doomed.select(*keys), list(keys), "left_semi")


def delete_cascade(parents: DataFrame, doomed: DataFrame, keys: Sequence[str],
                   children: Iterable[tuple[DataFrame, str, str]]) -> tuple[DataFrame, list[DataFrame]]:
    """Parents without the listed ones, and each child table without their rows.

    Children are (table, column naming the parent, parent's id column).
    """
    gone = deleted_by_key(parents, doomed, keys)
    kept = [
        child.join(gone.select(F.col(pid).alias(ref)).distinct(), ref, "left_anti").select(*child.columns)
        for child, ref, pid in children
    ]
    return delete_by_key(parents, doomed, keys), kept


def update_by_key(df: DataFrame, changes: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Set columns of the rows the changes name, null included; other rows stay."""
    new = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = df.join(new, list(keys), "left")
    values = {c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns}
    return joined.select(*[values[c].alias(c) if c in values else F.col(c) for c in df.columns])


def replace_by_key(df: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys in `new` give way to the new rows."""
    kept = df.join(new.select(key).distinct(), key, "left_anti")
    return kept.unionByName(new.select(*df.columns))


# ---- array columns --------------------------------------------------------

def array_append(df: DataFrame, column: str, element: Column, when: Column | None = None) -> DataFrame:
    """Add an element at the end; a null array counts as empty."""
    kind = df.schema[column].dataType
    held = F.coalesce(F.col(column), F.array().cast(kind))
    grown = F.concat(held, F.array(element).cast(kind))
    return df.withColumn(column, grown if when is None else F.when(when, grown).otherwise(F.col(column)))


def array_remove(df: DataFrame, column: str, element_id: Column, field: str = "id",
                 when: Column | None = None) -> DataFrame:
    """Drop elements with the id, and those that have none; a null array becomes empty."""
    kind = df.schema[column].dataType
    held = F.coalesce(F.col(column), F.array().cast(kind))
    left = F.filter(held, lambda e: e[field] != element_id)
    return df.withColumn(column, left if when is None else F.when(when, left).otherwise(F.col(column)))


# ---- schema changes and checks --------------------------------------------

def migrate(df: DataFrame, renames: Mapping[str, str] = {}, adds: Mapping[str, str] = {},
            fills: Mapping[str, object] = {}, checks: Mapping[str, Sequence] = {}) -> tuple[DataFrame, DataFrame]:
    """(migrated, rows that break a check) after renaming, adding and filling columns."""
    out = df.withColumnsRenamed(dict(renames))
    for name, kind in adds.items():
        out = out.withColumn(name, F.lit(None).cast(kind))
    for name, value in fills.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return check_allowed(out, checks)


def check_allowed(df: DataFrame, rules: Mapping[str, Sequence]) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): every ruled column must hold one of its allowed values."""
    if not rules:
        return df, df.limit(0).withColumn("reason", F.lit(""))
    fine = {c: F.coalesce(F.col(c).isin(*allowed), F.lit(False)) for c, allowed in rules.items()}
    reason = F.concat_ws(", ", *[F.when(~ok, F.lit(c)) for c, ok in fine.items()])
    valid = F.lit(True)
    for ok in fine.values():
        valid = valid & ok
    return df.filter(valid), df.filter(~valid).withColumn("reason", reason)


def owned_by(rows: DataFrame, *chain: tuple[DataFrame, Sequence[str]]) -> DataFrame:
    """Rows that find a match in every owner table of the chain."""
    for owners, keys in chain:
        rows = rows.join(owners.select(*keys), list(keys), "left_semi")
    return rows


def listing(df: DataFrame, filters: Mapping[str, object], order: Sequence[Column] = ()) -> DataFrame:
    """Rows with the given column values, ordered."""
    for column, value in filters.items():
        df = df.filter(F.col(column) == F.lit(value))
    return df.orderBy(*order) if order else df
