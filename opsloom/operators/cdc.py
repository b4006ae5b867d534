"""Change histories to current state, validity intervals and change sets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.operators.ordered import with_neighbour
from opsloom.operators.rows import latest_per_key
from opsloom.schemas import CHANGE_COLUMNS


@dataclass(frozen=True)
class Flow:
    """How one history table becomes a current-state table."""

    name: str
    keys: tuple[str, ...] = ("id",)
    seq: tuple[str, ...] = ("_lsn", "_xid")
    delete_value: str = "delete"
    type_column: str = "_change_type"
    drop: tuple[str, ...] = field(default=CHANGE_COLUMNS)
    ignore_types: tuple[str, ...] = ()

    @property
    def delete_when(self) -> Column:
        return F.coalesce(F.col(self.type_column) == self.delete_value, F.lit(False))

    def accepted(self, history: DataFrame) -> DataFrame:
        if not self.ignore_types:
            return history
        return history.where(~F.coalesce(F.col(self.type_column).isin(*self.ignore_types), F.lit(False)))

    def winners(self, history: DataFrame) -> DataFrame:
        """The latest change per key, deletes included, so that late older changes stay beaten."""
        return latest_per_key(self.accepted(history), self.keys, self.seq)

    def current(self, history: DataFrame) -> DataFrame:
        """Current rows: the winners that are not deletes, without the change metadata."""
        return self.live(self.winners(history))

    def live(self, winners: DataFrame) -> DataFrame:
        return winners.where(~self.delete_when).drop(*self.drop)


def build_flows(names: Sequence[str], **settings) -> dict[str, Flow]:
    """The same flow for several tables."""
    return {name: Flow(name, **settings) for name in names}


def apply_scd1(
    history: DataFrame,
    keys: Sequence[str],
    seq: Sequence[str],
    delete_when: Column | None = None,
    except_cols: Sequence[str] = CHANGE_COLUMNS,
) -> DataFrame:
    """Current state of a history: latest row per key by `seq`, deletes removed afterwards."""
    latest = latest_per_key(history, keys, seq)
    if delete_when is not None:
        latest = latest.where(~F.coalesce(delete_when, F.lit(False)))
    return latest.drop(*except_cols)


def state_as_of(
    history: DataFrame,
    keys: Sequence[str],
    seq: Sequence[str],
    at,
    delete_when: Column | None = None,
    except_cols: Sequence[str] = CHANGE_COLUMNS,
) -> DataFrame:
    """Current state as it was at sequence value `at`, a value or Column, of the first sequence column."""
    return apply_scd1(history.where(F.col(seq[0]) <= F.lit(at)), keys, seq, delete_when, except_cols)


def scd2_intervals(
    history: DataFrame,
    keys: Sequence[str],
    seq: Sequence[str],
    ts: str,
    delete_when: Column | None = None,
    parts: int | None = None,
) -> DataFrame:
    """One row per version with valid_from, valid_to (null = open) and is_current.

    A delete closes the version before it and is not a version itself. Of rows with an equal
    sequence value only the last one by `ts` is a version.
    """
    near = {"valid_to": ts, **{f"_next_{c}": c for c in seq}}
    out = with_neighbour(history, keys, [*seq, ts], near, 1, parts)
    repeated = F.lit(True)
    for c in seq:
        repeated = repeated & F.coalesce(F.col(c) == F.col(f"_next_{c}"), F.lit(False))
    out = out.where(~repeated).withColumn("valid_from", F.col(ts)).withColumn("is_current", F.col(f"_next_{seq[0]}").isNull())
    if delete_when is not None:
        out = out.where(~F.coalesce(delete_when, F.lit(False)))
    return out.drop(*[f"_next_{c}" for c in seq])


def diff_changes(old: DataFrame, new: DataFrame, pk: Sequence[str]) -> DataFrame:
    """The inserts, updates and deletes that turn `old` into `new`; both unique on `pk`.

    Deletes carry the old row, inserts and updates the new one, in `_change_type` and the
    columns of `new`.
    """
    pk = list(pk)
    rest = [c for c in new.columns if c not in pk]
    a = old.select(*pk, F.struct(*rest).alias("_old")) if rest else old.select(*pk, F.lit(True).alias("_old"))
    b = new.select(*pk, F.struct(*rest).alias("_new")) if rest else new.select(*pk, F.lit(True).alias("_new"))
    change = (
        F.when(F.col("_old").isNull(), "insert")
        .when(F.col("_new").isNull(), "delete")
        .when(~F.col("_old").eqNullSafe(F.col("_new")), "update")
    )
    joined = a.join(b, pk, "full_outer").withColumn("_change_type", change).where(F.col("_change_type").isNotNull())
    kept = F.coalesce("_new", "_old")
    return joined.select(*pk, *[kept.getField(c).alias(c) for c in rest], "_change_type")


def apply_changes(old: DataFrame, changes: DataFrame, pk: Sequence[str]) -> DataFrame:
    """Apply a change set from diff_changes."""
    kept = old.join(changes.select(*pk), list(pk), "left_anti")
    return kept.unionByName(changes.where(F.col("_change_type") != "delete").drop("_change_type"))
