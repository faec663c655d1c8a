"""Batch table changes as new snapshots.

Parquet tables take no ``UPDATE``/``MERGE``, so a batch of changes yields
*new* DataFrames (snapshot, history, rejects).  The caller writes a snapshot to
a new versioned folder (``thali.sinks.exports.write_snapshot``), or applies the
batch to a table kept in parts (``thali.sinks.versions``), which rewrites the
parts that the batch touches.

Several changes to one order collapse to one row per order with
``max_by`` aggregates (partial aggregation, so a hot order costs no extra), and
the snapshot is one left join on ``order_id``.  Changes of one order with equal
``seq`` follow in the order of their other values, the same in every output.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thali.operators.ranges import in_ranges, looked_back

# The status domains the change endpoints accept.
ORDER_STATUSES = ("pending", "processing", "completed", "cancelled", "delivered")
PAYMENT_STATUSES = ("pending", "completed", "failed", "refunded", "cancelled")


class ChangeResult(NamedTuple):
    """The frames of a batch.  The history is sorted into stored ranges, so it
    is made when asked for."""

    snapshot: DataFrame
    make_history: Callable[[], DataFrame]
    rejects: DataFrame

    @property
    def history(self) -> DataFrame:
        return self.make_history()


def _reason(status_col: str, domain: tuple[str, ...]):
    s = F.col(status_col)
    return F.when(s.isNull() | (s == ""), F.lit("status_required")).when(~s.isin(*domain), F.lit("invalid_status"))


def _rejects(marked: DataFrame, changes: DataFrame, status_col: str, domain: tuple[str, ...]) -> DataFrame:
    """Rows of ``marked`` (changes left-joined to orders, ``_known`` set on a
    match) that are not applied, with the reason."""
    reason = F.coalesce(_reason(status_col, domain), F.when(F.col("_known").isNull(), F.lit("unknown_order")))
    return marked.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(*changes.columns, "reason")


def apply_status_changes(orders: DataFrame, changes: DataFrame) -> ChangeResult:
    """``changes`` (order_id, new_status, notes, changed_by, seq).

    Status = last valid change by ``seq``; notes = last non-NULL notes
    (``''`` overwrites, NULL keeps).  History carries the real old status
    (previous change, or the stored status for the first one).
    """
    at = F.struct("seq", "new_status", "notes", "changed_by")
    valid = changes.where(_reason("new_status", ORDER_STATUSES).isNull())
    last = valid.groupBy("order_id").agg(
        F.max_by("new_status", at).alias("_new_status"),
        F.max_by("notes", F.when(F.col("notes").isNotNull(), at)).alias("_new_notes"),
        F.count(F.when(F.col("notes").isNotNull(), 1)).alias("_has_notes"))
    # changes of unknown orders find no row to change
    snapshot = (orders.join(last, "order_id", "left")
                .withColumn("status", F.coalesce("_new_status", "status"))
                .withColumn("notes", F.when(F.col("_has_notes") > 0, F.col("_new_notes")).otherwise(F.col("notes")))
                .drop("_new_status", "_new_notes", "_has_notes")
                .select(*orders.columns))
    base = orders.select("order_id", F.col("status").alias("_base"), F.lit(True).alias("_known"))
    return ChangeResult(snapshot, lambda: _history(valid.join(base, "order_id")),
                        _rejects(changes.join(base, "order_id", "left"), changes, "new_status", ORDER_STATUSES))


def _history(known: DataFrame) -> DataFrame:
    """Each valid change of a known order with the status before it.  One
    change back is looked up over sorted ranges, so an order may have any number
    of changes; equal ``seq`` follow in the order of their other values."""
    laid = in_ranges(known, "order_id", [F.col(c) for c in ("seq", "new_status", "notes", "changed_by")], "changes")
    return (looked_back(laid, "order_id", "new_status", "_before")
            .withColumn("old_status", F.coalesce("_before", "_base"))
            .select("order_id", "seq", "old_status", "new_status", "changed_by", "notes"))


def apply_payment_changes(payments: DataFrame, orders: DataFrame, changes: DataFrame,
                          all_payments: DataFrame | None = None) -> ChangeResult:
    """``changes`` (order_id, payment_status, transaction_id, changed_at, seq).

    Every payment row of the order takes the last status; transaction id =
    last non-empty one; payment_date = time of the last ``completed``
    change.  Orders without a payment get one built from the order (the
    first change inserts it, so its time is not a completion time).  The
    ``history`` frame holds activity rows for the log sink (K5).  Where
    ``payments`` is a part of the table, ``all_payments`` is the whole, above
    whose ids new ones lie.
    """
    valid = changes.where(_reason("payment_status", PAYMENT_STATUSES).isNull())
    st, tx = F.col("payment_status"), F.col("transaction_id")
    at = F.struct("seq", "payment_status", "transaction_id", "changed_at")
    done = st == "completed"
    per_order = (valid.groupBy("order_id").agg(
        F.max_by("payment_status", at).alias("_status"),
        F.max_by("transaction_id", F.when(tx != "", at)).alias("_tx"),
        F.min_by("transaction_id", at).alias("_first_tx"),
        F.max_by("changed_at", F.when(done, at)).alias("_paid_at"),
        F.max(F.when(done, at)).alias("_paid"),
        F.min(at).alias("_first"))
        # an inserted payment takes a completion time only from a later change
        .withColumn("_paid_after", F.when(F.col("_paid") > F.col("_first"), F.col("_paid_at"))))
    base = orders.select("order_id", F.col("user_id").alias("_user"), F.col("total_amount").alias("_amount"),
                         F.col("payment_mode").alias("_mode"), F.lit(True).alias("_known"))
    # a new id is above all given ones, and one payment is new per order
    above = (payments if all_payments is None else all_payments).agg(F.coalesce(F.max("payment_id"), F.lit(0))).scalar()
    both = payments.withColumn("_old", F.lit(True)).join(per_order.join(base, "order_id"), "order_id", "full")
    old = F.col("_old").isNotNull()
    new = {
        "payment_id": F.when(old, F.col("payment_id")).otherwise(above + F.col("order_id")),
        "user_id": F.when(old, F.col("user_id")).otherwise(F.col("_user")),
        "amount": F.when(old, F.col("amount")).otherwise(F.col("_amount")),
        "payment_mode": F.when(old, F.col("payment_mode")).otherwise(F.col("_mode")),
        "payment_status": F.coalesce("_status", "payment_status"),
        "transaction_id": F.when(old, F.coalesce("_tx", "transaction_id")).otherwise(F.coalesce("_tx", "_first_tx")),
        "payment_date": F.when(old, F.coalesce("_paid_at", "payment_date")).otherwise(F.col("_paid_after")),
    }
    snapshot = both.select(*[new.get(c, F.col(c)).cast(payments.schema[c].dataType).alias(c) for c in payments.columns])
    marked = changes.join(base.select("order_id", "_known"), "order_id", "left")
    valid = valid.join(base.select("order_id"), "order_id", "left_semi")
    rejects = _rejects(marked, changes, "payment_status", PAYMENT_STATUSES)
    activity = valid.select(
        F.lit(None).cast("int").alias("user_id"),
        F.lit("payment_update").alias("activity_type"),
        F.concat(F.lit("Payment for order "), F.col("order_id").cast("string"), F.lit(" updated to "), st)
        .alias("description"),
        F.lit(None).cast("string").alias("ip_address"), F.lit(None).cast("string").alias("user_agent"),
        F.col("changed_at").alias("created_at"))
    return ChangeResult(snapshot, lambda: activity, rejects)


def bulk_status_changes(ids: DataFrame, status: str, changed_by: str = "bulk",
                        notes: str | None = None, seq: int = 0) -> DataFrame:
    """One status for a list of ids (``ids`` has ``order_id``) as C1 input."""
    return ids.select("order_id").distinct().select(
        "order_id", F.lit(status).alias("new_status"), F.lit(notes).cast("string").alias("notes"),
        F.lit(changed_by).alias("changed_by"), F.lit(seq).cast("long").alias("seq"))


def bulk_delete_orders(orders: DataFrame, order_items: DataFrame, payments: DataFrame,
                       ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """C4: the three tables without the listed orders (anti joins on order_id)."""
    keys = ids.select("order_id").distinct()
    return (orders.join(keys, "order_id", "left_anti"),
            order_items.join(keys, "order_id", "left_anti"),
            payments.join(keys, "order_id", "left_anti"))
