"""Display columns over whole tables.

Pure projections: no shuffle, one pass, all inside whole-stage codegen.
Status labels use literal maps rather than a dimension join, so nothing is
broadcast and the plan stays a single scan.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thali.functions.numbers import ratio
from thali.functions.text import ist_text, money_indian_text, money_text, template_truncate
from thali.operators.listings import order_payment_detail

# Order status display name, colour, icon, server badge, browser badge.
ORDER_STATUS = {
    "pending": ("Pending", "#ffc107", "clock", "warning", "bg-warning"),
    "processing": ("Processing", "#17a2b8", "cogs", "info", "bg-info"),
    "completed": ("Completed", "#28a745", "check-circle", "success", "bg-success"),
    "cancelled": ("Cancelled", "#dc3545", "times-circle", "danger", "bg-danger"),
    "delivered": ("Delivered", "#20c997", "truck", "success", "bg-primary"),
}
# Payment status display name, colour, icon, badge.
PAYMENT_STATUS = {
    "pending": ("Pending", "#ffc107", "clock", "warning"),
    "completed": ("Completed", "#28a745", "check-circle", "success"),
    "failed": ("Failed", "#dc3545", "times-circle", "danger"),
    "refunded": ("Refunded", "#6c757d", "undo", "secondary"),
    "cancelled": ("Cancelled", "#dc3545", "ban", "danger"),
}
# What an unknown status shows, and the picture of a customer without one.
UNKNOWN = ("#6c757d", "question-circle", "secondary", "bg-secondary")
DEFAULT_AVATAR = "https://res.cloudinary.com/demo/image/upload/v1633427556/default-avatar.png"


def _lookup(table: dict[str, tuple], idx: int, key: Column) -> Column:
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v[idx])) for k, v in table.items()))
    return F.element_at(m, key)


def order_display(orders: DataFrame) -> DataFrame:
    """IST date-time text with its date and time halves, and both money texts."""
    text = ist_text("order_date")
    return orders.select(
        "order_id", "order_date", "total_amount",
        text.alias("order_date_formatted"),
        F.coalesce(F.split_part(text, F.lit(", "), F.lit(1)), F.lit("")).alias("order_date_part"),
        F.coalesce(F.split_part(text, F.lit(", "), F.lit(2)), F.lit("")).alias("order_time_part"),
        money_text("total_amount").alias("total_amount_formatted"),
        money_indian_text("total_amount").alias("total_amount_indian"),
    )


def orders_page_display(page: DataFrame) -> DataFrame:
    """The texts of a listing page: date, amount, status class, shortened
    e-mail (input = O1 output)."""
    return page.withColumns({
        "order_date_formatted": ist_text("order_date"),
        "total_amount_formatted": money_text("total_amount"),
        "status_class": F.coalesce(_lookup(ORDER_STATUS, 3, F.coalesce("status", F.lit(""))), F.lit(UNKNOWN[2])),
        "email_short": template_truncate("user_email", 20),
    })


def label_orders(orders: DataFrame) -> DataFrame:
    """Status name, badge (server and browser forms), colour and icon."""
    s = F.col("status")
    return orders.withColumns({
        "status_name": F.coalesce(_lookup(ORDER_STATUS, 0, s), F.initcap(s)),
        "status_color": F.coalesce(_lookup(ORDER_STATUS, 1, s), F.lit(UNKNOWN[0])),
        "status_icon": F.coalesce(_lookup(ORDER_STATUS, 2, s), F.lit(UNKNOWN[1])),
        "status_badge": F.coalesce(_lookup(ORDER_STATUS, 3, s), F.lit(UNKNOWN[2])),
        "status_badge_js": F.coalesce(_lookup(ORDER_STATUS, 4, s), F.lit(UNKNOWN[3])),
    })


def label_payments(payments: DataFrame) -> DataFrame:
    """Payment status labels; a payment without status is shown as pending."""
    s = F.coalesce(F.col("payment_status"), F.lit("pending"))
    return payments.withColumns({
        "status_shown": s,
        "status_name": F.coalesce(_lookup(PAYMENT_STATUS, 0, s), F.initcap(s)),
        "status_color": F.coalesce(_lookup(PAYMENT_STATUS, 1, s), F.lit(UNKNOWN[0])),
        "status_icon": F.coalesce(_lookup(PAYMENT_STATUS, 2, s), F.lit(UNKNOWN[1])),
        "status_badge": F.coalesce(_lookup(PAYMENT_STATUS, 3, s), F.lit(UNKNOWN[2])),
    })


def explode_order_items(orders: DataFrame) -> DataFrame:
    """One row per element of the ``items`` JSON array; anything that is
    not a JSON array (object, bad text, NULL) gives no rows."""
    arr = F.when(F.json_array_length("items").isNotNull(), F.from_json("items", "array<string>"))
    return (orders.select("order_id", F.posexplode(arr).alias("pos", "item_json"))
            .select("order_id", "pos", "item_json",
                    F.get_json_object("item_json", "$.name").alias("item_name"),
                    F.get_json_object("item_json", "$.quantity").try_cast("int").alias("quantity")))


def customer_display(customers: DataFrame) -> DataFrame:
    """Date texts, avatar (own only if ``http...``), average per order with
    its text, shortened e-mail and location, last login or ``Never``, and spend
    text (input = J7 output)."""
    pic = F.col("profile_pic")
    average = F.round(F.col("total_spent").cast("decimal(28,2)") / F.col("total_orders"), 0).cast("long").cast("string")
    return customers.withColumns({
        "created_at_formatted": ist_text("created_at"),
        "last_login_formatted": ist_text("last_login"),
        "avatar_url": F.when(pic.startswith("http"), pic).otherwise(F.lit(DEFAULT_AVATAR)),
        "avg_per_order": ratio(F.col("total_spent"), F.col("total_orders")),
        "avg_text": F.when(F.col("total_orders") > 0, F.concat(F.lit("Avg: ₹"), average)).otherwise(F.lit("No orders")),
        "email_short": template_truncate("email", 20),
        "location_short": template_truncate("location", 15),
        "last_login_shown": F.when(F.col("last_login").isNull(), F.lit("Never")).otherwise(ist_text("last_login")),
        "total_spent_formatted": money_text("total_spent"),
    })


def order_timeline(orders: DataFrame) -> DataFrame:
    """The timeline steps of each order with an ``active`` flag.

    Placed and processing always show; delivered only with a delivery
    date; cancelled only for cancelled orders.
    """
    s = F.col("status")
    delivered_text = ist_text("delivery_date")
    def step(no: int, name: str, detail: Column, active: Column, shown: Column) -> Column:
        return F.struct(F.lit(no).alias("step_no"), F.lit(name).alias("step"), detail.alias("detail"),
                        active.alias("active"), shown.alias("shown"))

    steps = F.array(
        step(1, "Order Placed", ist_text("order_date"), s == "pending", F.lit(True)),
        step(2, "Processing", F.lit("Order is being processed"), s == "processing", F.lit(True)),
        step(3, "Delivered", delivered_text, s == "delivered", delivered_text != ""),
        step(4, "Cancelled", F.lit("Order was cancelled"), F.lit(True), s == "cancelled"),
    )
    shown = F.filter(steps, lambda x: F.coalesce(x["shown"], F.lit(False)))
    return (orders.select("order_id", F.explode(shown).alias("x"))
            .select("order_id", "x.step_no", "x.step", "x.detail",
                    F.coalesce(F.col("x.active"), F.lit(False)).alias("active")))


def payment_display(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Payment panel per order and payment row (J3).  Empty texts fall
    back like missing ones; a signature is cut at 50 and always gets ``...``."""
    j = order_payment_detail(orders, payments)

    def text(c: str) -> Column:
        return F.when(F.col(c) != "", F.col(c)) if c in j.columns else F.lit(None).cast("string")

    return j.select(
        "order_id", "payment_id",
        F.upper(F.coalesce(text("payment_status"), F.lit("pending"))).alias("status_shown"),
        money_text("total_amount").alias("amount_formatted"),
        F.coalesce(text("payment_mode"), F.lit("N/A")).alias("mode_shown"),
        F.coalesce(text("transaction_id"), F.lit("")).alias("transaction_shown"),
        ist_text("payment_date").alias("payment_date_formatted"),
        text("razorpay_order_id").alias("razorpay_order_shown"),
        text("razorpay_payment_id").alias("razorpay_payment_shown"),
        F.concat(F.substring(text("razorpay_signature"), 1, 50), F.lit("...")).alias("signature_short"),
    )
