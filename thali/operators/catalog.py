"""Services and menu catalogue.

``times_ordered`` is the reference's correlated count written as what
Catalyst would decorrelate it to: order lines aggregated per (type, id)
first, then one left join of the united catalogues on (type, id), so lines
are aggregated once and each catalogue row meets at most one count row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thali.functions.ordering import pg_asc
from thali.functions.text import money_text

# Item types, and the default photo per type.
SERVICE, MENU = "service", "menu"
DEFAULT_PHOTO = {
    SERVICE: "https://res.cloudinary.com/demo/image/upload/v1633427556/sample_service.jpg",
    MENU: "https://res.cloudinary.com/demo/image/upload/v1633427556/sample_food.jpg",
}


def times_ordered(order_items: DataFrame) -> DataFrame:
    """Order lines per (item_type, item_id)."""
    return order_items.groupBy("item_type", "item_id").agg(F.count(F.lit(1)).alias("times_ordered"))


def search_items(items: DataFrame, search: str | None = None, category: str | None = None) -> DataFrame:
    """name contains ``search`` (case-insensitive), category equals ``category``."""
    if search:
        items = items.where(F.col("name").ilike(f"%{search}%"))
    if category:
        items = items.where(F.col("category") == category)
    return items


def all_items(services: DataFrame, menu: DataFrame, order_items: DataFrame, item_type: str = "all",
              search: str | None = None, category: str | None = None) -> DataFrame:
    """U2 + J8 + F3: services then menu (``src`` 0 / 1) with times ordered,
    restricted to the chosen type(s) and filters."""
    chosen = [(items, kind, src) for src, (items, kind) in enumerate(((services, SERVICE), (menu, MENU))) if item_type in ("all", kind)]
    if not chosen:
        raise ValueError(f"unknown item type {item_type!r}")
    out = None
    for items, kind, src in chosen:
        part = search_items(items, search, category).withColumns({"item_type": F.lit(kind), "src": F.lit(src)})
        out = part if out is None else out.unionByName(part)
    counts = times_ordered(order_items).withColumnsRenamed({"item_type": "_type", "item_id": "_id"})
    return (out.join(counts, (F.col("item_type") == F.col("_type")) & (F.col("id") == F.col("_id")), "left").drop("_type", "_id")
            .withColumn("times_ordered", F.coalesce("times_ordered", F.lit(0)).cast("long")))


def items_listing(items: DataFrame) -> DataFrame:
    """Services first, each by position (NULLs last) then name."""
    return items.orderBy("src", pg_asc("position"), pg_asc("name"), pg_asc("id"))


def item_categories(services: DataFrame, menu: DataFrame) -> DataFrame:
    """Distinct (category, type) over both catalogues, NULL excluded."""
    s = services.where(F.col("category").isNotNull()).select("category", F.lit(SERVICE).alias("type"))
    m = menu.where(F.col("category").isNotNull()).select("category", F.lit(MENU).alias("type"))
    return s.union(m).distinct().orderBy("category", "type")


def both_lists(services: DataFrame, menu: DataFrame) -> DataFrame:
    """Services and menu as one list with their type."""
    return services.withColumn("item_type", F.lit(SERVICE)).unionByName(menu.withColumn("item_type", F.lit(MENU)))


def item_display(items: DataFrame) -> DataFrame:
    """P10: price texts; discount text only when the discount is non-zero."""
    return (items.withColumn("price_formatted", money_text("price"))
            .withColumn("final_price_formatted", money_text("final_price"))
            .withColumn("discount_formatted",
                        F.when(F.coalesce(F.col("discount"), F.lit(0)) != 0, money_text("discount"))))


def item_photos(order_lines_with_catalog: DataFrame) -> DataFrame:
    """Photo per order line: own non-empty photo, else the catalogue photo,
    else the default for the type (input = J4 output)."""
    own = F.when(F.col("item_photo") != "", F.col("item_photo"))
    cat = F.when(F.col("item_photo_catalog") != "", F.col("item_photo_catalog"))
    default = F.when(F.col("item_type") == SERVICE, F.lit(DEFAULT_PHOTO[SERVICE])).otherwise(
        F.lit(DEFAULT_PHOTO[MENU]))
    return order_lines_with_catalog.withColumn("photo_url", F.coalesce(own, cat, default))
