"""Locations and addresses.

P5 and P6 are row-local projections.  P7 (nearest depot) is an exact spatial
join for any number of depots, see ``nearest_depot``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thali.functions.numbers import plain_float_text
from thali.functions.text import uri_component

# Packed location separator and the number pattern Python's
# float() accepts for the coordinates (plain, exponent, inf/nan).
LOCATION_SEP = " | "
_DIGITS = r"\d+(_\d+)*"
_NUMBER = rf"^\s*[+-]?(({_DIGITS}\.?({_DIGITS})?|\.{_DIGITS})([eE][+-]?{_DIGITS})?|inf|infinity|nan)\s*$"
# Earth radius per distance unit (km, miles, nautical miles).
EARTH_RADIUS = {"K": 6371.0, "M": 3958.8, "N": 3440.1}
# Fixed value: the maps address.
MAPS = "https://www.google.com/maps"
#: Cells along each axis of the cube around the earth at the first level; each
#: level cuts a cell in 16 x 16 x 16, and the last one's cells are 6 mm wide.
GRID, SPLIT, LEVELS = 8, 16, 8
#: A cell of more depots than this is cut further.
FEW = 32
# Rounding room of the pruning bounds, as a chord (0.6 micrometres on the ground).
_ROOM = 1e-13


def _num(part: Column) -> Column:
    ok = F.lower(part).rlike(_NUMBER)
    return F.when(ok, F.regexp_replace(part, "_", "").try_cast("double"))


def parse_locations(orders: DataFrame, col: str = "delivery_location") -> DataFrame:
    """P5: split ``Address | LAT | LON | MAP_LINK``.

    Four or more parts with numeric (or empty) coordinates: auto-detected.
    Otherwise a manual entry: the whole text is the address.  Empty input:
    empty address and no ``full_string``.
    """
    x = F.col(col)
    parts = F.split(x, r" \| ")
    p1, p2 = F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(3))
    lat = F.when(p1 != "", _num(p1))
    lon = F.when(p2 != "", _num(p2))
    numbers_ok = ((p1 == "") | _num(p1).isNotNull()) & ((p2 == "") | _num(p2).isNotNull())
    packed = x.contains(LOCATION_SEP) & (F.size(parts) >= 4) & numbers_ok
    empty = x.isNull() | (x == "")
    return orders.select(
        "order_id", x.alias("location_text"),
        F.when(empty, F.lit("")).when(packed, F.element_at(parts, 1)).otherwise(x).alias("address"),
        F.when(packed & ~empty, lat).alias("latitude"),
        F.when(packed & ~empty, lon).alias("longitude"),
        F.when(packed & ~empty, F.element_at(parts, 4)).alias("map_link"),
        F.coalesce(packed & ~empty, F.lit(False)).alias("is_auto_detected"),
        F.when(~empty, x).alias("full_string"),
    )


def valid_point(lat: Column, lon: Column) -> Column:
    """Non-NULL and within +-90 / +-180 (a zero coordinate is valid: R16 fix)."""
    return (lat.isNotNull() & lon.isNotNull() & lat.between(-90, 90) & lon.between(-180, 180))


def _fixed6(c: Column) -> Column:
    return F.regexp_replace(F.format_number(c, 6), ",", "")


def _dms(c: Column, pos: str, neg: str) -> Column:
    a = F.abs(c)
    deg = F.floor(a)
    mins_dec = (a - deg) * 60
    mins = F.floor(mins_dec)
    secs = F.format_number((mins_dec - mins) * 60, 2)
    return F.concat(deg.cast("string"), F.lit("° "), mins.cast("string"), F.lit("' "), secs, F.lit('" '),
                    F.when(c >= 0, F.lit(pos)).otherwise(F.lit(neg)))


def _nz(c: Column) -> Column:
    return F.when(c != "", c)


def map_link(lat: Column, lon: Column) -> Column:
    """Map address of a point; NULL without both coordinates."""
    return F.concat(F.lit(MAPS + "?q="), plain_float_text(lat), F.lit(","), plain_float_text(lon), F.lit("&z=15"))


def enrich_addresses(addresses: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Formatted address, customer-view line and phone, validity,
    three map links, directions and street-view links, 6-place texts, DMS."""
    lat, lon = F.col("latitude"), F.col("longitude")
    valid = valid_point(lat, lon)
    formatted = F.concat_ws(
        ", ", _nz(F.col("address_line1")), _nz(F.col("address_line2")),
        F.concat(F.lit("Near "), _nz(F.col("landmark"))), _nz(F.col("city")), _nz(F.col("state")),
        F.concat(F.lit("Pincode: "), _nz(F.col("pincode"))))
    lat6, lon6 = _fixed6(lat), _fixed6(lon)
    df = addresses
    own_phone = F.col("phone") if "phone" in addresses.columns else F.lit(None).cast("string")
    if users is not None:
        df = df.join(users.select(F.col("id").alias("_uid"), F.col("phone").alias("_user_phone")),
                     F.col("user_id") == F.col("_uid"), "left").drop("_uid")
        phone = F.coalesce(_nz(own_phone), F.col("_user_phone"))
    else:
        phone = own_phone

    def js(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("null"))

    out = df.withColumns({
        "formatted_address": formatted,
        "city_line": F.concat(js("city"), F.lit(", "), js("state"), F.lit(" - "), js("pincode")),
        "phone_shown": phone,
        "has_valid_coordinates": valid,
        "map_link": map_link(lat, lon),
        "map_link_plain": F.concat(F.lit(MAPS + "?q="), plain_float_text(lat), F.lit(","), plain_float_text(lon)),
        "map_link_view": F.when(valid, F.concat(
            F.lit(MAPS + "?q="), lat6, F.lit(","), lon6, F.lit("&z=15"),
            F.when(F.trim(formatted) != "", F.concat(F.lit("&layer=c&cbll="), lat6, F.lit(","), lon6, F.lit("&cbp=")))
            .otherwise(F.lit("")))),
        "directions_link": F.when(valid, F.concat(
            F.lit(MAPS + "/dir/?api=1"),
            F.when(formatted != "", F.concat(F.lit("&origin="), uri_component(F.trim(formatted)))).otherwise(F.lit("")),
            F.lit("&destination="), lat6, F.lit(","), lon6, F.lit("&travelmode=driving"))),
        "street_view_link": F.when(valid, F.concat(
            F.lit(MAPS + "/@?api=1&map_action=pano&viewpoint="), lat6, F.lit(","), lon6)),
        "latitude_text": F.when(valid, lat6),
        "longitude_text": F.when(valid, lon6),
        "latitude_dms": F.when(valid, _dms(lat, "N", "S")),
        "longitude_dms": F.when(valid, _dms(lon, "E", "W")),
    })
    return out.drop("_user_phone") if users is not None else out


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, unit: str = "K") -> Column:
    """Great-circle distance of two valid points, not rounded."""
    r = EARTH_RADIUS.get(unit, EARTH_RADIUS["K"])
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = (F.sin(dlat / 2) * F.sin(dlat / 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) * F.sin(dlon / 2))
    return F.lit(2 * r) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, unit: str = "K") -> Column:
    """Great-circle distance, 2 decimals; NULL for an invalid point."""
    return F.when(valid_point(lat1, lon1) & valid_point(lat2, lon2), F.round(great_circle(lat1, lon1, lat2, lon2, unit), 2))


def _on_sphere(points: DataFrame) -> DataFrame:
    """``points`` with the unit vector ``x, y, z`` of (lat, lon)."""
    lat, lon = F.radians("lat"), F.radians("lon")
    return points.withColumns({"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)})


def _cell(n: int) -> Column:
    """The grid cell of ``x, y, z`` at ``n`` cells an axis."""
    return F.struct(*[F.least(F.floor((F.col(c) + 1) / 2 * n), F.lit(n - 1)).cast("long").alias(c) for c in "xyz"])


def _bounds(box: Column) -> tuple[Column, Column]:
    """Least and greatest squared chord from ``x, y, z`` to a box."""
    near = far = F.lit(0.0)
    for c in "xyz":
        low, high = box[f"{c}0"] - F.col(c), F.col(c) - box[f"{c}1"]
        out = F.greatest(low, high, F.lit(0.0))
        reach = F.greatest(F.abs(low), F.abs(high))
        near, far = near + out * out, far + reach * reach
    return near, far


def _pruned(rows: DataFrame, over: Window | None) -> DataFrame:
    """``rows`` once for each of their ``boxes`` that may hold the nearest
    depot: no box whose nearest corner is farther than ``best``, the least of the
    farthest corners that the point has met."""
    met = F.transform("boxes", lambda b: F.struct(b["cell"].alias("cell"), b["n"].alias("n"), _bounds(b)[0].alias("near"), _bounds(b)[1].alias("far")))
    rows = rows.withColumn("met", met)
    best = F.least("best", F.array_min(F.transform("met", lambda m: m["far"])))
    rows = rows.withColumn("best", F.min(best).over(over) if over is not None else best)
    left = F.filter("met", lambda m: _within(m["near"], F.col("best")))
    return rows.select("lat", "lon", "x", "y", "z", "best", F.inline(F.transform(left, lambda m: F.struct(
        m["cell"].alias("cell"), m["n"].alias("n"), m["near"].alias("near")))))


def _within(near: Column, best: Column) -> Column:
    return near <= F.pow(F.sqrt(best) + _ROOM, F.lit(2))


def nearest_depot(addresses: DataFrame, depots: DataFrame, unit: str = "K") -> DataFrame:
    """Each address with its nearest depot and the distance.

    ``depots`` (depot_id, latitude, longitude) may have any number of rows, and
    any number of them may stand close together.  Points on the unit sphere fall
    in a cube grid whose cells are cut until ``FEW`` depots or fewer are in one,
    so a dense town is cut as finely as it needs.  Level by level, a point keeps
    the cells that may hold its nearest depot, and meets the boxes of their
    occupied sub-cells by an equi-join on the cell; depots are met one by one in
    uncut cells only.  Distances are compared exactly and rounded after; ties go
    to the lower depot id.  Invalid addresses, and all addresses without a valid
    depot, get NULLs.
    """
    lat, lon = F.col("latitude"), F.col("longitude")
    ok = valid_point(lat, lon)
    # depots at one place: the lowest id stands for all
    sites = _on_sphere(depots.where(ok).groupBy(lat.alias("lat"), lon.alias("lon")).agg(F.min("depot_id").alias("depot_id")))
    box = [f(c).alias(f"{c}{i}") for c in "xyz" for i, f in ((0, F.min), (1, F.max))]
    rows = _on_sphere(addresses.where(ok).select(lat.alias("lat"), lon.alias("lon")).distinct()).withColumn("best", F.lit(float("inf")))
    same = Window.partitionBy("lat", "lon")
    kept, leaves, parent, n = [], [], 1, GRID
    for level in range(LEVELS):
        sites = sites.withColumns({"parent": _cell(parent), "cell": _cell(n)})
        cells = sites.groupBy("parent", "cell").agg(F.count(F.lit(1)).alias("n"), *box)
        crowded = cells.where(F.col("n") > FEW)
        last = level == LEVELS - 1 or crowded.isEmpty()
        boxes = cells.groupBy("parent").agg(F.collect_list(F.struct("cell", "n", *[f"{c}{i}" for c in "xyz" for i in (0, 1)])).alias("boxes"))
        if level == 0:
            rows = _pruned(rows.withColumn("boxes", boxes.select("boxes").scalar()), None)  # at most 8 x 8 x 8 boxes
        else:
            rows = _pruned(rows.drop("n", "near").join(boxes, rows["cell"] == F.col("parent")).drop("parent", "cell"), same)
        few = F.lit(True) if last else F.col("n") <= FEW
        kept.append(rows.where(few).select("lat", "lon", "best", "near", F.lit(level).alias("level"), "cell"))
        whole = cells.where(few).select("cell")
        leaves.append(sites.join(whole, "cell", "left_semi").select(
            F.lit(level).alias("_level"), F.col("cell").alias("_cell"), "depot_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon")))
        if last:
            break
        rows = rows.where(F.col("n") > FEW)
        sites = sites.join(crowded.select("cell"), "cell", "left_semi").drop("parent", "cell")
        parent, n = n, n * SPLIT
    rows, leaf = (reduce(DataFrame.unionByName, x) for x in (kept, leaves))
    if len(kept) > 1:  # deeper levels know better bounds
        rows = rows.withColumn("best", F.min("best").over(same)).where(_within(F.col("near"), F.col("best")))
    met = rows.join(leaf, (F.col("level") == F.col("_level")) & (F.col("cell") == F.col("_cell")))
    far = great_circle(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"), unit)
    best = met.groupBy("lat", "lon").agg(F.min(F.struct(far.alias("far"), "depot_id")).alias("best"))
    return (addresses.select("address_id", "user_id", "latitude", "longitude")
            .join(best, (lat == F.col("lat")) & (lon == F.col("lon")), "left")
            .select("address_id", "user_id", "latitude", "longitude",
                    F.col("best.depot_id").alias("depot_id"), F.round("best.far", 2).alias("distance")))
