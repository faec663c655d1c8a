"""Hand-written edge rows (FIXTURES.md, last section)."""

from datetime import datetime
from decimal import Decimal

ORDERS_SCHEMA = ("order_id long, user_id long, user_name string, user_phone string, user_email string, "
                 "total_amount decimal(18,2), status string, payment_mode string, delivery_location string, "
                 "items string, order_date timestamp_ntz, delivery_date timestamp_ntz, notes string")


def orders(spark):
    d = datetime
    rows = [
        (1, 10, "Asha", "+911", "a@x.org", Decimal("100.50"), "pending", "COD", None, "[]",
         d(2024, 1, 1, 18, 29, 59), None, None),
        (2, 10, "Asha", "+911", "a@x.org", Decimal("200.00"), "delivered", "UPI", None, "[]",
         d(2024, 1, 1, 18, 30, 0), d(2024, 1, 3, 10, 0), None),
        (3, 11, "Ravi", "+912", "r@x.org", Decimal("50.00"), None, None, None, "[]",
         d(2024, 1, 2, 5, 0), None, None),
        (4, 11, "Ravi", "+912", "r@x.org", None, "completed", None, None, "[]", d(2024, 1, 2, 6, 0), None, None),
        (5, 12, "Mei", "+913", "m@x.org", Decimal("75.25"), "cancelled", None, None, "[]", None, None, None),
        (6, 12, "Mei", "+913", "m@x.org", Decimal("1234567.00"), "held", None, None, "[]",
         d(2024, 1, 2, 7, 0), None, None),
        (7, 13, "50%_off", "+914", "o@x.org", Decimal("10.00"), "processing", None, None, "[]",
         d(2024, 1, 2, 8, 0), None, None),
    ]
    return spark.createDataFrame(rows, ORDERS_SCHEMA)
