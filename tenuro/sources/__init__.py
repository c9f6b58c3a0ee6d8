"""Where the two input tables come from."""

from tenuro.sources.orders import activity_from_orders, licenses_from_orders
from tenuro.sources.tables import (
    conform_activity,
    conform_licenses,
    read_activity,
    read_licenses,
)

__all__ = [
    "activity_from_orders",
    "conform_activity",
    "conform_licenses",
    "licenses_from_orders",
    "read_activity",
    "read_licenses",
]
