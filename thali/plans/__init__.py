"""Query registry: importing this package registers every named query."""

from thali.plans import q_changes, q_display, q_kpis, q_listings, q_streams  # noqa: F401
from thali.plans.registry import AS_OF, EVENTS_AS_OF, REGISTRY

__all__ = ["REGISTRY", "AS_OF", "EVENTS_AS_OF"]
