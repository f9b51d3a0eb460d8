"""All named queries: importing this package fills the registry."""

from colophon.plans import catalogue, coverage, records, resolution, services  # noqa: F401
from colophon.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
