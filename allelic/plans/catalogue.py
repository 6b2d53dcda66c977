"""All plans by name."""

from . import cohort, generated, variants  # noqa: F401
from .base import PLANS

QUERIES = {name: f for name, (f, _) in PLANS.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in PLANS.items() if sql}
