"""All registered queries: importing this module registers them."""

from lodestrata.plans import catalog_models, catalog_more, catalog_survey, catalog_tables
from lodestrata.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "catalog_models", "catalog_more", "catalog_survey", "catalog_tables"]
