"""Query plans: bindings of the driver's tables, the curated table, and the
registry of named jobs with their SQL oracle."""
from . import q_analysis, q_curation, q_explore, q_intake, q_models, q_records  # noqa: F401  (registration side effects)
from .registry import ORACLE, QUERIES  # noqa: F401
