"""The registered queries and their checks."""

from arrearview.workload import layers, vintage_queries, contract_queries, cohort_queries, quality_queries
from arrearview.workload import findings_queries  # composed of the checks registered before
from arrearview.workload.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES", "layers", "vintage_queries", "contract_queries", "cohort_queries", "quality_queries",
           "findings_queries"]
