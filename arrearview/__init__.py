"""Batch jobs on Spark for watching the quality of a consumer-loan book."""

from arrearview.book import LoanBook
from arrearview.params import Definitions

__all__ = ["Definitions", "LoanBook"]
