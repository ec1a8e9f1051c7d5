"""Price-history and deal-rule analytics as plain PySpark DataFrame operators."""

from tidemark.session import configure, cut_lineage

__all__ = ["configure", "cut_lineage"]
