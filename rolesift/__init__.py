"""rolesift: a PySpark engine that discovers, screens, scores and ranks postings."""

__version__ = "0.1.0"
