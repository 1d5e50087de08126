"""Registered queries; importing this package fills the registry."""

from fathom.plans import registry  # noqa: F401  isort: skip
from fathom.plans import mutation_queries, search_queries, text_queries, usage_queries  # noqa: F401
