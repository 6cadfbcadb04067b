"""All queries of the library but those of the corpus operators."""

from . import evaluating, knowledge, more, operations, runs, values  # noqa: F401  (they register their queries)
from .registry import QUERIES, SQL  # noqa: F401
