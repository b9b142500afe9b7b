"""All registered mesh queries."""

from facetry.plans import adapt_queries, balance_queries, box_queries, build_queries, check_queries, file_queries, model_queries, shape_queries, table_queries  # noqa: F401
from facetry.plans.catalog import ORACLES, QUERIES  # noqa: F401
