"""Query plans over the driver's tables."""

from proofline.plans import assembly_queries, extraction_queries, further_queries, graph_queries, matching_queries, model_queries, source_queries, text_queries, whole_model_queries  # noqa: F401
from proofline.plans.registry import QUERIES, SQL  # noqa: F401
