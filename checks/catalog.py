"""All registered queries, in survey order."""

from checks import sources, scalars, filters_joins, aggregates, windows_topk, sampling_labels, volumes, stencils, candidates, pooling_metrics, streams_udfs, jobs  # noqa: F401
from checks.registry import QUERIES, SQL  # noqa: F401
