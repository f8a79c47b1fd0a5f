from prosegauge.queries import corpus, ranges, records, responses, texts  # noqa: F401
from prosegauge.queries.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
