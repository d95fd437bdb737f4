"""All registered queries."""
from . import (check_queries, directory_queries, match_queries, page_queries, report_queries, rule_queries, source_queries, text_queries,
               timeline_queries, visit_queries)

CATALOG: dict = {}
for _module in (visit_queries, source_queries, text_queries, match_queries, directory_queries, report_queries, rule_queries, page_queries,
                check_queries, timeline_queries):
    CATALOG.update(_module.C)
