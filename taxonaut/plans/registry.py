"""All registered queries: name -> (function of session and folder, DuckDB SQL or None)."""

from . import answer_queries, axis_queries, computed_queries, evaluation_queries, fact_queries, match_queries, metric_queries, ranking_queries, requirement_queries, step_queries, subheading_queries, text_queries

QUERIES = {**match_queries.QUERIES, **metric_queries.QUERIES, **text_queries.QUERIES, **step_queries.QUERIES, **axis_queries.QUERIES, **fact_queries.QUERIES, **ranking_queries.QUERIES, **requirement_queries.QUERIES, **subheading_queries.QUERIES, **answer_queries.QUERIES, **evaluation_queries.QUERIES, **computed_queries.QUERIES}
FLAGSHIP = "g15_rule_only_accuracy"
