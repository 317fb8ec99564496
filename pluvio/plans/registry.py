"""All queries of the engine and their DuckDB twins."""

from __future__ import annotations

from pluvio.plans import file_queries, mosaic_queries, pixel_queries, replay_queries, rule_queries, scalar_queries

QUERIES = {**pixel_queries.QUERIES, **scalar_queries.QUERIES, **rule_queries.QUERIES, **file_queries.QUERIES, **replay_queries.QUERIES, **mosaic_queries.QUERIES}
SQL = {**pixel_queries.SQL, **scalar_queries.SQL, **rule_queries.SQL, **file_queries.SQL, **replay_queries.SQL, **mosaic_queries.SQL}

#: Names of earlier queries for what these now do.
OTHER_NAMES = {"exact_colour_count": "exact_colour_hits", "max_cell_confidence": "tracked_confidence", "config_validation": "config_checks", "style_dimension": "base_map_urls"}
for _old, _new in OTHER_NAMES.items():
    QUERIES[_old], SQL[_old] = QUERIES[_new], SQL[_new]
