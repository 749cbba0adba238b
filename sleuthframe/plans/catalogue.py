"""Every query of the library by name, with the SQL that it is held against."""

from __future__ import annotations

from sleuthframe.plans import queries_alerts, queries_correlation, queries_dossiers, queries_evaluation, queries_graph, queries_ingest, queries_ledgers, queries_links, queries_records, queries_reports, queries_rollups, queries_statistics

MODULES = (queries_rollups, queries_graph, queries_statistics, queries_alerts, queries_links, queries_correlation, queries_evaluation, queries_ingest, queries_ledgers, queries_records, queries_dossiers, queries_reports)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
FLAGSHIP = "daily_lanes_expected"
