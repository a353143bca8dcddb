"""How queries and their SQL are put down together."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable:
        def add(query: Callable) -> Callable:
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query

        return add


#: The clean relations of ``folioscope.sources.tables`` in SQL.
SYNC = "(SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY synced_at DESC NULLS LAST, process_status DESC NULLS LAST, retry_count DESC NULLS LAST, content_hash DESC NULLS LAST) AS n FROM sync_state) WHERE n = 1)"
CHUNKS = "(SELECT DISTINCT * FROM chunks)"
SECTIONS = "(SELECT DISTINCT * FROM parsed_sections)"
LOG = "(SELECT DISTINCT * FROM processing_log)"
PARSED = "(SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY parsed_at DESC NULLS LAST) AS n FROM parsed_documents) WHERE n = 1)"
POINTS = "(SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY embedded_at DESC NULLS LAST, vector DESC NULLS LAST) AS n FROM vector_points) WHERE n = 1 AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0)"
ISO = r"CASE WHEN regexp_full_match({c}, '\d{{4}}-\d{{2}}-\d{{2}}([T ]\d{{2}}:\d{{2}}(:\d{{2}}(\.\d{{1,6}})?)?([+-]\d{{2}}:?\d{{2}}|Z)?)?') THEN TRY_CAST({c} AS TIMESTAMPTZ) END"
NOW = "2020-02-01 00:00:00"
