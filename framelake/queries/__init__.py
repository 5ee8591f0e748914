"""All registered queries of the media engine and their SQL for DuckDB."""

from __future__ import annotations

from ..model import with_inputs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query (spark, sf_dir) -> DataFrame, with its SQL where there is one."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = with_inputs(sql)
        return f

    return add


from . import analysis, audio, codes, color, document, geometry, imaging, timeline  # noqa: E402, F401
