"""Named queries over the given tables, with the SQL each is checked against."""

import importlib

MODULES = ("network", "spatial", "rollups", "lookups", "documents", "routing", "audits", "checks", "sqlsurface", "storage")


def _load():
    from placegraph.catalog import base

    for m in MODULES:
        importlib.import_module(f"placegraph.catalog.{m}")
    return base


def queries():
    return dict(_load().QUERIES)


def oracle_sql():
    return dict(_load().ORACLE)
