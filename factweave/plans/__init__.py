"""Composed queries, registered by name with their oracle SQL."""

#: Modules that register queries when imported.
MODULES: tuple[str, ...] = ("items", "ledger", "audits", "compositions", "set_versions", "coverage", "entities", "searches", "details", "domains", "streams")
