"""All registered queries of the library."""

from __future__ import annotations

from .. import registry
from . import access, analytics, answers, classify, compile, knowledge, pages, playbooks, rank, reconcile, records, sections, sources, text  # noqa: F401

QUERIES, SQL = registry.QUERIES, registry.SQL
