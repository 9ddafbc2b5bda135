"""Every query over the shared tables, by name, with its SQL twin."""

from __future__ import annotations

from . import events, leads, loops, openings, reports, texts, web

MODULES = (leads, reports, events, loops, openings, texts, web)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLES.items()}
