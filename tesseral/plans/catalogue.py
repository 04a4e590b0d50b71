"""All queries and oracles of the core."""

from __future__ import annotations

from tesseral.plans import actions, flows, lookups, reports, scans, sessions, streams, texts, training

_MODULES = [training, sessions, flows, texts, reports, actions, lookups, scans, streams]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
