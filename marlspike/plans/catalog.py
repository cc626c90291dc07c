"""Every query of the core by name, and the SQL that gives the same rows."""

from __future__ import annotations

from marlspike.operators import instants
from marlspike.plans import monitoring, search, surfaces, tpch


def queries() -> dict:
    return {"p2_found": instants.p2_found} | search.QUERIES | monitoring.QUERIES | surfaces.QUERIES | tpch.QUERIES


def oracles() -> dict[str, str]:
    return search.ORACLES | monitoring.ORACLES | surfaces.ORACLES | tpch.ORACLES
