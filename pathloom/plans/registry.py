"""All queries of the process-mining operators and their SQL, by name."""

from __future__ import annotations

from pathloom.plans import analytics, basics

QUERIES = {**basics.QUERIES, **analytics.QUERIES}
ORACLES = {**basics.ORACLES, **analytics.ORACLES}
