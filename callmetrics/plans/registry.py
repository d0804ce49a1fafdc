"""All queries of the engine and their SQL."""

from __future__ import annotations

from callmetrics.plans import calls, checks, stores, study, sweeps

QUERIES = {**calls.QUERIES, **study.QUERIES, **checks.QUERIES, **sweeps.QUERIES, **stores.QUERIES}
SQL = {**calls.SQL, **study.SQL, **checks.SQL, **sweeps.SQL, **stores.SQL}
