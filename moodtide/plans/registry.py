"""Every query by name and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from . import choices, disclosure, forecasts, grid, observations, outcomes, policies, proofs, readers, replays, resampling, rotations, schedules, sentiment, signals, statistics, streams, studies, tables, trading

_PLANS = (sentiment, outcomes, statistics, trading, disclosure, forecasts, studies, policies, signals, observations, readers, grid, schedules, proofs, streams, tables, replays, rotations, choices, resampling)
QUERIES: dict = {k: v for p in _PLANS for k, v in p.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for p in _PLANS for k, v in p.ORACLES.items()}
FLAGSHIP = "sentiment_composite"
