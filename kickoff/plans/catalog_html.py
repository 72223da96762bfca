"""Queries for HTML extraction (2.1): pages are built from the match tables,
then parsed back by the extraction jobs (round trip)."""

from __future__ import annotations

from ..sources import html as HT
from ..sources.standings import standings_snapshot
from .registry import query


@query("extract_fixtures")
def q_extract_fixtures(t):
    """Fixture rows parsed from one generated schedule page per (league, season)."""
    return HT.extract_fixtures(HT.fixtures_pages(t.matches()))


@query("extract_standings")
def q_extract_standings(t):
    """Standings rows parsed from pages whose table hides inside an HTML comment."""
    return HT.extract_standings(HT.standings_pages(standings_snapshot(t.matches())))
