"""Collects the oracle SQL of every query module."""

from __future__ import annotations


def all_oracles() -> dict[str, str]:
    from . import oracles, oracles_clean, oracles_eval, oracles_html, oracles_matrix, oracles_model, oracles_requests, oracles_stats  # noqa: F401
    return dict(oracles.ORACLES)
