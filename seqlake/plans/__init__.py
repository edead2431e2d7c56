"""Registered queries (one per operator) and their oracle SQL."""

from seqlake.plans.registry import ORACLE, QUERIES


def load_all() -> None:
    """Import every query module so that it registers itself."""
    from seqlake.plans import (q_losses, q_models, q_probe, q_runlog, q_tiling,  # noqa: F401
                               q_workflows)


__all__ = ["ORACLE", "QUERIES", "load_all"]
