from __future__ import annotations

from importlib import import_module
from pathlib import Path


def load_all():
    """Import every ``queries_*`` module and return the registry."""
    for path in sorted(Path(__file__).parent.glob("queries_*.py")):
        import_module(f"marketspark.plans.{path.stem}")
    from marketspark.plans.registry import REGISTRY

    return dict(REGISTRY)
