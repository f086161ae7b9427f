"""Queries by topic; importing a module registers what it defines."""

from importlib import import_module

TOPICS = ("windows", "alignment", "cleaning", "performance", "allocation", "models", "storage")


def load() -> None:
    for topic in TOPICS:
        import_module(f"panelloom.plans.catalog.{topic}")
