"""Named queries: every operator bound to the given tables."""

from __future__ import annotations

import importlib

from pyspark import cloudpickle

import sightline

# Python functions travel to the executors by value, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sightline)

MODULES = [
    "columns",
    "filters",
    "joins",
    "aggregates",
    "windows",
    "selection",
    "sets",
    "jobs",
    "models",
    "files",
    "streams",
]


def load_all() -> None:
    for name in MODULES:
        importlib.import_module(f"sightline.catalog.{name}")
