"""Queries over the driver tables with the SQL each must agree with."""

import importlib
import importlib.util

AREAS = ("scalars", "labels", "users", "catalog", "lab", "build", "studies", "frames", "pages", "streams", "stores", "fragments", "keywords", "regulatory")


def load_all() -> None:
    for area in AREAS:
        if importlib.util.find_spec(f"provisor_checks.{area}"):
            importlib.import_module(f"provisor_checks.{area}")
