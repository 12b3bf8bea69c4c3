"""Registered queries over the test tables.

Each query is ``fn(spark, sf_dir) -> DataFrame`` built from the library, and
most carry the equivalent DuckDB SQL used as the correctness oracle."""

from civitas.plans.registry import ORACLES, QUERIES  # noqa: F401
from civitas.plans import (clean, ingest, link, marts, analytics, incremental,  # noqa: F401,E402
                           designed, serving)
