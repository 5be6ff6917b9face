"""Importing this module registers every query."""

from veilspark.catalog import (  # noqa: F401
    analysis,
    modelling,
    risk,
    searches,
    signtests,
    storage,
    studies,
    techniques,
)
from veilspark.catalog.base import ORACLE, QUERIES  # noqa: F401
