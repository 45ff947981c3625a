"""Operators of a training-data pipeline and their registered queries."""

from geomart.llm import queries as _queries  # noqa: F401
from geomart.llm.registry import ORACLE, QUERIES  # noqa: F401
