"""Imports every query module, so that the registry is complete."""

from . import boundaries, carriers, catalogues, corridors, coverage, extras, ledgers, live, matching, networks, shapes, spatial, traces  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
