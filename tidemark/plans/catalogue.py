"""All queries of the library; importing the plan modules registers them."""

from . import models, notes, pages, recordings, signals, slides  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
