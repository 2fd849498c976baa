"""All registered queries of the library's core and their SQL twins."""

from . import basics, checks, lineage, selection, streams  # noqa: F401
from .inputs import ORACLES, QUERIES  # noqa: F401
