"""Raw lookup results in a common form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.normalize import UNDEFINED

#: Results that mean that no reference applies.
NOTHING = ["NOT FOUND NO MATCH FOUND.", "UNDEFINED", "NONE", "", "*"]


def resolve_result(reference: Column, undefined_matters: bool = False) -> tuple[Column, Column]:
    """(ok, reference) of a raw result: natural N/A, nothing found, other failures.

    Nothing found is N/A, or a failure where undefined results matter.  A failure
    keeps its text in capitals; a file is in small letters.
    """
    up = F.coalesce(F.upper(F.trim(reference)), F.lit(UNDEFINED))
    natural = (up == "N/A") | up.startswith("NOT FOUND N/A")
    nothing = up.isin(NOTHING)
    failed = up.startswith("NOT FOUND") & ~natural & ~nothing
    if undefined_matters:
        failed = failed | nothing
    out = F.when(natural, "N/A").when(failed, up).when(nothing, "N/A").otherwise(F.lower(F.trim(reference)))
    return ~failed, out
