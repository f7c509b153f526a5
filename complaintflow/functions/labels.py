"""Cleaning of human-written labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from complaintflow.functions.text import SPACE, squeeze, strip

NUMBER_PREFIX = rf"^\p{{Nd}}+(\.\p{{Nd}}+)*\.?[{SPACE}]*"


def clean_label(c: Column) -> Column:
    """Without numeric prefix (``1.1.1``), with single blanks; null when nothing is left."""
    return F.nullif(squeeze(F.regexp_replace(strip(c), NUMBER_PREFIX, "")), F.lit(""))
