"""Template filters ``{{NAME|filter}}``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom.functions.text import json_string, trim

FILTERS = ["upper", "lower", "title", "bool", "int", "json"]


def apply_filter(name: Column, value: Column) -> Column:
    """Filtered value; null when ``|int`` gets something that is not an integer."""
    # Only an optional sign and ASCII digits count as an integer; try_cast alone would also trim spaces.
    as_int = F.when(value.rlike(r"\A[+-]?[0-9]+\z"), value.try_cast("bigint").cast("string"))
    default = F.substr(name, F.lit(len("default:") + 1))
    return (
        F.when(name.isNull(), value)
        .when(name == "upper", F.upper(value))
        .when(name == "lower", F.lower(value))
        .when(name == "title", F.concat(F.upper(F.left(value, F.lit(1))), F.substr(value, F.lit(2))))
        .when(name == "bool", F.lower(value).isin("true", "yes", "1").cast("string"))
        .when(name == "int", as_int)
        .when(name == "json", json_string(value))
        .when(name.startswith("default:"), F.when(trim(value) == "", default).otherwise(value))
    )
