"""GPS accuracy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest accuracy, in metres, at which a fix is used.
LIMIT = 50


def gps_quality(accuracy: Column) -> Column:
    """excellent up to 3 m, good up to 10, warn up to 50, else bad; NaN and null are bad."""
    known = ~F.isnan(accuracy)
    return F.when(known & (accuracy <= 3), "excellent").when(known & (accuracy <= 10), "good").when(known & (accuracy <= LIMIT), "warn").otherwise("bad")


def gps_label(accuracy: Column) -> Column:
    # The words for each class.
    words = {"excellent": "Utmärkt", "good": "Bra", "warn": "Osäkert", "bad": "Otillräckligt"}
    quality = gps_quality(accuracy)
    word = F.lit(words["bad"])
    for k in ("excellent", "good", "warn"):
        word = F.when(quality == k, words[k]).otherwise(word)
    return F.concat(F.when(quality == "excellent", "★ ").otherwise(""), F.lit("GPS ± "), F.floor(accuracy + 0.5).cast("string"), F.lit(" m · "), word)
