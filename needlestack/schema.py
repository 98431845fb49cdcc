"""Fixed column names and feature sets of the statistics table."""

from __future__ import annotations

from pyspark.sql import types as T

# The 30 positional columns of a statistics log.
STAT_COLUMNS = [
    "Magnitude", "clipped_sigma", "meaningless_1", "meaningless_2", "star_ID",
    "weighted_sigma", "skew", "kurt", "I", "J", "K", "L", "Npts", "MAD", "lag1",
    "RoMS", "rCh2", "Isgn", "Vp2p", "Jclp", "Lclp", "Jtim", "Ltim", "CSSD", "Ex",
    "inv_eta", "E_A", "S_B", "NXS", "IQR",
]

# Columns each feature set leaves out.
FEATURE_SET_DROPS = {
    "A": ["Magnitude", "meaningless_1", "meaningless_2", "star_ID", "Npts", "CSSD"],
    "B": ["meaningless_1", "meaningless_2", "star_ID", "Npts", "CSSD",
          "clipped_sigma", "lag1", "L", "Lclp", "Jclp", "MAD", "Ltim"],
    "C": ["Magnitude", "meaningless_1", "meaningless_2", "star_ID", "Npts"],
}

# Columns that go through a natural logarithm when present.
LOG_COLUMNS = ["clipped_sigma", "weighted_sigma", "RoMS", "rCh2", "Vp2p", "Ex",
               "inv_eta", "S_B"]

ID_COLUMN = "star_ID"
LABEL = "variable"


def stat_schema(names=STAT_COLUMNS, id_col: str = ID_COLUMN) -> T.StructType:
    return T.StructType([
        T.StructField(n, T.StringType() if n == id_col else T.DoubleType()) for n in names
    ])


def feature_columns(feature_set: str) -> list[str]:
    dropped = set(FEATURE_SET_DROPS[feature_set])
    return [c for c in STAT_COLUMNS if c not in dropped]
