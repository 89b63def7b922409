"""Declared schemas of the tables the package reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

N_YEARS = 6
N_FEATURES = 512

# Column names shared by case tables and score files.
SCORE_PREFIX = "pred_risk_year_"
FEATURE_PREFIX = "feature_"


def score_columns(years: int = N_YEARS) -> list[str]:
    return [f"{SCORE_PREFIX}{i}" for i in range(years)]


CASES = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in [
            ("pid", T.StringType()),
            ("timepoint", T.StringType()),
            ("scan", T.StringType()),
            ("AccessionNumber", T.StringType()),
            ("SliceThickness", T.DoubleType()),
            ("ConvolutionKernel", T.StringType()),
            ("ImageOrientationPatient", T.StringType()),
            ("PatientID", T.StringType()),
            ("Directory", T.StringType()),
            ("Orientation", T.StringType()),
        ]
    ]
)

CLINICAL = T.StructType(
    [T.StructField("pid", T.LongType())]
    + [T.StructField(f"scr_days{i}", T.DoubleType()) for i in range(3)]
    + [
        T.StructField("candx_days", T.DoubleType()),
        T.StructField("fup_days", T.DoubleType()),
        T.StructField("conflc", T.IntegerType()),
    ]
)

NODULES = T.StructType(
    [
        T.StructField("pid", T.StringType()),
        T.StructField("Nodule Number", T.IntegerType()),
        T.StructField("Nodule Center x,y Position*", T.StringType()),
        T.StructField("Nodule Center Image", T.IntegerType()),
        T.StructField("Final Diagnosis", T.StringType()),
        T.StructField("diagnosis", T.IntegerType()),
    ]
)


def scored(base: T.StructType, years: int = N_YEARS) -> T.StructType:
    """A case schema followed by one score column per year."""
    return T.StructType(
        base.fields + [T.StructField(c, T.DoubleType()) for c in score_columns(years)]
    )
