"""Cohort selection, survival labels and risk-score evaluation on Spark DataFrames."""
