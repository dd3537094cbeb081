"""phenoframe: patient phenotyping on Spark DataFrames.

Turns long tables of coded, dated observations into one agreed category per
patient (BMI, blood pressure, blood glucose, smoking, ethnic category).
"""

from .schemas import KEY, JOURNAL_SCHEMA, normalise_journal  # noqa: F401

__version__ = "0.1.0"
