"""Code lists: loading user-supplied lists, and the published lists used by the registered queries and tests.

A code list maps a clinical code to one or more tag columns.  Every list is
normalised to a DataFrame whose key column is called ``code`` (string) and
whose other columns (description and tags) keep their names, so
``tag_codes`` can carry them onto journal rows.

* ``read_codelist`` reads a CSV in the published format (header row, every
  column a string, optional UTF-8 BOM and CRLF line ends; Spark's CSV reader
  strips the BOM and the CR).
* ``codelist_df`` gives one of the published lists, which are kept as files in
  ``phenoframe/codelists`` (fixed values, in file order: the banding rules
  give the published categories only with these).  Its optional ``ix`` is
  the 0-based position in the list, by which the synthetic journal picks codes.

The smoking list repeats most of its rows.  They stay: tagging with a list
that repeats a code multiplies journal rows, as a join does.
"""

from __future__ import annotations

import csv
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FOLDER = Path(__file__).resolve().parent.parent / "codelists"

# Key column of each published list, and the name it gets.
KEYS = {
    "bmi": ("ConceptID", "code"),
    "height": ("ConceptID", "code"),
    "weight": ("ConceptID", "code"),
    "glucose": ("ConceptId", "code"),
    "bp": ("ConceptId", "code"),
    "smoking": ("SNOMED_concept_ID", "code"),
    "ethnicity": ("ConceptId", "code"),
    "ethnic_labels": ("ETHNIC CATEGORY ID", "ETHNIC_CATEGORY_ID"),
}

# FIXED VALUES: values of an ethnic-category field that mean "unknown"; NULL is unknown too.
UNKNOWN_ETHNIC_VALUES = ["Z", "z", "X", "x", "99", "9", "", " "]


def codelist_path(name: str) -> str:
    """File of a published list."""
    return str(FOLDER / f"{name}.csv")


@lru_cache(maxsize=None)
def codelist_rows(name: str) -> tuple[list[tuple], list[str]]:
    """Rows (0-based ``ix``, key, other columns) of a published list, and the names of the other columns."""
    with open(codelist_path(name), encoding="utf-8-sig", newline="") as f:
        header, *rows = list(csv.reader(f))
    key = header.index(KEYS[name][0])
    others = [i for i in range(len(header)) if i != key]
    return ([(n, r[key], *(r[i] for i in others)) for n, r in enumerate(rows)],
            [header[i].strip().replace(" ", "_") for i in others])


_MEMO: dict = {}


def codelist_df(spark: SparkSession, name: str, with_ix: bool = False) -> DataFrame:
    """A published list as a DataFrame: key, description and tags (and ``ix``).

    The same DataFrame object is returned for the same session and list,
    so the size check made before broadcasting it runs once."""
    memo_key = (id(spark), name, with_ix)
    hit = _MEMO.get(memo_key)
    if hit is not None and hit[0] is spark:
        return hit[1]
    rows, others = codelist_rows(name)
    schema = T.StructType([T.StructField("ix", T.IntegerType(), False), T.StructField(KEYS[name][1], T.StringType(), False)]
                          + [T.StructField(c, T.StringType(), True) for c in others])
    df = spark.createDataFrame(rows, schema)
    df = df if with_ix else df.drop("ix")
    _MEMO[memo_key] = (spark, df)
    return df


def read_codelist(spark: SparkSession, path: str, key: str, rename: dict[str, str] | None = None) -> DataFrame:
    """Read a published CSV code list; every column is a string.

    ``key`` is the code column in the file (its case varies between lists);
    it becomes ``code``.  ``rename`` renames other columns.
    """
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    # Header cells can carry stray whitespace or a CR; tidy them once.
    for c in df.columns:
        clean = c.strip().lstrip("﻿")
        if clean != c:
            df = df.withColumnRenamed(c, clean)
    df = df.withColumnRenamed(key, "code")
    for old, new in (rename or {}).items():
        df = df.withColumnRenamed(old, new)
    return df
