"""Delimited files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions.names import default_name, unique_names
from ..operators.columns import rename_header
from ..operators.typing import apply_types


def read_csv(
    spark: SparkSession,
    path: str,
    header: bool | Sequence[str] = True,
    delimiter: str = ",",
    quote_char: str = '"',
    infer: bool = True,
    multiline: bool = False,
) -> DataFrame:
    """Read delimited files.

    ``header`` True: the first line has the names; a list: the names; False: default
    names. ``infer`` casts every column to the narrowest type all its values parse as.
    ``multiline`` allows line breaks inside quotes, at the price that no file is split.
    """
    options = dict(sep=delimiter, quote=quote_char, escape=quote_char, inferSchema=False, multiLine=multiline)
    plain = spark.read.csv(path, header=False, **options)
    names = header or []
    if header is True:
        first = plain.first()
        names = [cell or "" for cell in first] if first else []
        folded = [n.lower() for n in names]
        # Spark checks every file against the names, which it can only do where they differ
        differ = len(set(folded)) == len(folded) and "" not in folded
        plain = spark.read.csv(path, header=True, enforceSchema=not differ, **options)
    default = plain.toDF(*[default_name(i) for i in range(len(plain.columns))])
    named = default.toDF(*unique_names(rename_header(default, names).columns))
    return apply_types(named) if infer else named


def write_csv(
    df: DataFrame,
    path: str,
    delimiter: str = ",",
    quote_char: str = '"',
    header: bool = True,
    mode: str = "error",
) -> None:
    """Write delimited files into the folder ``path``; only cells that need it are quoted.

    Empty text is written like NULL, as nothing between two delimiters.
    """
    df.write.csv(
        path, mode=mode, header=header, sep=delimiter, quote=quote_char, escape=quote_char, emptyValue=""
    )
