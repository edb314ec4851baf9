"""Visually identical text with different characters, brought to one consistent form.

Accents are composed onto their letters, full-width forms and odd spaces become ordinary ones, invisible
signs go, and look-alike letters of other alphabets become Latin in words that can be read as Latin. Words of
another alphabet, joiners within emoji, tabs, line ends, dashes and quotes stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tamarind.llm import codepoints as C


def canonical_text(df: DataFrame, text: str, out: str = "canonical", flag: str = "changed") -> DataFrame:
    """df plus the canonical form of column `text`, and whether it differs from the stored text.

    A null text stays null and has not changed; an empty one stays empty. Texts of any length are worked on
    whole. Columns of df that are named like `out` or `flag` are replaced.
    """
    df = df.drop(*({out, flag} - {text}))
    if text in (out, flag):
        raise ValueError(f"{text} can't be both read and written")
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), T.StructField(flag, T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in C.pieces(whole, text):
                col = b.column(text)
                cps, off, changed = C.canonical(*C.to_codepoints(col))
                made = C.to_arrow(cps, off, np.asarray(col.is_valid()))
                yield pa.RecordBatch.from_arrays([*b.columns, made, pa.array(changed)], [*b.schema.names, out, flag])

    return df.mapInArrow(run, schema)
