"""Encoding of a text column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.bpe import TOKENIZERS, encoder, raw, slices


def encode(df: DataFrame, id_col: str, text_col: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id_col, ids array<int>) of each row, without special tokens; strings that look like some are ordinary text.
    An empty and a null text have an empty list. One pass without a shuffle; whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, folder)
        for b in batches:
            data, off = raw(b.column(1))
            for i, j in slices(off):
                ids, ends = enc.encode_batch(data, off[i : j + 1])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), lists], [id_col, "ids"])

    src = df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    out = T.StructType([T.StructField(id_col, src.schema[0].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return src.mapInArrow(run, out)


def token_counts(df: DataFrame, id_cols: list[str], text_col: str, tokenizer: str, folder: str = TOKENIZERS) -> DataFrame:
    """(id_cols, n_tokens bigint) of each row; 0 for an empty and a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, folder)
        for b in batches:
            data, off = raw(b.column(len(id_cols)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(id_cols)], pa.array(enc.counts(data, off), pa.int64())], [*id_cols, "n_tokens"])

    src = df.select(*id_cols, F.col(text_col).cast("string").alias("_text"))
    return src.mapInArrow(run, T.StructType([*src.schema.fields[:-1], T.StructField("n_tokens", T.LongType())]))
