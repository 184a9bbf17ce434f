"""Byte-level BPE over a table of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.llm.byte_bpe import codec
from courtside.llm.common import map_batches, texts_of


def encode_texts(docs: DataFrame, path: str, pattern: str, text_column: str = "text", decode: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (binary: little-endian unsigned 32-bit integers) in the place of the text column.

    With ``decode`` there is also ``decoded``, the bytes that the ids stand for. NULL and empty texts have no ids; every
    other column, NULL or not, and every repeated row passes through. Every worker reads ``path`` from its own installation.
    """
    rest = [c for c in docs.columns if c != text_column]
    fields = [f for f in docs.schema.fields if f.name != text_column]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        code = codec(path, pattern)
        ids = code.encode_all(texts_of(batch, text_column))
        columns = [*(batch.column(c) for c in rest), pa.array(ids, pa.binary())]
        if decode:
            columns.append(pa.array([code.decode(np.frombuffer(i, "<u4").tolist()) for i in ids], pa.binary()))
        return pa.record_batch(columns, [*rest, "ids", *["decoded"] * decode])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return map_batches(docs.select(*rest, F.col(text_column)), run, (schema + ", " if schema else "") + "ids binary" + ", decoded binary" * decode)
