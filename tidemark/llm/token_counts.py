"""Token counts by heap-and-linked-list byte-pair merging: symbols less merges, no
ids. Counts equal the library's (identity normalisation, a leading space mark, byte
fallback, no special tokens).

Defined results: a null text is empty and has 0 bytes and 0 tokens; special strings
are ordinary text; rows are independent, so ties and repeats are simply repeated;
texts of any length are counted whole; extra columns do not enter; an empty table
gives no rows.
"""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces
from .common import read

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
ROWS = 512


def count_tokens(df: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row; model: a path that every executor has."""

    def count(batches):
        path = model or public_tokenizers.path(MODEL)
        segments, memo = pieces.load(path).segments, pieces.counts(path)
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                n = [sum(map(memo.__getitem__, segments(t))) if t else 0 for t in part.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("t"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op7_token_counts": op7_token_counts}
