"""Token counts of whole texts by rank-synchronous array merging (see bpe)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texlith.llm._common import as_texts
from texlith.llm.bpe import loaded


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs(doc_id, text, ...).

    One pass without a shuffle. A null text is empty: 0 bytes, 0 tokens. Repeated rows give repeated rows; an empty
    table gives none; other columns aren't read. Special strings inside a text are the special tokens that they are by
    the library's default. A text is encoded whole, however long.
    """

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(path)
        for batch in rows:
            n = bpe.counts(as_texts(batch["text"]))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "n_tokens": n, "over_limit": np.asarray(n > limit)})

    kept = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return kept.mapInPandas(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
