"""Token counts: batches of texts are encoded inside Arrow functions, lengths alone come back.

Texts go to the tokenizers library as pieces: a long text is split where the vocabulary's
pre-tokenizer never joins (a single space between two words), so that the pieces' lengths
add up to the text's. Pieces are gathered into batches of about the same number of bytes,
whatever texts they are of; so a batch is neither many long texts nor few short ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlens.llm.base import slices, table
from recordlens.llm.bytebpe import safe_pieces, tokenizer

VOCABULARY = "byte_bpe_50k.json"


def balanced(texts: list[str], batch_bytes: int) -> Iterator[tuple[list[int], list[str]]]:
    """(numbers of texts, pieces): all pieces in order, about ``batch_bytes`` bytes at a time.

    A piece has a sixteenth of a batch, or goes on to its next safe place; a batch holds one
    piece at least.
    """
    owners, pieces, held = [], [], 0
    for i, t in enumerate(texts):
        for p in safe_pieces(t, max(1, batch_bytes // 16)):
            n = len(p) if p.isascii() else len(p.encode())
            if pieces and held + n > batch_bytes:
                yield owners, pieces
                owners, pieces, held = [], [], 0
            owners.append(i)
            pieces.append(p)
            held += n
    if pieces:
        yield owners, pieces


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, batch_bytes: int = 1 << 18) -> DataFrame:
    """(key, n_bytes, n_tokens) of every whole text; null and empty texts have none.

    ``vocabulary`` is a file for the tokenizers library, which encodes batches of about
    ``batch_bytes`` bytes. Repeated rows each get a row, an empty table gives none; other
    columns of ``docs`` are not read.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                found = [0] * part.num_rows
                for owners, pieces in balanced([t or "" for t in part.column("text").to_pylist()], batch_bytes):
                    for i, e in zip(owners, tok.encode_batch_fast(pieces, add_special_tokens=False), strict=True):
                        found[i] += len(e)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("n_bytes"), pa.array(found, pa.int64())], names=["key", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(count, f"key {kind}, n_bytes long, n_tokens long").withColumnRenamed("key", key)


def op5_token_counts(spark: SparkSession, sf_dir: str, limit: int = 512) -> DataFrame:
    """Every document's bytes and tokens, and whether it is over the limit.

    A null or empty text has no bytes and no tokens; each row of a repeated doc_id is counted.
    """
    return token_counts(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > limit)
