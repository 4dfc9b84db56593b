"""Language of a text by segmentation-marginalised unigrams.

Every language has a probability for each piece of one fixed public vocabulary, fitted by
expectation-maximisation on counted words of its labelled texts. A word's probability is
the sum over all its segmentations (forward algorithm), a text's the product over its
words; the language with the greatest posterior is predicted.

The classifier is fitted on a bounded sample: about ``fit_docs`` labelled documents a
language, dealt by a hash of the id, and their ``fit_words`` most frequent words. Every
text is scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordlens.llm.base import give_back, slices, table
from recordlens.llm.lattice import MARK, Pieces, fitted, with_ends, word_logs
from recordlens.session import written

VOCABULARY = "piece_bpe_32k.model"
#: Documents a language and words a language that the model is fitted on, and their longest.
FIT_DOCS, FIT_WORDS, FIT_LONGEST = 3000, 20_000, 64
UNKNOWN = "und"
#: Words whose scores a worker remembers, and their characters; beyond either the memory starts again.
REMEMBERED, REMEMBERED_CHARS = 100_000, 2_000_000
_WORD = re.compile(r"[^\W\d_]+")


def held_out() -> Column:
    """Documents kept from learning: remainder 2 of the id's CRC-32."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = [model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return Pieces(found, max(map(len, found)))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    probabilities: np.ndarray  # (pieces + unknown, languages)


def fit(docs: DataFrame, path: str | None = None, fit_docs: int = FIT_DOCS, fit_words: int = FIT_WORDS) -> Model:
    """Piece probabilities per language from rows of (doc_id, text, lang) not held out."""
    path = path or public_tokenizers.path(VOCABULARY)
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model((), np.zeros((1, 0)))
    share = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, fit_docs / n)))))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))
    words = chosen.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"))).alias("word"))
    counted = written(words.groupBy("lang", "word").agg(F.count("*").alias("n")), "language-words")
    columns = []
    for lang in sorted(counts):
        short = counted.filter((F.col("lang") == lang) & (F.char_length("word") <= FIT_LONGEST))
        top = short.orderBy(F.col("n").desc(), "word").limit(fit_words).toPandas()
        columns.append(fitted(vocabulary(path), [MARK + w for w in top["word"]], top["n"].to_numpy(dtype=np.float64)))
    return Model(tuple(sorted(counts)), np.hstack(columns))


def predicted(docs: DataFrame, model: Model, keep: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """The columns ``keep`` of docs, with lang_pred and score: the posterior under equal priors.

    A text that is null or without a letter, and any text when no language was learned, is
    ``und`` with score 0. Of equal posteriors the first language by name is taken. Rows are
    judged where they are, so repeated or null ids do no harm; kept columns of the two
    names are replaced.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    keep = [c for c in keep if c not in ("lang_pred", "score")]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary times languages

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, p = sent.value.languages, with_ends(sent.value.probabilities)
        pieces = vocabulary(path)
        number: dict[str, int] = {}
        logs, chars = np.zeros((0, len(languages))), 0
        for batch in batches:
            for piece in slices(batch, text, 1 << 20):
                texts = [_WORD.findall(t.lower()) if t else [] for t in piece.column(text).to_pylist()]
                if len(number) > REMEMBERED or chars > REMEMBERED_CHARS:
                    number, logs, chars = {}, logs[:0].copy(), 0
                new = list({w for words in texts for w in words if w not in number}) if languages else []
                if new:
                    number.update(zip(new, range(len(logs), len(logs) + len(new)), strict=True))
                    logs = np.concatenate([logs, word_logs(pieces, [MARK + w for w in new], p)])
                    chars += sum(map(len, new))
                langs, scores = [], []
                for words in texts:
                    if not languages or not (any(map(str.isalpha, words)) or any(c.isalpha() for w in words for c in w)):
                        langs.append(UNKNOWN), scores.append(0.0)
                        continue
                    total = logs[np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0)
                    best = int(total.argmax())
                    langs.append(languages[best]), scores.append(float(1 / np.exp(total - total[best]).sum()))
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])
        del number, logs
        give_back()

    rows = docs.select(*dict.fromkeys([*keep, text]))
    schema = T.StructType([rows.schema[c] for c in keep]).add("lang_pred", T.StringType()).add("score", T.DoubleType())
    return rows.mapInArrow(predict, schema)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language."""
    docs = table(spark, sf_dir, "documents")
    return predicted(docs, fit(docs), ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def reject_unclear_language(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Pipeline stage: documents whose language is found with at least ``least`` stay."""
    del spark, sf_dir
    names = [f"c{i}" for i in range(len(docs.columns))]  # documents may have columns of any name
    judged = predicted(docs.toDF(*names), fit(docs), names, names[docs.columns.index("text")])
    return judged.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*names).toDF(*docs.columns)
