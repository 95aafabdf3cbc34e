"""Operator 8: language identification by compression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import fresh, local_rows

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    """A zstandard raw-content dictionary per language, and how texts are measured against them."""

    dictionaries: dict[str, bytes]
    chunk: int = 1024
    narrow: float = 0.01


def learn(docs: DataFrame, train: Column, pieces: int = 1024, piece_chars: int = 128, narrow: float = 0.01, most_languages: int = 4096, total_bytes: int = 64 << 20) -> LanguageModel:
    """Cut a dictionary per language out of the training rows.

    Texts are dealt by hash into ``pieces`` bins per language; each bin gives ``piece_chars`` characters, from a
    hash-chosen place, of the text with the smallest hash, so that copies count once and no language is gathered. The sample
    is bounded by pieces * piece_chars characters per language and by total_bytes over all languages. Only ``text``
    and ``lang`` of rows where ``train`` holds are read; null texts and null languages are left out. Letter case is
    folded. Languages are kept in order of their training rows, most first: ties go to the commoner one.
    """
    size = F.greatest(F.length("text") - piece_chars, F.lit(0)) + 1
    rows = (
        docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0))
        .select(F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("h"), "text", size.alias("places"))
        .select("lang", "h", F.col("text").substr((F.pmod(F.col("h"), F.col("places")) + 1).cast("int"), F.lit(piece_chars)).alias("piece"))
        .groupBy("lang", F.pmod(F.shiftrightunsigned("h", 7), F.lit(pieces)).alias("bin")).agg(F.min(F.struct("h", "piece")).alias("first"), F.count("*").alias("n"))
        .select("lang", "bin", F.col("first.piece").alias("piece"), "n")
    )
    found: dict[str, list] = {}
    for r in local_rows(rows, pieces * most_languages):
        found.setdefault(r["lang"], []).append((r["bin"], r["piece"], r["n"]))
    room = total_bytes // max(1, len(found))
    dictionaries = {}
    for lang in sorted(found, key=lambda x: (-sum(r[2] for r in found[x]), x)):
        content = "\n".join(p for _, p, _ in sorted(found[lang])).lower().encode()
        dictionaries[lang] = content[-min(room, pieces * piece_chars * 4) :]
    return LanguageModel(dictionaries, narrow=narrow)


def sizes(texts: list[bytes], model: LanguageModel) -> np.ndarray:
    """Compressed bytes of every text under every language's dictionary; long texts are measured chunk by chunk, whole."""
    import zstandard as zstd

    out = np.zeros((len(texts), len(model.dictionaries)), dtype=np.int64)
    params = zstd.ZstdCompressionParameters.from_level(3, min_match=3, search_log=5, strategy=zstd.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False)
    for j, content in enumerate(model.dictionaries.values()):
        dictionary = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=params)
        compress = zstd.ZstdCompressor(dict_data=dictionary, compression_params=params).compress
        for i, text in enumerate(texts):
            out[i, j] = sum(len(compress(text[k : k + model.chunk])) for k in range(0, len(text), model.chunk))
    return out


def identify(docs: DataFrame, model: LanguageModel, columns: list[str]) -> DataFrame:
    """The language of every whole text: the one whose dictionary compresses it to the fewest bytes.

    Returns ``columns`` and lang_pred, score, narrow. ``und`` with score 0 marks null texts, texts without a letter
    and a model without languages. score is a softmax of the relative sizes; ties go to the language with more
    training rows; ``narrow`` is true where the runner-up is within ``model.narrow`` of the best size, and also
    where the text is ``und``: callers that want rejection drop those rows (see ``reject``). Input columns of the
    three names are replaced.
    """
    import regex

    names = list(model.dictionaries)
    columns = [c for c in columns if c not in ("lang_pred", "score", "narrow")]
    bc = docs.sparkSession.sparkContext.broadcast(model)
    whole = fresh(columns, "__text")[0]
    kept = docs.select(*columns, F.col("text").alias(whole))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.drop(whole).schema.fields) + ", lang_pred string, score double, narrow boolean"

    def run(batches):
        model = bc.value
        letter = regex.compile(r"\p{L}")
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            usable = [i for i, t in enumerate(texts) if t is not None and names and letter.search(t)]
            pred = [UNKNOWN] * len(texts)
            score, narrow = np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
            if usable:
                s = sizes([texts[i].lower().encode() for i in usable], model).astype(float)
                best = s.argmin(axis=1)
                low = s.min(axis=1, keepdims=True)
                gap = s / low - 1
                score[usable] = 1 / np.exp(-50 * gap).sum(axis=1)
                rest = gap.copy()
                rest[np.arange(len(best)), best] = np.inf
                narrow[usable] = rest.min(axis=1) < model.narrow
                for i, j in zip(usable, best):
                    pred[i] = names[j]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred), pa.array(score), pa.array(narrow)], names=[*batch.schema.names[:-1], "lang_pred", "score", "narrow"])

    return kept.mapInArrow(run, schema)


def reject(identified: DataFrame) -> DataFrame:
    """Rows whose margin is wide enough to trust."""
    return identified.filter(~F.col("narrow"))
