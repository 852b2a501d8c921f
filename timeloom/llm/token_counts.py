"""Token counts by a two-tier lookup on the map side.

The first tier is a compact table of frequent pre-tokens with their numbers of tokens, broadcast; its size is a parameter, whatever the corpus. It is
fitted to a sample of at most SAMPLE rows. The second tier is each worker's cache before the tokenizer. Pre-tokens are never shuffled: all texts are read once, and
the tiers change the speed only, not the counts.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, tokenizer_file
from .pretokens import WordCache, split_units

TOP = 16_384
#: Rows, and characters of each, that the first tier is fitted to.
SAMPLE, SAMPLE_CHARS = 2_000, 20_000


@lru_cache(2)
def counter(path: str) -> WordCache:
    """The number of tokens of each unit of split_units. A line feed before a unit keeps the model from adding a space: the
    space and the line feed make two tokens of their own, as no piece of the vocabulary holds a line feed."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if not model.is_control(i) and not model.is_unknown(i) and not model.is_byte(i) and ("\n" in piece or "▁" in piece.lstrip("▁")):
            raise ValueError(f"units can't be counted apart with a vocabulary that has {piece!r}")
    return WordCache(lambda units: [len(x) - 2 for x in model.encode(["\n" + u for u in units], num_threads=1)])


def frequent_units(docs: DataFrame, text_col: str = "text", top: int = TOP, sample: int = SAMPLE) -> list[str]:
    """The `top` most frequent pre-tokens of a sample of at most `sample` rows, of each of which the first SAMPLE_CHARS characters are looked at. One task counts them and
    sends no more than this list."""

    def run(batches):
        held: dict[str, int] = {}
        for b in text_slices(batches, text_col):
            units, _ = split_units(pc.fill_null(b.column(text_col), "").to_pylist())
            for x in units.value_counts().to_pylist():
                held[x["values"]] = held.get(x["values"], 0) + x["counts"]
        best = sorted(held.items(), key=lambda x: (-x[1], x[0]))[:top]
        yield pa.record_batch([pa.array([u for u, _ in best], pa.string())], ["unit"])

    total, some = docs.count(), docs.select(F.substring(text_col, 1, SAMPLE_CHARS).alias(text_col))
    if total > sample:
        some = some.where(F.rand(1) < 2 * sample / total)
    return [r.unit for r in some.limit(sample).coalesce(1).mapInArrow(run, "unit string").collect()]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model", folder: str | None = None, limit: int = 4096, top: int = TOP) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) for every row: UTF-8 bytes, tokens, and whether these are over the limit.

    A null text counts as empty: no bytes and no tokens. Rows and ids may repeat; an empty table gives an empty result; other
    columns are not read.
    """
    path = tokenizer_file(model, folder)
    known = docs.sparkSession.sparkContext
    units = frequent_units(docs, text_col, top)
    table = known.broadcast((units, np.asarray(counter(path)(units), np.int32)))

    def run(batches):
        units, lengths = table.value
        frequent, cache = pa.array(units, pa.string()), counter(path)
        for b in text_slices(batches, text_col):
            texts = pc.fill_null(b.column(text_col), "")
            pieces, first = split_units(texts.to_pylist())
            coded = pieces.dictionary_encode()
            at = pc.fill_null(pc.index_in(coded.dictionary, frequent), -1).to_numpy()
            each = np.where(at >= 0, lengths[at] if len(lengths) else 0, 0).astype(np.int64)
            rare = np.flatnonzero(at < 0)
            each[rare] = cache(coded.dictionary.take(pa.array(rare)).to_pylist())
            total = np.r_[0, np.cumsum(each[np.asarray(coded.indices)])][first]
            n = np.diff(total)
            yield pa.record_batch([b.column(id_col), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
