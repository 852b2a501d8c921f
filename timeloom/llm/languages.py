"""Language identification with a bit-sliced Bloom filter of n-grams.

Each slot of the filter is a bit mask with one bit for each language, so that one look-up of an n-gram, the AND of its slots,
gives all languages whose training texts hold it. A text's languages are weighed by how many of its n-grams they have,
less the number that the filter's false positives would give them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_slices
from .pretokens import LETTER, char_classes, code_points

UNKNOWN = "und"
#: Bytes of text whose n-grams are held at once.
SLICE = 1 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Filter:
    languages: list[str]
    slots: np.ndarray  # a power of two of masks, each of as many uint64 words as the languages need
    order: int
    hashes: int

    @property
    def false_rate(self) -> np.ndarray:
        """For each language the probability that the filter claims an n-gram that it doesn't have."""
        return np.array([(self.slots[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)).mean() ** self.hashes for i in range(len(self.languages))])


def _slot(grams: np.ndarray, i: int, size: int) -> np.ndarray:
    h = (grams ^ (grams >> np.uint64(29))) * (MULTIPLIER + np.uint64(2 * i))
    return (h ^ (h >> np.uint64(32))) & np.uint64(size - 1)


def grams_of(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the lower-cased words, a space around each word; each one's text; and which texts have letters.

    What isn't a letter counts as space, and spaces in a row as one.
    """
    lowered = [t.lower() for t in texts]
    size = np.fromiter((len(t) + 2 for t in lowered), np.int64, len(texts))
    chars = code_points("".join(f" {t} " for t in lowered))
    doc = np.repeat(np.arange(len(texts)), size)
    letter = char_classes()[chars] == LETTER
    has = np.zeros(len(texts), bool)
    has[doc[letter]] = True
    before = np.r_[False, letter[:-1]]
    keep = letter | before  # each word and the place after it
    first = letter & ~before
    # one space before a text's first word and after each word
    c = np.where(letter, chars, 0x20)[keep].astype(np.uint64)
    d, f = doc[keep], first[keep]
    lead = f & np.r_[True, d[1:] != d[:-1]]
    at = np.flatnonzero(lead)
    c, d = np.insert(c, at, 0x20), np.insert(d, at, d[at])
    n = len(c) - order + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), has
    h = np.zeros(n, np.uint64)
    for j in range(order):
        h = h * MULTIPLIER + c[j : j + n] + np.uint64(1)
    inside = d[:n] == d[order - 1 :]
    return h[inside], d[:n][inside], has


def predict(f: Filter, texts: list[str]) -> tuple[list[str], np.ndarray]:
    if not f.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    grams, doc, has = grams_of(texts, f.order)
    n = np.bincount(doc, minlength=len(texts))
    at = [_slot(grams, i, len(f.slots)) for i in range(f.hashes)]
    hits = []
    for i in range(len(f.languages)):
        if i % 64 == 0:  # the masks' next word
            mask = f.slots[at[0], i // 64]
            for x in at[1:]:
                mask &= f.slots[x, i // 64]
        hits.append(np.bincount(doc[(mask >> np.uint64(i % 64) & np.uint64(1)).astype(bool)], minlength=len(texts)))
    hits = np.stack(hits, 1)
    rate = f.false_rate
    true = np.clip((hits - n[:, None] * rate) / (1 - rate), 0, None)
    best = true.argmax(1)
    score = np.where(has, true[np.arange(len(texts)), best] / np.maximum(n, 1), 0.0)
    return [f.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], np.clip(score, 0, 1)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = 5_000, top: int = 6_000, order: int = 4, hashes: int = 2, id_col: str = "doc_id") -> Filter:
    """The filter of the `top` most frequent n-grams of each language, from at most about `per_language` of its rows.

    These rows are drawn evenly by a hash of the text and, where there is one, the id, so that copies are drawn one by one; the
    languages' numbers of rows are counted over all. There may be any number of languages: a mask has a bit for each, and the
    driver holds one number and `top` n-grams for each. Rows with a null text or language teach nothing. Without any row the
    filter knows no language and every text is `und`.
    """
    known = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    count = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    if not count:
        return Filter([], np.zeros((1, 1), np.uint64), order, hashes)
    most = known.groupBy(lang_col).agg(F.least(F.lit(1.0), F.lit(float(per_language)) / F.count("*")).alias("_share"))
    draw = F.pmod(F.xxhash64(text_col, *([id_col] if id_col in labelled.columns else [])), F.lit(1_000_000))
    drawn = known.select(text_col, lang_col, draw.alias("_draw")).join(F.broadcast(most), lang_col).where(F.col("_draw") < F.col("_share") * 1_000_000)

    def run(batches):
        for b in text_slices(batches, text_col, SLICE):
            langs = b.column(lang_col).dictionary_encode()
            grams, doc, _ = grams_of(b.column(text_col).to_pylist(), order)
            code = np.asarray(langs.indices)[doc]
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                g, n = np.unique(grams[code == i], return_counts=True)
                yield pa.record_batch([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counted = drawn.select(text_col, lang_col).mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the tops of 64 parts of each language, and of these the language's
    parts = counted.withColumn("part", F.pmod("gram", F.lit(64)))
    for keys in (("lang", "part"), ("lang",)):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "gram"))
        parts = parts.withColumn("r", rank).where(F.col("r") <= top).drop("r")
    chosen = parts.select("lang", "gram").toPandas()  # at most top rows for each language
    languages = sorted(count)
    size = 1 << int(np.ceil(np.log2(max(16, 8 * hashes * top))))
    slots = np.zeros((size, (len(languages) + 63) // 64), np.uint64)
    for i, lang in enumerate(languages):
        g = chosen.loc[chosen["lang"] == lang, "gram"].to_numpy(np.int64).view(np.uint64)
        for k in range(hashes):
            slots[_slot(g, k, size), i // 64] |= np.uint64(1 << (i % 64))
    return Filter(languages, slots, order, hashes)


def identify(docs: DataFrame, model: Filter, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns `keep` (by default the id), lang_pred and score for every row.

    lang_pred is `und` with score 0 if the text is null or has no letters. Else it is the language with most of the text's
    n-grams, the first in alphabetical order of equals, and score the share of n-grams that it has. Columns of docs named
    lang_pred or score give way. An empty table gives an empty result.
    """
    keep = tuple(c for c in keep or (id_col,) if c not in ("lang_pred", "score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    read = list(dict.fromkeys([*keep, text_col]))

    def run(batches):
        for b in text_slices(batches, text_col, SLICE):
            langs, score = predict(shared.value, pc.fill_null(b.column(text_col), "").to_pylist())
            yield pa.record_batch([*(b.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return docs.select(*read).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from learning: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
