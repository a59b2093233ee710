"""Quality rules from a tokeniser's fertility.

A public vocabulary (BPE with byte fallback) splits every word; per text this
gives characters per token, the share of byte-fallback tokens and the entropy
of the tokens. Entropy grows with a text's length, so it is taken relative to
the median of its language and length class (half octaves of tokens). A text is
rejected where a measure leaves the band of its language: quartiles over all
different documents of the language, widened by a multiple of their distance.
Quantiles come from counts in steps of 1 / STEPS, so they are the same in every
run, and rows whose figures are all equal (copies) count once. Besides, plain counts (symbols, repeated lines, repeated
three-word windows) give a base verdict.

Texts are tokenised whole. Each distinct word is tokenised once for each worker
(a cache, bounded in entries); the rest is array arithmetic on the batch.

Nulls: a null text has no words; a null language is a language of its own. A
text without words has fertility null and fails the base rule. A very long text
is counted whole, in one task. Rows of one doc_id are documents of their own. An
empty table gives an empty result. Other columns are ignored. The counts are
made, and stored in the shared folder, by a job that runs while judged() is
called.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common as C
from tessera.llm.cluster import bounded_batches, stored

VOCABULARY = "piece_bpe_32k.model"
CACHE_WORDS = 1_000_000
#: Band: quartiles widened by so many times their distance, and by a least distance; more for texts under STEADY_WORDS, by the root of the ratio.
WIDEN, STEADY_WORDS = 2.0, 200
STEPS = 1000
LEAST = {"chars_per_token": 0.05, "byte_share": 0.02, "entropy_excess": 0.3}
MIN_WORDS, MAX_REPEATED = 50, 0.5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    """Kept by a worker for all its tasks."""
    return WordTokens(path)


class WordTokens:
    """Token ids of words; each distinct word is tokenised once."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.is_byte = np.fromiter((self.model.is_byte(i) for i in range(n)), bool, n)
        self.clear()

    def clear(self) -> None:
        self.slot: dict[bytes, int] = {}
        self.starts, self.lengths, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """The slots of distinct words."""
        new = [k for k in keys if k not in self.slot]
        if new:
            if len(self.slot) + len(new) > CACHE_WORDS and self.slot:
                self.clear()
                new = keys
            made = self.model.encode([k.decode("utf-8", "replace") for k in new], num_threads=1)
            lengths = np.fromiter(map(len, made), np.int64, len(made))
            base, slot = len(self.ids), len(self.lengths)
            self.starts = np.concatenate((self.starts, base + np.concatenate(([0], np.cumsum(lengths)[:-1]))))
            self.lengths = np.concatenate((self.lengths, lengths))
            self.ids = np.concatenate((self.ids, np.fromiter((t for x in made for t in x), np.int32, int(lengths.sum()))))
            self.slot.update((k, slot + j) for j, k in enumerate(new))
        return np.fromiter((self.slot[k] for k in keys), np.int64, len(keys))


def counts(data: np.ndarray, off: np.ndarray, tokens: WordTokens) -> dict[str, np.ndarray]:
    """All figures of the texts data[off[i]:off[i+1]]."""
    n = len(off) - 1
    starts, ends, woff = C.words(data, off)
    n_words = np.diff(woff)
    doc = C.owners(woff)
    letters = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    number, first = C.numbered(data, starts, ends)
    out = {"n_words": n_words, "word_chars": np.bincount(doc, letters[ends] - letters[starts], n).astype(np.int64) if len(doc) else np.zeros(n, np.int64), "n_symbols": C.sums(SYMBOLS[data], off)}
    out["n_dup_lines"] = duplicate_lines(data, off, starts)
    out["n_repeat_words"] = repeated_words(number, woff)
    if len(starts):
        raw = data.tobytes()
        slot = tokens.slots([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])[number]
        lengths = tokens.lengths[slot]
        ids = tokens.ids[C.ragged(tokens.starts[slot], lengths)]
        owner = np.repeat(doc, lengths)
        total = np.bincount(owner, minlength=n)
        out["n_tokens"] = total
        out["n_byte_tokens"] = np.bincount(owner, tokens.is_byte[ids], n).astype(np.int64)
        key, many = np.unique(owner << 32 | ids, return_counts=True)
        of = key >> 32
        share = many / total[of]
        out["token_entropy"] = np.bincount(of, -share * np.log2(share), n) + 0.0
    else:
        out |= {"n_tokens": np.zeros(n, np.int64), "n_byte_tokens": np.zeros(n, np.int64), "token_entropy": np.zeros(n)}
    return out


def duplicate_lines(data: np.ndarray, off: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    """By text: lines with a word that equal an earlier line of the text."""
    n = len(off) - 1
    if not len(data):
        return np.zeros(n, np.int64)
    feeds = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate((off[:-1][np.diff(off) > 0], feeds[feeds + 1 < len(data)] + 1)))
    ends = np.append(starts[1:], len(data))
    ends = ends - (data[ends - 1] == 10)
    at = np.searchsorted(word_starts, starts)
    full = (at < len(word_starts)) & (np.append(word_starts, len(data))[at] < ends)
    starts, ends = starts[full], ends[full]
    if not len(starts):
        return np.zeros(n, np.int64)
    doc = np.searchsorted(off, starts, "right") - 1
    h, _ = C.numbered(data, starts, ends)
    order = np.lexsort((h, doc))
    same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.bincount(doc[order][1:][same], minlength=n)


def repeated_words(number: np.ndarray, woff: np.ndarray, k: int = 3) -> np.ndarray:
    """By text: words in windows of k words that the text holds twice or more; equal words have equal numbers."""
    n, m = len(woff) - 1, len(number)
    if m < k:
        return np.zeros(n, np.int64)
    doc = C.owners(woff)
    at = np.flatnonzero(doc[: m - k + 1] == doc[k - 1 :])
    h = C.mix(doc[at].astype(np.uint64) ^ C.SEED)
    for j in range(k):
        h = C.mix(h ^ number[at + j].astype(np.uint64))
    order = np.argsort(h)
    one, other = at[order][1:], at[order][:-1]
    same, met = (doc[one] == doc[other]), h[order][1:] == h[order][:-1]
    for j in range(k):
        same &= number[one + j] == number[other + j]
    if (met & ~same).any():  # a collision: by the numbers themselves
        order = np.lexsort((*(number[at + j] for j in range(k)), doc[at]))
        one, other = at[order][1:], at[order][:-1]
        same = (doc[one] == doc[other]) & np.all([number[one + j] == number[other + j] for j in range(k)], 0)
    again = np.zeros(len(at), bool)
    again[order] = np.append(same, False) | np.insert(same, 0, False)
    return C.sums(C.cover(at[again], k, m), woff)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_byte_tokens")


def features(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, lang) with COUNTS (long) and token_entropy (double)."""
    bounded_batches(docs.sparkSession)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang string, {', '.join(f'{c} long' for c in COUNTS)}, token_entropy double"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(path or vocabulary_path())
        for batch in batches:
            data, off = C.strings(batch.column(2))
            parts = [counts(data[off[i] : off[j]], off[i : j + 1] - off[i], tokens) for i, j in C.blocks(off)]
            if parts:
                columns = [pa.array(np.concatenate([p[c] for p in parts])) for c in (*COUNTS, "token_entropy")]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["doc_id", "lang", *COUNTS, "token_entropy"])

    return docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").mapInArrow(each, schema)


def quantiles(rows: DataFrame, by: list[str], measures: list[str], shares: list[float]) -> DataFrame:
    """(by..., _measure...): an array of each measure's quantiles within each group, from counts in steps of 1 / STEPS."""
    steps = F.explode(F.array(*(F.struct(F.lit(m).alias("of"), F.round(F.col(m) * STEPS).cast("long").alias("step")) for m in measures)))
    bars = rows.select(*by, steps.alias("x")).where("x.step is not null").groupBy(*by, "x.of", "x.step").agg(F.count("*").alias("n"))
    group = Window.partitionBy(*by, "of")
    bars = bars.withColumns({"upto": F.sum("n").over(group.orderBy("step")), "total": F.sum("n").over(group)})
    found = [F.array(*(F.min(F.when((F.col("of") == m) & (F.col("upto") >= q * F.col("total")), F.col("step") / STEPS)) for q in shares)).alias(f"_{m}") for m in measures]
    return bars.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(*found)


def judged(docs: DataFrame, path: str | None = None) -> DataFrame:
    """features with chars_per_token, byte_share, entropy_excess, base_failed, the bands' verdict `in_bands` and kept."""
    some = F.col("n_tokens") > 0
    ratio = lambda a: F.when(some, F.col(a) / F.col("n_tokens"))
    f = stored(features(docs, path)).withColumns({"chars_per_token": ratio("word_chars"), "byte_share": ratio("n_byte_tokens"), "token_entropy": F.when(some, F.col("token_entropy"))})
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    sized = f.withColumns({"base_failed": failed, "size_class": F.when(some, F.floor(2 * F.log2("n_tokens")))})
    different = lambda rows: rows.where(~F.col("base_failed")).dropDuplicates(["lang", *COUNTS, "token_entropy"])
    usual = quantiles(different(sized), ["lang", "size_class"], ["token_entropy"], [0.5])
    f = sized.join(usual, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("size_class") == F.col("_size_class")), "left").withColumn("entropy_excess", F.col("token_entropy") - F.col("_token_entropy")[0]).drop("_lang", "_size_class", "_token_entropy", "size_class")
    measures = list(LEAST)
    f = f.join(quantiles(different(f), ["lang"], measures, [0.25, 0.75]), F.col("lang").eqNullSafe(F.col("_lang")), "left")
    short = F.greatest(F.lit(1.0), F.sqrt(F.lit(STEADY_WORDS) / F.greatest("n_words", F.lit(1))))

    def inside(m: str):
        low, high = F.col(f"_{m}")[0], F.col(f"_{m}")[1]
        spread = F.greatest((high - low) * WIDEN, F.lit(LEAST[m])) * short
        return F.col(m).between(low - spread, high + spread)

    verdict = F.coalesce(inside("chars_per_token") & inside("entropy_excess") & inside("byte_share"), F.lit(False))
    return f.withColumn("in_bands", verdict).withColumn("kept", ~F.col("base_failed") & verdict).drop("_lang", *(f"_{m}" for m in measures))
