"""Language identification by multilingual mixtures.

Each language has a distribution over byte trigrams inside words (hashed to BUCKETS). A document is taken as a mixture:
every word comes from one language. Expectation-maximisation estimates the proportions from the words' likelihoods,
first over all languages, then over the best one, two, ... of them, as long as a larger set can still win; the set with the highest
likelihood less ``penalty * ln(words)`` for each language is selected, and its largest language is the prediction.

Training rows are those with a language whose crc32(id) % 4 is not 2, of each language about ``rows_per_language``, by a
hash of id and text (the bound of the model's sample; everything that is predicted is predicted from its whole text). All
languages are learned; the model has 65,536 weights for each and is shipped with the tasks, so more than
``most_languages`` are an error, not cut off. Prediction is one pass without a shuffle; the language, source and id of a document are not inputs to it.

Shares are relative: they say nothing about whether any learned language fits. The gain does, the mean log-likelihood of a
text's trigrams under its mixture less that under a flat background. Gibberish and languages that were not learned gain
little or nothing against what labelled rows gain (``typical_gain``), and a filter can reject them by it (``explained``).

Defined results: a null text or one without a letter is ``und`` with score 0, and so is every text if there was nothing
to learn from; equal texts get equal predictions; a tie goes to the first language by name; repeated rows give
repeated results; an empty table gives an empty table; an input column with the name of a new one is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import pretoken
from tessera.runtime import small_batches

BUCKETS = 1 << 16
#: More languages than this are an error unless ``most_languages`` allows them: the model is shipped with every task.
MOST_LANGUAGES = 256
ROWS_PER_LANGUAGE = 4000
PENALTY = 1.5
STEPS = 10
SMOOTHING = 0.2
HELD_OUT = 2
#: Weights gathered at once, over all languages.
BLOCK_WEIGHTS = 2 << 20
#: Bytes of text that are counted at once; working arrays take some 70 times as much.
TRAIN_BYTES = 1 << 19
UNKNOWN = "und"
#: Share of the typical gain that a text must have, and typical trigrams that are added to those of a text, so that a few
#: odd ones in a short text don't decide.
LEAST_GAIN = 0.5
PRIOR_TRIGRAMS = 8
BINS_PER_NAT = 100


def _letters_only() -> np.ndarray:
    """Bytes as they enter trigrams: ASCII that is not a letter becomes a space."""
    table = np.arange(256, dtype=np.uint8)
    table[:128] = [b if chr(b).isalpha() else 0x20 for b in range(128)]
    return table


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each trigram, first trigram of each word, and number of words of each text."""
    raw, offsets = pretoken.utf8_of(pc.utf8_lower(texts.cast(pa.large_string())))
    # one space before each text and one at the end, so that no trigram crosses texts
    data = np.full(len(raw) + len(offsets), 0x20, np.uint8)
    data[np.arange(len(raw)) + np.repeat(np.arange(1, len(offsets)), np.diff(offsets))] = _letters_only()[raw]
    inside = data != 0x20
    middle = np.flatnonzero(inside)
    if not len(middle):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    left, mid, right = (data[middle + k].astype(np.uint32) for k in (-1, 0, 1))
    with np.errstate(over="ignore"):
        h = (left << np.uint32(16) | mid << np.uint32(8) | right) * np.uint32(0x9E3779B1)
    bucket = (h >> np.uint32(16)).astype(np.int64) % BUCKETS
    first = np.flatnonzero(~inside[middle - 1])
    text_of_word = np.searchsorted(offsets[1:] + np.arange(1, len(offsets)), middle[first], side="left")
    return bucket, first, np.bincount(text_of_word, minlength=len(offsets) - 1)


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # BUCKETS x languages

    def block_bytes(self) -> int:
        return max(1 << 16, BLOCK_WEIGHTS // max(1, len(self.languages)))


def em(e: np.ndarray, doc: np.ndarray, starts: np.ndarray, words: np.ndarray, allowed: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document, over the languages it is allowed.

    e: likelihoods of words x languages; doc: document of each word; starts, words: of each document.
    """
    p = allowed / allowed.sum(1, keepdims=True)
    for _ in range(steps):
        r = e * p[doc]
        r /= r.sum(1, keepdims=True)
        p = np.add.reduceat(r, starts, axis=0) / words[:, None].astype(np.float32)
    return p, np.add.reduceat(np.log((e * p[doc]).sum(1)), starts, dtype=np.float64)


def mixtures(texts: pa.Array, model: Model, penalty: float = PENALTY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Selected proportions, texts x languages, and each text's gain and trigrams; zeros for a text without words.

    The gain is the mean over trigrams of ln p(selected mixture) - ln p(background), which gives all buckets the same.
    """
    bucket, first, words = trigrams(texts)
    out, gain, grams = np.zeros((len(words), len(model.languages))), np.zeros(len(words)), np.zeros(len(words), np.int64)
    full = np.flatnonzero(words)
    if not len(full) or not model.languages:
        return out, gain, grams
    likely = np.add.reduceat(model.log_p[bucket], first, axis=0)
    top = likely.max(1, keepdims=True)
    # a floor keeps a word that only one language explains from ruling out the others altogether
    e = np.exp(np.maximum(likely - top, -30.0))
    words = words[full]
    starts = np.cumsum(words) - words
    doc = np.repeat(np.arange(len(full)), words)
    n = len(model.languages)
    p, limit = em(e, doc, starts, words, np.ones((len(full), n), np.float32))
    order = np.argsort(-p, axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(n)[None, :].repeat(len(full), 0), axis=1)
    best, best_fit, chosen = np.full(len(full), -np.inf), np.zeros(len(full)), np.zeros((len(full), n))
    for k in range(1, n + 1):
        cost = penalty * k * np.log(words + 1.0)
        # no set fits better than all languages together, so most documents need no larger set
        open_ = np.flatnonzero(limit - cost > best)
        if not len(open_):
            break
        some = np.isin(doc, open_) if len(open_) < len(full) else slice(None)
        size = words[open_]
        q, fit = em(e[some], np.repeat(np.arange(len(open_)), size), np.cumsum(size) - size, size, (place[open_] < k).astype(np.float32), 1 if k == 1 else STEPS)
        better = fit - cost[open_] > best[open_]
        best[open_[better]], best_fit[open_[better]], chosen[open_[better]] = (fit - cost[open_])[better], fit[better], q[better]
    out[full] = chosen / np.maximum(chosen.sum(1, keepdims=True), 1e-9)
    grams[full] = np.add.reduceat(np.diff(np.append(first, len(bucket))), starts)
    gain[full] = (best_fit + np.add.reduceat(top[:, 0], starts, dtype=np.float64)) / grams[full] + np.log(BUCKETS)
    return out, gain, grams


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (lang, text) to rows of lang, bucket, n."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for s in pretoken.slices(batch, 1, TRAIN_BYTES):
            langs = s.column(0)
            for lang in pc.unique(langs).to_pylist():
                bucket, _, _ = trigrams(s.column(1).filter(pc.equal(langs, lang)))
                sums[lang] = sums.get(lang, 0) + np.bincount(bucket, minlength=BUCKETS)
    for lang, n in sums.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])
    pretoken.give_back()


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE, most_languages: int = MOST_LANGUAGES) -> Model:
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    sizes = rows.groupBy("lang").count().limit(most_languages + 1).collect()
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages; raise most_languages and the memory of driver and workers with it")
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    # a row is in the sample if the hash of its id falls under its language's share
    share = rows.sparkSession.createDataFrame([(r["lang"], min(1.0, rows_per_language / r["count"])) for r in sizes], "lang string, share double")
    u = F.pmod(F.xxhash64("id", "text", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.join(F.broadcast(share), "lang").where(u < F.col("share")).select("lang", "text")

    counted = sample.mapInArrow(count_trigrams, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # at most most_languages * BUCKETS numbers
    found = counted.toPandas()
    languages = sorted(found["lang"].unique())
    n = np.zeros((BUCKETS, len(languages)))
    n[found["bucket"].to_numpy(), [languages.index(x) for x in found["lang"]]] = found["n"].to_numpy()
    p = (n + SMOOTHING) / (n.sum(0) + SMOOTHING * BUCKETS)
    return Model(languages, np.log(p).astype(np.float32))


def typical_gain(df: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> float | None:
    """Median gain of all rows that have a learned language as label, held-out ones too; None without such rows."""
    small_batches(df.sparkSession)
    rows = df.where(F.col(lang_col).cast("string").isin(model.languages)).select(F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            for s in pretoken.slices(batch, 0, model.block_bytes()):
                _, gain, grams = mixtures(s.column(0), model)
                bins, n = np.unique(np.floor(gain[grams > 0] * BINS_PER_NAT).astype(np.int32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int32()), pa.array(n, pa.int64())], names=["bin", "n"])
        pretoken.give_back()

    # a gain lies within some 50 nats, so a few thousand rows come to the driver
    found = rows.mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").toPandas()
    if not len(found):
        return None
    upto = found["n"].cumsum().to_numpy()
    return float(found["bin"].iloc[int(np.searchsorted(upto, upto[-1] / 2))] + 0.5) / BINS_PER_NAT


def explained(gain: np.ndarray, grams: np.ndarray, typical: float) -> np.ndarray:
    """Whether each text gains at least LEAST_GAIN of ``typical``, with PRIOR_TRIGRAMS typical ones added to its own."""
    return (gain * grams + PRIOR_TRIGRAMS * typical) / (grams + PRIOR_TRIGRAMS) >= LEAST_GAIN * typical


def predict(text: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: the column of its language (-1: ``und``), its score, the proportions, its gain and its trigrams."""
    has_letter = np.array(pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_pylist(), bool)
    p, gain, grams = mixtures(text, model)
    known = has_letter & (p.sum(1) > 0) if p.shape[1] else np.zeros(len(text), bool)
    p[~known] = 0
    best = p.argmax(1) if p.shape[1] else np.zeros(len(text), int)
    score = np.minimum(1.0, p[np.arange(len(p)), best]) if p.shape[1] else np.zeros(len(text))
    return np.where(known, best, -1), score, p, gain, grams


def annotate(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with lang_pred, score and proportions (map of the selected set), which replace columns of these names."""
    small_batches(df.sparkSession)
    new = ["lang_pred", "score", "proportions"]
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in new])
    at = df.columns.index(text_col)
    schema = T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("proportions", T.MapType(T.StringType(), T.DoubleType()))])

    def run(batches):
        for batch in batches:
            for s in pretoken.slices(batch, at, model.block_bytes()):
                best, score, p, _, _ = predict(s.column(at), model)
                name = [model.languages[b] if b >= 0 else UNKNOWN for b in best.tolist()]
                row, col = np.nonzero(p > 0)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(best)))]).astype(np.int32)
                shares = pa.MapArray.from_arrays(pa.array(ends), pa.array([model.languages[c] for c in col], pa.string()), pa.array(p[row, col]))
                yield pa.RecordBatch.from_arrays([*s.columns, pa.array(name, pa.string()), pa.array(score), shares], names=[*s.schema.names, *new])
        pretoken.give_back()

    return df.mapInArrow(run, schema)


def keep(df: DataFrame, model: Model, text_col: str = "text", min_score: float = 0.0, typical: float | None = None) -> DataFrame:
    """The rows of ``df``, in its own columns whatever their names, that are in a learned language.

    Texts that are ``und`` go, those whose largest language has a smaller share than ``min_score`` and, given the gain
    that is ``typical``, those that the learned languages don't explain.
    """
    small_batches(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for s in pretoken.slices(batch, at, model.block_bytes()):
                best, score, _, gain, grams = predict(s.column(at), model)
                stays = (best >= 0) & (score >= min_score)
                if typical is not None:
                    stays &= explained(gain, grams, typical)
                yield s.filter(pa.array(stays))
        pretoken.give_back()

    return df.mapInArrow(run, df.schema)


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score, proportions."""
    model = train(df, id_col, text_col, lang_col)
    out = annotate(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), model)
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "lang_pred", "score", "proportions")
