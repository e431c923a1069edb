"""Language identification by a string kernel: n-gram presence, Nystroem landmarks, one-versus-rest ridge regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticelake.llm.common import LOWER, cut, give_back, small_side, utf8
from noticelake.session import ship_package

GRAMS = 3  # spectra of 1 to 3 bytes are blended
BUCKETS = 1 << 15  # hashed n-grams
SAMPLE = 300  # different labelled texts of each language that the model is fitted on
MOST = 12_000  # such texts of all languages together; with more than MOST / SAMPLE languages each gives fewer, one at least
LANDMARKS = 160
RIDGE = 0.1
UNKNOWN = "und"
KNOWN_SHARE = 0.02  # an n-gram is known to a language if this share of its sample has it, two texts at least
LOW_TEXTS = 0.01  # quantile of the labelled texts' familiarity, and the share of it below which a text is rejected:
SLACK = 0.8  # labelled texts hold junk too, and clean ones that were not learnt from are somewhat less familiar

_MUL = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


_PLAIN = np.zeros(256, dtype=bool)  # letters, bytes of letters beyond ASCII, and white space
_PLAIN[[9, 10, 11, 12, 13, 32, *range(97, 123), *range(128, 256)]] = True


def presence(data: np.ndarray, offsets: np.ndarray, plain: bool = False) -> np.ndarray:
    """0/1 matrix, rows x BUCKETS: which n-grams of bytes (A-Z lower-cased) each text has. No gram spans two texts.
    ``plain`` leaves out those with a digit or a sign, which numbers, addresses and keys consist of in any language."""
    data = LOWER[data].astype(np.uint32)
    n = len(offsets) - 1
    out = np.zeros((n, BUCKETS), dtype=np.float32)
    for i in range(n):
        text = data[offsets[i] : offsets[i + 1]]
        for lo in range(0, max(len(text), 1), 1 << 20):
            part = text[lo : lo + (1 << 20) + GRAMS - 1]
            value, fits = np.zeros(len(part), np.uint32), np.ones(len(part), bool)
            for g in range(min(GRAMS, len(part))):
                value = (value[: len(part) - g] << np.uint32(8)) | part[g:]
                place = (value * _MUL[g] + _MUL[(g + 1) % 3]) >> np.uint32(32 - 15)
                if plain:
                    fits = fits[: len(part) - g] & _PLAIN[part[g:]]
                    place = place[fits]
                out[i, place] = 1.0
    return out


def normalised(found: np.ndarray) -> np.ndarray:
    """Rows of unit length, so that products are kernel values from 0 to 1."""
    size = np.sqrt(found.sum(axis=1, keepdims=True))
    return found / np.maximum(size, 1.0)


@dataclass
class Model:
    langs: list[str]
    marks: np.ndarray  # m x BUCKETS / 8, the landmarks' n-grams, one bit each
    weights: np.ndarray  # (m + 1) x languages: Nystroem map and ridge weights in one, then the intercept
    known: np.ndarray  # BUCKETS x languages, 0/1: n-grams that are usual in a language
    least: float = 0.0  # familiarity that a text of one of the languages has

    def landmarks(self) -> np.ndarray:
        """BUCKETS x m, unit columns; unpacked once where texts are scored."""
        if not hasattr(self, "_dense"):
            self._dense = np.ascontiguousarray(normalised(_unpacked(self.marks)).T)
        return self._dense


def _unpacked(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(bits, axis=1).astype(np.float32)


def _found(column: pa.Array, step: int, plain: bool = False):
    """The presence matrices of ``step`` texts at a time."""
    data, offsets = utf8(column)
    for lo in range(0, len(column), step):
        hi = min(len(column), lo + step)
        yield presence(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], plain)


def scores(model: Model, column: pa.Array, step: int = 96) -> np.ndarray:
    """Ridge outputs, rows x languages, by matrix products over ``step`` texts at a time. They sum to 1 for every text, so
    they compare languages and do not tell whether a text is in any of them; ``familiarity`` does."""
    kernels = (normalised(found) @ model.landmarks() for found in _found(column, step))
    return np.concatenate([np.zeros((0, len(model.langs))), *(k @ model.weights[:-1] + model.weights[-1] for k in kernels)])


def familiarity(model: Model, column: pa.Array, step: int = 96) -> np.ndarray:
    """The share of each text's different plain n-grams that the language which knows most of them knows; 0 without any."""
    shares = ((found @ model.known).max(axis=1) / np.maximum(found.sum(axis=1), 1.0) for found in _found(column, step, True))
    return np.concatenate([np.zeros(0), *shares])


def _features(batches):
    """Rows (lang, text): the language, and the text's n-grams and plain n-grams, one bit each."""
    packed = lambda found: pa.array([b.tobytes() for b in np.packbits(found.astype(bool), axis=1)], pa.binary())
    for batch in batches:
        at = 0
        for found, plain in zip(_found(batch.column(1), 96), _found(batch.column(1), 96, True), strict=True):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(found)), packed(found), packed(plain)], names=["lang", "bits", "plain"])
            at += len(found)


def _sample(labelled: DataFrame, sample: int) -> list:
    """Rows (lang, bits, plain) of the different texts with the smallest hashes of each language, by one bounded ranking.

    Texts are first thinned by their hash to about three times as many as wanted, judged by the language's number of
    different texts, so that neither copies of a text nor the size of a language matter."""
    text = F.col("text").cast("string")
    rows = labelled.filter(text.rlike(r"\p{L}") & F.col("lang").isNotNull()).select("lang", text.alias("text"), F.xxhash64(text).alias("h"))
    sizes = cut(rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")))
    each = max(1, min(sample, MOST // max(1, sizes.count())))
    place = F.col("h") / F.lit(2.0**64) + 0.5
    near = rows.join(small_side(sizes), "lang").filter((F.col("n") <= each) | (place < 3.0 * each / F.col("n") + 0.001))
    near = near.groupBy("lang", "h").agg(F.min("text").alias("text"))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("rank") <= each)
    bits = near.select("lang", "text").mapInArrow(_features, "lang string, bits binary, plain binary").collect()
    return sorted(bits, key=lambda b: (b["lang"], b["bits"]))


def fit(labelled: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Model:
    """A model from rows (doc_id, text, lang). ``sample`` bounds the different texts a language gives, those with the
    smallest hashes; copies of a text count once, a null language and texts without a letter not at all.

    The sample's n-grams, 8 KB a text, come to the driver: ``MOST`` texts at most, or one of each language. They stay
    packed, blocks of texts are unpacked in turn.
    """
    ship_package(labelled.sparkSession)
    bits = _sample(labelled, sample)
    langs = sorted({b["lang"] for b in bits})
    if not bits:
        return Model([], np.zeros((0, BUCKETS // 8), np.uint8), np.zeros((0, 0), np.float32), np.zeros((BUCKETS, 0), np.float32))
    own = np.searchsorted(langs, [b["lang"] for b in bits])
    x, plain = (np.stack([np.frombuffer(b[c], np.uint8) for b in bits]) for c in ("bits", "plain"))
    blocks = [slice(lo, lo + 96) for lo in range(0, len(x), 96)]
    y = (own[:, None] == np.arange(len(langs))).astype(np.float64)
    share = y.sum(axis=0)
    # landmarks: every language gives as many, spread over its sample
    order = np.argsort(np.concatenate([np.arange(c) for c in share.astype(int)]), kind="stable")
    marks = x[order[: min(landmarks, len(x))]]
    dense = normalised(_unpacked(marks))
    values, vectors = np.linalg.eigh((dense @ dense.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = np.concatenate([(normalised(_unpacked(x[b])) @ dense.T).astype(np.float64) @ root for b in blocks])
    z1 = np.hstack([z, np.ones((len(z), 1))])
    weight = (y / share).sum(axis=1) * len(y) / len(langs)  # languages weigh the same
    penalty = RIDGE * np.eye(z1.shape[1])
    penalty[-1, -1] = 1e-6
    beta = np.linalg.solve(z1.T @ (z1 * weight[:, None]) + penalty, z1.T @ (y * weight[:, None]))
    if not np.isfinite(beta).all():
        raise ValueError("the labelled texts give no finite weights")
    # familiarity is calibrated on the labelled texts, each against the others of its language
    texts = np.zeros((BUCKETS, len(langs)))
    for b in blocks:
        texts += _unpacked(plain[b]).T @ y[b].astype(np.float32)
    need = np.maximum(np.minimum(2, share), np.ceil(KNOWN_SHARE * share))
    usual = texts > need  # by one text more than itself
    familiar = []
    for b in blocks:
        found = _unpacked(plain[b])
        familiar.append((found * usual[:, own[b]].T).sum(axis=1) / np.maximum(found.sum(axis=1), 1))
    least = SLACK * float(np.quantile(np.concatenate(familiar), LOW_TEXTS))
    model = Model(langs, marks, np.vstack([root @ beta[:-1], beta[-1:]]).astype(np.float32), (texts >= need).astype(np.float32), least)
    del dense, x, plain, bits, z, z1, found
    give_back()
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, lang_pred, score.

    The whole text counts. Null texts and texts without a letter are ``und`` with score 0; so is everything if the
    model has no language. The score is the ridge output of the best language, cut to 0 to 1; ties go to the first
    language by name. Repeated rows get equal results, other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        langs = shared.value.langs
        for batch in batches:
            letters = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            names, best = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if langs and batch.num_rows:
                out = scores(shared.value, batch.column(1))
                names = [langs[k] if ok else UNKNOWN for k, ok in zip(out.argmax(axis=1), letters, strict=True)]
                best = np.where(letters, np.clip(out.max(axis=1), 0.0, 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(best, pa.float64())], names=["doc_id", "lang_pred", "score"])
        give_back()

    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return own.mapInArrow(run, "doc_id long, lang_pred string, score double")


def in_training(doc_id: Column) -> Column:
    """Whether a document may be learnt from: three of four, by a checksum of its number."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) != 2, F.lit(True))


def keep_known(docs: DataFrame, model: Model, lang: str | None = None) -> DataFrame:
    """``docs`` whose text the model takes for one of its languages; columns stay as they are, but for ``lang``, which
    names the column that gets the predicted language.

    Rejected are null texts, texts without a letter, and texts less familiar than labelled ones are: junk with letters,
    and texts in a language that was not learnt.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    own = docs.columns.index(lang) if lang else None

    def run(batches):
        langs = shared.value.langs
        for batch in batches:
            if langs and batch.num_rows:
                batch = batch.filter(pa.array(familiarity(shared.value, batch.column(at)) >= shared.value.least))
                if lang:
                    found = [langs[k] for k in scores(shared.value, batch.column(at)).argmax(axis=1)]
                    batch = batch.set_column(own, lang, pa.array(found, batch.column(own).type))
                yield batch
        give_back()

    return docs.filter(F.col("text").cast("string").rlike(r"\p{L}")).mapInArrow(run, docs.schema)
