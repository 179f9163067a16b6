"""Language identification by multilingual mixture inference.

A document's words are taken as drawn from a mixture of languages.  Each language
gives a word a likelihood through its character n-grams; expectation-maximisation
estimates the document's language proportions, and the set of languages is chosen
by penalised likelihood (BIC): starting from all languages, the least present one
is dropped for as long as that does not cost more than its penalty.

Models are hashed n-gram counts of a bounded sample of labelled rows
(``SAMPLE_PER_LANGUAGE``); every other step covers every row and whole text.  Only
the text is an input of a prediction.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fold, table

#: Labelled documents used per language; the bound of the training sample.
SAMPLE_PER_LANGUAGE = 1500
#: More different labels than this are refused: the model of a language takes half a megabyte.
MOST_LANGUAGES = 500
BUCKETS = 1 << 16
#: Words a worker remembers the likelihoods of, over all its tasks.
CACHE_WORDS = 400_000
ROUNDS = 12
#: A word that no language explains is drawn from this even background instead,
#: which keeps one strange word from deciding a document.
FLOOR = 1e-4
WORDS = re.compile(r"[^\W\d_]+")


def ngrams(word: str) -> list[int]:
    """Buckets of the 1- to 4-letter pieces of a word with its ends marked."""
    marked = f"^{word}$"
    out = []
    for n in (1, 2, 3, 4):
        for k in range(len(marked) - n + 1):
            piece = marked[k : k + n]
            if piece not in ("^", "$"):
                out.append(zlib.crc32(piece.encode("utf-8", "surrogatepass"), n) % BUCKETS)
    return out


class Model:
    """Log-likelihoods of words per language, from hashed n-gram counts."""

    def __init__(self, languages: list[str], counts: np.ndarray, limit: int = CACHE_WORDS):
        self.languages = languages
        smooth = counts + 0.5
        self.logp = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T.astype(np.float32)  # bucket x language
        self.limit, self.places, self.rows = limit, {}, np.zeros((1024, len(languages)), np.float32)

    def likelihoods(self, words: list[str]) -> np.ndarray:
        """words x languages: likelihoods scaled so that each word's best is 1, plus the floor."""
        places = self.places
        new = [w for w in set(words) if w not in places]
        if new:
            if len(places) + len(new) > self.limit and places:
                places.clear()
                new = list(set(words))
            need = len(places) + len(new)
            if need > len(self.rows):
                grown = np.zeros((max(need, 2 * len(self.rows)), self.rows.shape[1]), np.float32)
                grown[: len(self.rows)] = self.rows
                self.rows = grown
            grams = [ngrams(w) for w in new]
            lengths = np.array([len(g) for g in grams])
            flat = np.fromiter((i for g in grams for i in g), np.int64, int(lengths.sum()))
            sums = np.add.reduceat(self.logp[flat], np.concatenate([[0], np.cumsum(lengths)[:-1]]), axis=0)
            # Overlapping pieces count each letter about four times; a quarter makes it one word's worth.
            sums *= 0.25
            rows = np.exp(sums - sums.max(axis=1, keepdims=True)) + FLOOR
            for k, w in enumerate(new):
                places[w] = len(places)
            self.rows[need - len(new) : need] = rows
        return self.rows[np.fromiter(map(places.__getitem__, words), np.int64, len(words))]

    def infer(self, text: str) -> tuple[str, float, np.ndarray]:
        """(language, its share, all shares) of one text; ('und', 0, zeros) without letters."""
        words = WORDS.findall(text.lower())
        k = len(self.languages)
        if not words:
            return "und", 0.0, np.zeros(k)
        p = self.likelihoods(words)
        shares = mixture(p)
        best = int(shares.argmax())
        return self.languages[best], float(min(1.0, shares[best])), shares


def em(p: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood of a mixture with component likelihoods ``p`` (items x components)."""
    shares = np.full(p.shape[1], 1.0 / p.shape[1], np.float64)
    for _ in range(rounds):
        joint = p * shares
        total = joint.sum(axis=1, keepdims=True)
        new = (joint / total).mean(axis=0)
        if np.abs(new - shares).max() < 1e-4:
            shares = new
            break
        shares = new
    return shares, float(np.log(p @ shares).sum())


def mixture(p: np.ndarray) -> np.ndarray:
    """Proportions over the set of components that penalised likelihood selects."""
    n, k = p.shape
    penalty = 0.5 * np.log(n + 1.0)
    chosen = np.arange(k)
    single = np.log(p).sum(axis=0)
    shares, fit = em(p)
    # The common case first: one language explains the text as well as all do.
    if single.max() >= fit - penalty * (k - 1):
        out = np.zeros(k)
        out[single.argmax()] = 1.0
        return out
    while len(chosen) > 1:
        less = np.delete(chosen, shares.argmin())
        less_shares, less_fit = em(p[:, less])
        if less_fit + penalty < fit:
            break
        chosen, shares, fit = less, less_shares, less_fit
    out = np.zeros(k)
    out[chosen] = shares
    return out


def train(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """A model of the languages in ``labelled`` from at most ``per_language`` rows of each.

    Rows are taken in the order of a hash of id and text, so the sample does not
    depend on partitions.  Rows without language or text teach nothing; without
    any labelled row every prediction is 'und'; more than ``MOST_LANGUAGES`` labels
    are an error.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("h"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MOST_LANGUAGES} values: no column of languages")
    if not sizes:
        return Model([], np.zeros((0, BUCKETS)))
    # Thin first by the known counts, so that what is then ranked is bounded too.
    keep = F.lit(False)
    for lang, n in sizes.items():
        keep = keep | ((F.col("lang") == lang) & (F.pmod("h", F.lit(1_000_003)) <= int(1_000_003 * min(1.0, 1.5 * per_language / n))))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h", "text"))
    sample = rows.filter(keep).withColumn("rank", rank).filter(F.col("rank") <= per_language)
    languages = sorted(sizes)
    place = {lang: k for k, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, known = np.zeros((len(languages), BUCKETS), np.float64), {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = WORDS.findall(text.as_py().lower())
                grams: list[int] = []
                for w in words:
                    if (g := known.get(w)) is None:
                        g = known[w] = ngrams(w)
                    grams += g
                if len(known) > CACHE_WORDS:
                    known.clear()
                total[place[lang]] += np.bincount(np.array(grams, np.int64), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    counted = sample.select("lang", "text").coalesce(8).mapInArrow(count, "counts binary").collect()
    counts = sum(np.frombuffer(r["counts"], np.float64).reshape(len(languages), BUCKETS) for r in counted)
    return Model(languages, np.asarray(counts))


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", prefix: str = "") -> DataFrame:
    """All rows and columns of ``docs`` plus lang_pred, score and shares.

    Columns of ``docs`` with these names are replaced (use ``prefix`` to keep
    them).  A null text, or one without letters, is 'und' with score 0 and shares
    of 0.  Repeated rows are judged alike.
    """
    new = {f"{prefix}lang_pred": pa.string(), f"{prefix}score": pa.float64(), f"{prefix}shares": pa.list_(pa.float64())}
    kept = [c for c in docs.columns if c not in new]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = rows.withColumns({c: F.lit(None).cast(t) for c, t in zip(new, ("string", "double", "array<double>"))}).schema
    at = kept.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value  # one object per worker, so what it learns about words stays
        languages = own.languages
        for batch in batches:
            for start in range(0, max(batch.num_rows, 1), 1000):
                part = batch.slice(start, 1000)
                got = [own.infer(t.as_py() or "") if languages else ("und", 0.0, np.zeros(0)) for t in part.column(at)]
                found = list(zip(*got)) or [(), (), ()]
                arrays = [pa.array(list(values), kind) for values, kind in zip(found, new.values())]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [*kept, *new])

    return rows.mapInArrow(run, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(fold("doc_id", 5) != 0)


def held_out() -> Column:
    return fold("doc_id", 5) == 0


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole document, learned from the rows not held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(training_rows(docs))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "shares")
