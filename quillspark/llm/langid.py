"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Fitting: document frequencies of hashed character n-grams and the documents per language come from all
training rows. The weights are learned from a bounded sample (`sample_per_language` different texts of each language, those
of smallest keyed hash, so reruns agree and copies count once) by follow-the-regularised-leader, one update a document, with
an elastic-net penalty: L1 keeps the weights sparse, L2 small. A part of the sample that takes no update sets one
temperature, which calibrates the probabilities. All languages are learned; with very many of them the buckets
become fewer, so that the model stays below MODEL_CELLS weights and can be broadcast.

Prediction reads the whole text. Defined results: a null text or one without a letter gives `und` with score
0; so does every text if nothing was learned; repeated rows get equal results; ties go to the smaller language
code; a column named like a result is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, map_groups, mix, ship, tidy, written

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 15
    sample_per_language: int = 400  # documents that the weights are learned from
    calibration_every: int = 5  # each fifth sampled document sets the temperature instead
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.002


DEFAULT = Settings()
MODEL_CELLS, LEAST_BITS = 1 << 25, 8  # buckets times languages


def buckets(text: str, s: Settings) -> np.ndarray:
    """The hashed character n-grams of a whole text (lower case, a space at either end), one entry each."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = []
    gram = codes
    for n in range(1, max(s.orders) + 1):
        if n > 1:
            gram = gram[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        if n in s.orders and len(gram):
            out.append((mix(gram + np.uint64(n << 56)) >> np.uint64(64 - s.bits)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def tf_idf(counts_at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Sublinear term frequency times inverse document frequency, length one."""
    x = (1.0 + np.log(counts)) * idf[counts_at]
    return x / max(float(np.sqrt(x @ x)), 1e-12)


@dataclass
class Model:
    settings: Settings
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        counts = np.bincount(buckets(text, self.settings), minlength=1 << self.settings.bits)
        at = np.flatnonzero(counts)
        return at, tf_idf(at, counts[at], self.idf)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        at, x = self.vector(text)
        z = (x @ self.weights[at] + self.bias) / self.temperature
        p = np.exp(z - z.max())
        k = int(np.argmax(p))
        return self.languages[k], float(p[k] / p.sum())


# ----------------------------------------------------------------- fitting

def document_frequencies(texts: DataFrame, s: Settings, chunk: int = 1024) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and how many texts there are. Every task sends one row of sums a chunk of
    buckets, whatever the corpus; rows meet by chunk."""
    chunk = min(chunk, 1 << s.bits)
    size = 1 << s.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(size, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                n += 1
                df += np.bincount(buckets(t or "", s), minlength=size) > 0
        if n:
            k = size // chunk
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(k)], pa.int32()), pa.array([[n], *df.reshape(k, chunk)], pa.list_(pa.int64()))], names=["chunk", "sums"])

    def add(table: pa.Table, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i, j in zip(offsets[:-1], offsets[1:]):
            rows = table.column("sums").slice(i, j - i).combine_chunks()
            total = rows.flatten().to_numpy(zero_copy_only=False).reshape(j - i, -1).sum(axis=0)
            yield pa.RecordBatch.from_arrays([table.column("chunk").slice(i, 1).combine_chunks(), pa.array([total], pa.list_(pa.int64()))], names=["chunk", "sums"])

    schema = "chunk int, sums array<bigint>"
    df, n = np.zeros(size, np.int64), 0
    for r in map_groups(texts.mapInArrow(tidy(run), schema), ["chunk"], [], add, schema).collect():  # a row a chunk
        if r.chunk < 0:
            n = r.sums[0]
        else:
            df[r.chunk * chunk : (r.chunk + 1) * chunk] = r.sums
    return df, n


def learn(rows: list[tuple[int, np.ndarray, np.ndarray]], n_languages: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Follow-the-regularised-leader with per-coordinate rates. rows: (language, buckets, values)."""
    size = 1 << s.bits
    z, n = np.zeros((size + 1, n_languages)), np.zeros((size + 1, n_languages))

    def weights(at):
        za, na = z[at], n[at]
        w = -(za - np.sign(za) * s.l1) / ((s.beta + np.sqrt(na)) / s.alpha + s.l2)
        return np.where(np.abs(za) <= s.l1, 0.0, w)

    for epoch in range(s.epochs):
        for k in np.argsort(mix(np.arange(len(rows), dtype=np.uint64) + np.uint64(epoch << 32))):
            language, at, x = rows[k]
            at, x = np.append(at, size), np.append(x, 1.0)
            w = weights(at)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[language] -= 1.0
            g = np.outer(x, p)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    return w[:size].astype(np.float32), w[size]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t):
        z = logits / math.exp(log_t)
        z = z - z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(labels)), labels]))

    low, high, ratio = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    for _ in range(60):
        if loss(a) <= loss(b):
            high, b = b, a
            a = high - ratio * (high - low)
        else:
            low, a = a, b
            b = low + ratio * (high - low)
    return math.exp((low + high) / 2)


def drawn(rows: DataFrame, s: Settings) -> DataFrame:
    """(lang, key): for each language the `sample_per_language` smallest keyed hashes of its different texts. A task passes on
    as many at most, so neither copies nor large languages gather anywhere."""
    most = s.sample_per_language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            lang, key = b.column(0).dictionary_encode(), b.column(1).to_numpy(zero_copy_only=False)
            at = lang.indices.to_numpy(zero_copy_only=False)
            for i, name in enumerate(lang.dictionary.to_pylist()):
                both = np.concatenate((held.get(name, np.zeros(0, np.int64)), key[at == i]))
                held[name] = np.unique(both)[:most]
        for name, keys in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys, pa.int64())], names=["lang", "key"])

    least = rows.select("lang", "key").mapInArrow(tidy(run), "lang string, key long").distinct()
    # the smallest of each of 64 slots, then the smallest of a language: no task gets all tasks' rows of one
    for by in (["lang", F.pmod("key", F.lit(64))], ["lang"]):
        least = least.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("key"))).where(F.col("n") <= most).select("lang", "key")
    return least


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", s: Settings = DEFAULT) -> Model:
    """A model from the rows of `rows` whose text and language aren't null."""
    ship(rows.sparkSession)
    text = F.col(text_col).cast("string")
    rows = rows.select(text.alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(text, F.lit(17)).alias("key")).where("text IS NOT NULL AND lang IS NOT NULL")
    chosen = written(drawn(rows, s), "drawn")
    languages = sorted(r.lang for r in chosen.select("lang").distinct().collect())  # a row a language
    while s.bits > LEAST_BITS and len(languages) << s.bits > MODEL_CELLS:
        s = replace(s, bits=s.bits - 1)
    df, n = document_frequencies(rows.select("text"), s)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    model = Model(s, languages, idf, np.zeros((1 << s.bits, len(languages)), np.float32), np.zeros(len(languages)), 1.0)
    if not languages:
        return model

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            lang, key, text = (b.column(c).to_pylist() for c in ("lang", "key", "text"))
            new = [i for i, k in enumerate(zip(lang, key)) if k not in seen and not seen.add(k)]  # one of a text's copies
            found = [np.unique(buckets(text[i], s), return_counts=True) for i in new]
            yield pa.RecordBatch.from_arrays([pa.array([lang[i] for i in new], pa.string()), pa.array([key[i] for i in new], pa.int64()), pa.array([v[0] for v in found], pa.list_(pa.int32())), pa.array([v[1] for v in found], pa.list_(pa.int32()))], names=["lang", "key", "at", "n"])

    wanted = F.broadcast(chosen) if len(languages) * s.sample_per_language <= 1_000_000 else chosen
    sample = rows.join(wanted, ["lang", "key"]).select("lang", "key", "text").mapInArrow(tidy(vectors), "lang string, key long, at array<int>, n array<int>")
    # sample_per_language rows a language of at most 2**bits entries
    sample = sample.groupBy("lang", "key").agg(F.min(F.struct("at", "n")).alias("v")).select("lang", "key", "v.*")
    taken: dict[str, list] = {}
    for r in sample.toLocalIterator():
        taken.setdefault(r.lang, []).append((r.key, np.array(r.at, np.int64), np.array(r.n, np.int64)))
    train, held = [], []
    for k, lang in enumerate(languages):
        for i, (_, at, c) in enumerate(sorted(taken[lang], key=lambda x: x[0])):
            (held if i % s.calibration_every == s.calibration_every - 1 else train).append((k, at, tf_idf(at, c, idf)))
    model.weights, model.bias = learn(train, len(languages), s)
    logits = np.array([x @ model.weights[at] + model.bias for _, at, x in held]).reshape(len(held), len(languages))
    model.temperature = temperature(logits, np.array([k for k, _, _ in held], np.int64))
    return model


def predict(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`df` with lang_pred and score; reads no other column than the text."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    text = free_name(df.columns, "text")
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("lang_pred", "score")], F.col(f"`{text_col}`").alias(text))
    schema = kept.drop(text).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = [m.predict(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=schema.names)

    return kept.mapInArrow(tidy(run), schema)
