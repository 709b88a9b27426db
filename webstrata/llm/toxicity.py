"""A convolutional text classifier in numpy.

A word's vector is the mean of hashed embeddings: one for the word and one for each of its beginnings of 4 to 7 letters
and endings of 3 and 4, so unseen forms of known stems have a meaning too. Filters of several widths slide over the words; the largest answer of
each filter in the whole text goes to a logistic unit. As every filter is linear, its answers are sums of per-word
products, which are computed once per distinct word; whole texts of any length are scored.

Embeddings start from the label odds of their bucket in one direction and from small noise in the others; then all
parts are trained together on a bounded sample. Labels teach the model only where their fold allows. All other allowed
rows turn margins into probabilities and set a threshold per language, from counts of their margins at the table's own
label shares; the language is no input of the score.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webstrata.llm.boosting import calibrate
from webstrata.llm.frames import name
from webstrata.llm.tokens import per_worker, release, slices
from webstrata.session import bound_batches

#: Labelled rows from which the model learns, at most, half of them of the rarer label if there are so many.
SAMPLE = 6_000
BUCKETS, WIDTH, WIDTHS, FILTERS = 1 << 17, 16, (1, 2, 3), 8
EPOCHS, BATCH, RATE, SEED = 4, 32, 0.005, 7
#: Of the allowed rows, one in this many is never taught, so that both labels are left to calibrate with.
HELD = 5
#: Margins are counted in steps of one in this many.
STEPS = 50
BEGINNINGS, ENDINGS = (4, 5, 6, 7), (3, 4)
#: Languages with fewer positives in the calibration rows take the common threshold.
LEAST_POSITIVES = 10
#: Bytes of text scored at a time, and words a worker remembers.
SLICE, REMEMBERED, REMEMBERED_CHARS = 1_000_000, 300_000, 8_000_000
_EDGES = ".,;:!?()[]{}\"'*#$%&+-_=/|<>~^`@0123456789\t\r"
_LEAD = max(WIDTHS) - 1


@dataclass
class Model:
    embeddings: np.ndarray                      # buckets x width
    filters: list[np.ndarray]                   # per width: width x dimension x filters
    bias: np.ndarray
    weights: np.ndarray
    offset: float
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5
    thresholds: dict[str, float] = field(default_factory=dict)
    key: str = ""                               # tells models apart in a worker's memory


def buckets(word: str) -> list[int]:
    """Buckets of a word, its beginnings and its endings."""
    keys = [word, *["^" + word[:n] for n in BEGINNINGS if n < len(word)], *[word[-n:] + "$" for n in ENDINGS if n < len(word)]]
    return [xxhash.xxh32_intdigest(k) % BUCKETS for k in keys]


def split(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, word of every place, where each text's places end): lower case, without marks at the edges."""
    plain = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " ")
    parts = pc.split_pattern(plain, " ")
    told = parts.flatten().dictionary_encode()
    place: dict[str, int] = {}
    spelled = [w.strip(_EDGES).lower() for w in told.dictionary.to_pylist()]
    same = np.array([place.setdefault(w, len(place)) for w in spelled], np.int64)
    codes = same[told.indices.to_numpy()]
    keep = codes != place.get("", -1)
    return list(place), codes[keep], np.concatenate([[0], np.cumsum(keep)])[parts.offsets.to_numpy()]


def _vectors(embeddings: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Means of the embeddings of consecutive groups of buckets."""
    if not len(sizes):
        return np.zeros((0, embeddings.shape[1]), np.float32)
    return np.add.reduceat(embeddings[flat], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None].astype(np.float32)


def _spell(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    flat, sizes = array("i"), array("i")
    for word in words:
        own = buckets(word)
        flat.extend(own)
        sizes.append(len(own))
    return np.array(flat, np.int32), np.array(sizes, np.int64)


class _Words:
    """The vectors of the words a worker has met."""

    def __init__(self) -> None:
        self.slot: dict[str, int] = {}
        self.vectors, self.held = np.zeros((1 << 12, WIDTH), np.float32), 0

    def of(self, model: Model, words: list[str]) -> np.ndarray:
        if len(self.slot) + len(words) > REMEMBERED or self.held > REMEMBERED_CHARS:
            self.slot.clear()
            self.held = 0
        new = [w for w in words if w not in self.slot]
        if new:
            self.held += sum(map(len, new))
            first = len(self.slot)
            self.slot.update((w, first + i) for i, w in enumerate(new))
            while len(self.slot) > len(self.vectors):
                grown = np.zeros((2 * len(self.vectors), WIDTH), np.float32)     # what is not used yet takes no memory
                grown[:first] = self.vectors[:first]
                self.vectors = grown
            self.vectors[first:first + len(new)] = _vectors(model.embeddings, *_spell(new))
        return self.vectors[np.fromiter((self.slot[w] for w in words), np.int64, len(words))]


def _answers(model: Model, vectors: np.ndarray, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The largest answer of every filter in every text; the places before and after a text are blank."""
    n, lengths = len(ends) - 1, np.diff(ends)
    starts = ends[:-1] + _LEAD * (np.arange(n) + 1)
    places = np.full(len(codes) + _LEAD * (n + 1) + 1, len(vectors), np.int64)
    places[np.repeat(starts - ends[:-1], lengths) + np.arange(len(codes))] = codes
    out = []
    for width, kernel in zip(WIDTHS, model.filters):
        total = None
        for k in range(width):
            product = np.concatenate([vectors @ kernel[k], np.zeros((1, kernel.shape[2]), np.float32)])
            part = product[places[k:len(places) - (width - 1) + k]]
            total = part if total is None else total + part
        # From the window that ends with a text's first place to the one that begins with its last.
        first = starts - (width - 1)
        total = np.concatenate([total, np.zeros((1, total.shape[1]), np.float32)])
        bounds = np.stack([first, np.where(lengths > 0, starts + lengths, first + 1)], 1).ravel()
        out.append(np.maximum.reduceat(total, bounds, axis=0)[::2])
    return np.concatenate(out, 1)


def margins(model: Model, texts: pa.Array, memory: _Words | None = None) -> np.ndarray:
    """The logistic unit's input for every text."""
    words, codes, ends = split(texts)
    vectors = (memory or _Words()).of(model, words)
    pooled = np.maximum(_answers(model, vectors, codes, ends) + model.bias, 0)
    return (pooled @ model.weights + model.offset).astype(float)


def scores(model: Model, texts: pa.Array, memory: _Words | None = None) -> np.ndarray:
    """Probabilities; a text without words gets the one of an empty text."""
    return 1 / (1 + np.exp(-(model.scale[0] * margins(model, texts, memory) + model.scale[1])))


# --- Training ---------------------------------------------------------------------------------------------------------

@dataclass
class _Corpus:
    """The sample: places of each text as words of one vocabulary, and each word's buckets."""
    texts: list[np.ndarray]
    flat: np.ndarray
    sizes: np.ndarray
    firsts: np.ndarray

    def buckets_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = self.sizes[words]
        before = np.cumsum(sizes) - sizes
        return self.flat[np.repeat(self.firsts[words] - before, sizes) + np.arange(sizes.sum())], sizes


def _corpus(texts: list[str]) -> _Corpus:
    known: dict[str, int] = {}
    places = []
    for text in texts:
        words, codes, _ = split(pa.array([text], pa.string()))
        places.append(np.array([known.setdefault(w, len(known)) for w in words], np.int64)[codes])
    flat, sizes = _spell(list(known))
    return _Corpus(places, flat, sizes, np.cumsum(sizes) - sizes)


def _start(corpus: _Corpus, labels: np.ndarray, taught: np.ndarray, seed: int) -> Model:
    """Noise, and in the first direction the log odds of each bucket, drawn to zero where it was rarely seen."""
    rng = np.random.default_rng(seed)
    seen = np.zeros((2, BUCKETS))
    for i in taught:
        seen[int(labels[i]), np.unique(corpus.buckets_of(np.unique(corpus.texts[i]))[0])] += 1
    total = np.array([max((labels[taught] == k).sum(), 1) for k in (0, 1)])[:, None]
    share = (seen.sum(0) + 1) / (total.sum() + 2)
    rate = (seen + 8 * share) / (total + 8)
    embeddings = rng.normal(0, 0.05, (BUCKETS, WIDTH)).astype(np.float32)
    embeddings[:, 0] = np.log(rate[1] / rate[0])
    filters = [rng.normal(0, 0.2, (w, WIDTH, FILTERS)).astype(np.float32) for w in WIDTHS]
    for w, kernel in zip(WIDTHS, filters):
        kernel[:, :, 0] = 0
        kernel[:, 0, 0] = 1 / w
    weights = rng.normal(0, 0.05, FILTERS * len(WIDTHS)).astype(np.float32)
    weights[::FILTERS] = 0.5
    return Model(embeddings, filters, np.zeros(len(weights), np.float32), weights, -1.0)


def _step(model: Model, memory: dict[str, np.ndarray], corpus: _Corpus, batch: np.ndarray, labels: np.ndarray,
          importance: np.ndarray, rate: float) -> None:
    """One step of Adagrad on a batch; only the windows that win a maximum carry a gradient."""
    used = np.unique(np.concatenate([corpus.texts[i] for i in batch]))
    flat, sizes = corpus.buckets_of(used)
    vectors = np.concatenate([_vectors(model.embeddings, flat, sizes), np.zeros((1, WIDTH), np.float32)])
    blank, n = np.full(_LEAD, len(used)), len(batch)
    rows = [np.concatenate([blank, np.searchsorted(used, corpus.texts[i]), blank]) for i in batch]
    products = [[vectors @ kernel[k] for k in range(w)] for w, kernel in zip(WIDTHS, model.filters)]
    pooled, winners = np.zeros((n, len(model.weights)), np.float32), np.zeros((n, len(model.weights)), np.int64)
    lanes = np.arange(FILTERS)
    for i, row in enumerate(rows):
        for g, width in enumerate(WIDTHS):
            first, count = _LEAD - (width - 1), max(len(row) - 2 * _LEAD + width - 1, 1)
            total = sum(products[g][k][row[first + k:first + k + count]] for k in range(width))
            at = total.argmax(0)
            own = slice(g * FILTERS, (g + 1) * FILTERS)
            pooled[i, own], winners[i, own] = total[at, lanes], at + first
    active = pooled + model.bias
    hidden = np.maximum(active, 0)
    error = (1 / (1 + np.exp(-(hidden @ model.weights + model.offset))) - labels) * importance / n
    back = error[:, None] * model.weights * (active > 0)
    moved = np.zeros_like(vectors)
    kernels = [np.zeros_like(k) for k in model.filters]
    for g, (width, kernel) in enumerate(zip(WIDTHS, model.filters)):
        own = slice(g * FILTERS, (g + 1) * FILTERS)
        for k in range(width):
            word = np.stack([rows[i][winners[i, own] + k] for i in range(n)])            # texts x filters
            d = back[:, own]
            kernels[g][k] = np.einsum("nfd,nf->df", vectors[word], d)
            np.add.at(moved, word.ravel(), (kernel[k].T[None] * d[:, :, None]).reshape(-1, WIDTH))
    for key, value in (("weights", hidden.T @ error), ("bias", back.sum(0))):
        memory[key] += value ** 2
        setattr(model, key, (getattr(model, key) - rate * value / np.sqrt(memory[key])).astype(np.float32))
    model.offset -= rate * float(error.sum())
    for g, value in enumerate(kernels):
        memory[f"filter {g}"] += value ** 2
        model.filters[g] = (model.filters[g] - rate * value / np.sqrt(memory[f"filter {g}"])).astype(np.float32)
    changed = np.flatnonzero(np.abs(moved[:-1]).sum(1))
    if len(changed):
        flat, sizes = corpus.buckets_of(used[changed])
        places, where = np.unique(flat, return_inverse=True)
        value = np.zeros((len(places), WIDTH), np.float32)
        np.add.at(value, where, np.repeat(moved[changed] / sizes[:, None], sizes, axis=0).astype(np.float32))
        memory["embeddings"][places] += value ** 2
        model.embeddings[places] -= rate * value / np.sqrt(memory["embeddings"][places])


def teach(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """A model from labelled texts, not calibrated; without both labels, one that always gives the label's share."""
    labels = np.asarray(labels, float)
    taught = np.arange(len(labels))
    corpus = _corpus(texts)
    model = _start(corpus, labels, taught, seed)
    if not len(labels) or labels.min() == labels.max():
        model.weights[:] = 0
        model.offset = float(np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5))) if len(labels) else -5.0
        return model
    positives = labels[taught].mean()
    importance = np.where(labels > 0, np.sqrt((1 - positives) / positives), 1.0)
    memory = {"weights": np.full(model.weights.shape, 1e-3), "bias": np.full(model.bias.shape, 1e-3),
              "embeddings": np.full(model.embeddings.shape, 1e-4, np.float32)}
    memory |= {f"filter {g}": np.full(k.shape, 1e-3) for g, k in enumerate(model.filters)}
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        for batch in np.array_split(rng.permutation(taught), max(1, len(taught) // BATCH)):
            _step(model, memory, corpus, batch, labels[batch], importance[batch], RATE / (1 + epoch))
    model.key = xxhash.xxh64_hexdigest(model.embeddings.tobytes() + model.weights.tobytes())
    return model


def settle(model: Model, margin: np.ndarray, labels: np.ndarray, counts: np.ndarray, languages: np.ndarray, taught: np.ndarray) -> None:
    """Set scale and thresholds from counts of rows by margin, label, language and whether the model was taught them.

    Taught rows only tell how frequent a label is, unless the others lack one.
    """
    judged = ~taught
    if any(not counts[judged & (labels == k)].sum() for k in (0, 1)):
        judged = np.ones(len(labels), bool)
    if len(np.unique(labels)) < 2:
        return
    rows = counts.astype(float)
    for k in (0, 1):
        rows[labels == k] *= counts[labels == k].sum() / counts[judged & (labels == k)].sum()
    margin, labels, counts, rows, languages = (x[judged] for x in (margin, labels, counts, rows, languages))
    model.scale = calibrate(margin, labels, counts=rows)

    def threshold(own: np.ndarray) -> float:
        places, where = np.unique(margin[own], return_inverse=True)
        p = 1 / (1 + np.exp(-(model.scale[0] * places + model.scale[1])))
        return best_threshold(p, np.bincount(where, (rows * labels)[own]), n=np.bincount(where, rows[own]))

    model.threshold = threshold(np.ones(len(labels), bool))
    for language in sorted(set(languages.tolist()) - {""}):
        own = languages == language
        if counts[own & (labels > 0)].sum() >= LEAST_POSITIVES:
            model.thresholds[language] = threshold(own)


def fit(texts: list[str], labels: np.ndarray, languages: list[str | None], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """A calibrated model from labelled texts in memory."""
    labels = np.asarray(labels, float)
    taught = np.array([xxhash.xxh32_intdigest(t) % HELD != 0 for t in texts], bool)
    if len(np.unique(labels[taught])) < 2:
        taught[:] = True
    model = teach([t for t, own in zip(texts, taught) if own], labels[taught], epochs, seed)
    if model.key:
        margin = np.concatenate([margins(model, pa.array(texts[i:i + 64], pa.string())) for i in range(0, len(texts), 64)])
        settle(model, margin, labels, np.ones(len(labels)), np.array([x or "" for x in languages]), taught)
    return model


def best_threshold(p: np.ndarray, y: np.ndarray, least: float = 0.3, most: float = 0.8, n: np.ndarray | None = None) -> float:
    """The middle of the widest stretch of thresholds with the best F1, kept within sensible chances.

    `y` holds the positives at each chance and `n` the rows there, one each if not given.
    """
    order = np.argsort(-p, kind="stable")
    hits, n = np.cumsum(y[order]), np.cumsum(np.ones(len(y)) if n is None else n[order])
    f1 = 2 * hits / (n + max(y.sum(), 1))
    at = np.flatnonzero(f1 >= f1.max() - 1e-9)
    gaps = p[order[at]] - np.append(p[order], 0.0)[at + 1]
    k = at[int(np.argmax(gaps))]
    return float(np.clip((p[order[k]] + np.append(p[order], 0.0)[k + 1]) / 2, least, most))


def fold(id_: Column) -> Column:
    """crc32 of the id as text, modulo 4; a null id counts as an empty text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 4


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          lang_col: str | None = "lang", held_out: int = 2, sample: int = SAMPLE, epochs: int = EPOCHS) -> Model:
    """A model from labelled rows outside the fold `held_out`.

    The network learns from at most `sample` of them, half of each label if there are so many, taken by the hash of their
    id; only these reach the driver. All the others that do not repeat a taught text are scored, and their counts by
    language, label and margin calibrate. Rows without text or label teach nothing.
    """
    known = (labels.select(name(id_col).alias("id"), name(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
             .where(fold(F.col("id")) != held_out).groupBy("id").agg(F.max("label").alias("label")))
    language = F.lit(None).cast("string") if lang_col is None or lang_col not in docs.columns else name(lang_col).cast("string")
    texts = docs.select(name(id_col).alias("id"), name(text_col).alias("text"), language.alias("lang")).where("text is not null")
    half = sample // 2
    # Left back by a hash that has nothing to do with the order of the others; if a label is lost by that, nothing is.
    for pool in (known.where(F.pmod(F.xxhash64(F.lit("held"), F.col("id")), F.lit(HELD)) != 0), known):
        chosen = None
        for label in (0, 1):
            own = pool.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(half)
            chosen = own if chosen is None else chosen.unionByName(own)
        # Bounded by `sample` rows of two numbers.
        rows = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text")).withColumn(
            "mark", F.xxhash64("text")).toArrow().sort_by("id")
        if len(rows.column("label").unique()) == 2:
            break
    model = teach(rows.column("text").to_pylist(), rows.column("label").to_numpy(), epochs)
    marks = sorted(set(rows.column("mark").to_pylist()))
    del rows
    release()
    if not model.key:
        return model
    spark = docs.sparkSession
    # From Arrow: a list of rows would start further Python workers on the executors, which stay.
    taught = spark.createDataFrame(pa.table({"mark": pa.array(marks, pa.int64())})).withColumn("taught", F.lit(True))
    judged = score(texts.where(fold(F.col("id")) != held_out).select("id", "lang", F.xxhash64("text").alias("mark"), "text"), model)
    chance = F.least(F.greatest("score", F.lit(1e-12)), F.lit(1 - 1e-12))
    place = F.floor(F.log(chance / (1 - chance)) * STEPS).cast("int")
    found = (judged.select("id", F.coalesce("lang", F.lit("")).alias("lang"), "mark", place.alias("place"))
             .join(F.broadcast(taught), "mark", "left").join(known, "id")
             .groupBy("lang", "label", "place", F.col("taught").isNotNull().alias("taught")).agg(F.count("*").alias("n")).toArrow())
    columns = {c: np.array(found.column(c).to_pylist()) for c in found.column_names}
    settle(model, (columns["place"] + 0.5) / STEPS, columns["label"].astype(float), columns["n"], columns["lang"], columns["taught"].astype(bool))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """`docs` with the score of every whole text; null and wordless texts get that of an empty text. No shuffle.

    An input column named like the result is replaced. Whole rows cross to Python, so the session's Arrow batches are bounded.
    """
    bound_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.DoubleType())])
    names = [f.name for f in kept]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = per_worker(f"vectors {model.key}", _Words)
        for batch in batches:
            for first, texts in slices(batch.column(names.index(text_col)), SLICE):
                values = pa.array(scores(model, texts, memory))
                yield pa.RecordBatch.from_arrays([c.slice(first, len(texts)) for c in batch.columns] + [values], names=schema.names)
        release()

    return docs.select(*[name(n) for n in names]).mapInArrow(judge, schema)


def rejected(model: Model, score_col: str = "score", lang_col: str | None = "lang") -> Column:
    """Whether the score reaches the threshold of the row's language, or the common one."""
    common = F.lit(model.threshold)
    if lang_col is None or not model.thresholds:
        return F.col(score_col) >= common
    known = F.create_map(*[F.lit(x) for item in model.thresholds.items() for x in item])
    return F.col(score_col) >= F.coalesce(known[F.coalesce(name(lang_col).cast("string"), F.lit(""))], common)
