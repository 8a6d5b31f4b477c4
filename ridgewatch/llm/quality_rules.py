"""Quality rules: counting rules and an n-gram perplexity band for each language.

Which language model gives the perplexity is a Method. The queries take byte_grams.METHOD, n-grams of five bytes. The one
here, CLASS_METHOD, is coarser: a modified Kneser-Ney trigram model over 64 character classes, which folds characters into
one another (both cases of a letter, all digits), so that a model has a proven bound: at most 64**3 trigrams, 64**2 bigrams and 64 unigrams for each language (3 MB), whatever
the corpus; that is what may be broadcast. Spark counts the trigrams of all whole texts; the model's tables are sorted
arrays of 64-bit hashes of (language, order, n-gram) beside the log-probabilities, searched by bisection.

Every language of MODEL_LEAST documents or more has a model and a band of its own; rarer ones, null and empty names
share one of each. PASS_LANGS languages are counted, scored and judged in one pass; more languages take further passes,
each over its own languages' documents, so no broadcast grows with their number and no result depends on it.

Models are trained twice: on all documents, and then without those that the counting rules reject or whose perplexity
is outside the method's width of trimming, so that the model doesn't come to expect the noise that it should reject.

A document is rejected by a rule (too few words, too many of its words in repeated windows) or when its perplexity is
outside its language's band: the quartiles of the log-perplexity of all documents of that language that pass the
counting rules, widened by the width of its band times their distance on either side.

Defined results: null text has no words, fails the rules and has no perplexity; a text without characters has none;
where fewer than MODEL_LEAST documents share a model there is no band; repeated rows count each; an empty table has no
rows; a column of the input's that is named like one of the results is replaced or, when documents are kept, stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgewatch.llm import textstats
from ridgewatch.llm.common import discard, give_back_memory, map_batches, small_batches, store

CLASSES = 64
PASS_LANGS = 16
MIN_WORDS = 20
#: In hundredths of a document's words.
MAX_REPEATED = 30
#: Quartile distances. Chosen on the labelled rows of sf0.1 outside the held-out fold, and the same for all data.
TRIM_WIDTH, BAND_WIDTH = 2.0, 4.0
MODEL_LEAST = 20
BAND_STEPS = 10_000
#: Characters that a counting task gathers before it adds them to its table.
GATHER = 1 << 20
OTHER = ""


def _class_table() -> np.ndarray:
    """The class of each code point below 65536: letters 1 to 26, digits 27, white space 28, other ASCII by a hash.

    Beyond ASCII all classes but 0 are dealt by a hash: in a script of its own, letters are told apart by them.
    """
    points = np.arange(1 << 16, dtype=np.uint64)
    ascii_mixed = (points * np.uint64(2654435761) >> np.uint64(7)) & np.uint64(0xFFFF)
    mixed = points * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    out = np.where(points < 128, 29 + ascii_mixed % 15, 1 + mixed % (CLASSES - 2)).astype(np.uint8)
    for first in (65, 97):
        out[first : first + 26] = np.arange(1, 27)
    out[48:58] = 27
    out[[9, 10, 11, 12, 13, 32]] = 28
    return out


_TABLE = _class_table()


def trigram_codes(text: str) -> np.ndarray:
    """A text's trigrams of classes as numbers below CLASSES**3, one for each character; class 0 is before the text."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    classes = np.zeros(len(points) + 2, dtype=np.uint32)
    classes[2:] = _TABLE[np.minimum(points, 0xFFFF)]
    return classes[:-2] * CLASSES**2 + classes[1:-1] * CLASSES + classes[2:]


def _hash(lang: int, order: int, code: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams (the finaliser of splitmix64, a bijection, so they don't collide)."""
    with np.errstate(over="ignore"):
        x = code.astype(np.uint64) + (np.uint64(lang * 4 + order) << np.uint64(32)) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


def _discounts(counts: np.ndarray) -> np.ndarray:
    return discounts([float((counts == k).sum()) for k in (1, 2, 3, 4)])


def discounts(spectrum: Sequence[float]) -> np.ndarray:
    """Modified Kneser-Ney's discounts for counts of 0, 1, 2, and 3 or more, from how many counts are 1, 2, 3 and 4."""
    n1, n2, n3, n4 = spectrum
    if not (n1 and n2 and n3):
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))])


def _order(code: np.ndarray, counts: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order's probabilities of the n-grams seen, and the weight of the lower order after each context.

    code: context * CLASSES + class; lower: the lower order's probability of each of these n-grams.
    """
    context, discount = code // CLASSES, _discounts(counts)
    size = int(context.max()) + 1
    total = np.bincount(context, weights=counts, minlength=size)
    cut = discount[np.minimum(counts, 3)]
    weight = np.bincount(context, weights=cut, minlength=size) / np.maximum(total, 1)
    return (counts - cut) / total[context] + weight[context] * lower, weight


@dataclass(frozen=True)
class Model:
    """langs: the languages with a model of their own; keys: sorted hashes; values: their log-probability or weight.

    Orders 1 to 3 hold log-probabilities of n-grams; order 0 holds the log-weight after a context, of two classes, or
    of one if its code is CLASSES**2 or more.
    """

    langs: dict[str, int]
    keys: np.ndarray
    values: np.ndarray
    trained: frozenset[int]

    def _look(self, lang: int, order: int, code: np.ndarray, absent: float) -> tuple[np.ndarray, np.ndarray]:
        wanted = _hash(lang, order, code)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        found = self.keys[at] == wanted
        return np.where(found, self.values[at], absent), found

    def _logs(self, number: int, code: np.ndarray) -> np.ndarray:
        """Log-probabilities of trigrams in one model."""
        logs, found = self._look(number, 3, code, 0.0)
        if not found.all():
            rest = code[~found]
            two, seen = self._look(number, 2, rest % CLASSES**2, 0.0)
            one, _ = self._look(number, 1, rest % CLASSES, -np.log(1e6))
            after_one, _ = self._look(number, 0, CLASSES**2 + rest // CLASSES % CLASSES, 0.0)
            after_two, _ = self._look(number, 0, rest // CLASSES, 0.0)
            logs[~found] = after_two + np.where(seen, two, after_one + one)
        return logs

    def number(self, lang: str | None) -> int:
        return self.langs.get(lang or OTHER, self.langs.get(OTHER, -1))

    def log_perplexity(self, lang: str | None, text: str) -> float | None:
        """The mean negative log-probability of a text's characters in its language's model."""
        number = self.number(lang)
        if not text or number not in self.trained:
            return None
        code, counts = np.unique(trigram_codes(text), return_counts=True)
        return float(-(self._logs(number, code) * counts).sum() / counts.sum())


def _arrays(lang: int, code: np.ndarray, counts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """One language's keys and values from its trigram counts."""
    pairs, continuing = np.unique(code % CLASSES**2, return_counts=True)  # in how many trigrams each bigram ends
    singles, ends = np.unique(pairs % CLASSES, return_counts=True)
    unigram = np.full(CLASSES, 1e-6)
    unigram[singles] = 0.999 * ends / ends.sum() + 0.001 / CLASSES
    bigram, weight_one = _order(pairs, continuing, unigram[pairs % CLASSES])
    full = weight_one[np.minimum(np.arange(CLASSES**2) // CLASSES, len(weight_one) - 1)] * np.tile(unigram, CLASSES)
    full[pairs] = bigram
    trigram, weight_two = _order(code, counts, np.maximum(full[code % CLASSES**2], 1e-12))
    one, two = np.nonzero(weight_one)[0], np.nonzero(weight_two)[0]
    parts = [
        (3, code, trigram), (2, pairs, bigram), (1, np.arange(CLASSES), unigram),
        (0, two, weight_two[two]), (0, CLASSES**2 + one, weight_one[one]),
    ]
    return [_hash(lang, o, c) for o, c, _ in parts], [np.log(np.maximum(p, 1e-12)) for _, _, p in parts]


def trigram_counts(documents: DataFrame, langs: dict[str, int]) -> DataFrame:
    """How often each trigram occurs in each model's texts: lang (the model's number), code, n."""
    rows = documents.select(F.col("lang").cast("string"), "text")
    number = Model(langs, np.zeros(0), np.zeros(0), frozenset()).number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        waiting: dict[int, list[np.ndarray]] = {}
        sizes = dict.fromkeys(langs.values(), 0)

        def add(lang: int) -> None:
            if parts := waiting.pop(lang, None):
                new = np.bincount(np.concatenate(parts), minlength=CLASSES**3)
                tables[lang] = tables[lang] + new if lang in tables else new
            sizes[lang] = 0

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if text := text.as_py():
                    lang = number(name)
                    waiting.setdefault(lang, []).append(trigram_codes(text))
                    sizes[lang] += len(text)
                    if sizes[lang] >= GATHER:
                        add(lang)
        for lang in langs.values():
            add(lang)
            if lang in tables:
                code = np.nonzero(tables[lang])[0]
                arrays = [pa.array(np.full(len(code), lang, np.int32)), pa.array(code.astype(np.int32))]
                arrays.append(pa.array(tables[lang][code].astype(np.int64)))
                yield pa.RecordBatch.from_arrays(arrays, ["lang", "code", "n"])
        tables.clear()
        give_back_memory()

    return rows.mapInArrow(run, "lang int, code int, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def train(documents: DataFrame, langs: dict[str, int]) -> Model:
    """The models of some languages, at most PASS_LANGS, from documents (columns text and lang)."""
    with small_batches(documents.sparkSession):
        counted = trigram_counts(documents, langs).toPandas()  # bounded: PASS_LANGS * CLASSES**3 rows
    keys, values, trained = [], [], set()
    for number, part in counted.groupby("lang"):
        part = part.sort_values("code")
        made = _arrays(int(number), part["code"].to_numpy(np.int64), part["n"].to_numpy())
        keys, values = keys + made[0], values + made[1]
        trained.add(int(number))
    key = np.concatenate([*keys, np.zeros(0, np.uint64)])
    order = np.argsort(key)
    value = np.concatenate([*values, np.zeros(0)])[order].astype(np.float32)
    return Model(langs, key[order], value, frozenset(trained))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def count(documents: DataFrame) -> tuple[list[T.StructField], Callable[[pa.RecordBatch], list[pa.Array]]]:
    """Maker of the base counts of each text."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = []
        for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
            data = (text or "").encode()
            words = data.split()
            rows.append(textstats.base_counts(text or "", data, words, textstats.word_ids(words)))
        return [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64()) for _ in COUNTS]

    return [T.StructField(name, T.LongType()) for name in COUNTS], make


def perplexity(documents: DataFrame, model: Model) -> tuple[list[T.StructField], Callable[[pa.RecordBatch], list[pa.Array]]]:
    """Maker of each text's log_ppl."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        langs, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("lang", "text"))
        return [pa.array([shared.value.log_perplexity(lang, text or "") for lang, text in zip(langs, texts)], pa.float64())]

    return [T.StructField("log_ppl", T.DoubleType())], make


def adding(documents: DataFrame, makers: list[tuple], drop: tuple[str, ...] = ()) -> DataFrame:
    """documents, without the columns in drop, with the makers' columns added."""
    added = [field for fields, _ in makers for field in fields]
    stay = [c for c in documents.columns if c not in drop]
    makes = [make for _, make in makers]
    names = [*stay, *(field.name for field in added)]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = [column for make in makes for column in make(batch)]
        return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in stay), *new], names)

    return map_batches(documents, run, T.StructType([*(documents.schema[c] for c in stay), *added]))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def _bands(rows: DataFrame, width: float) -> DataFrame:
    """Per language of rows (band_lang, log_ppl): low and high.

    Quartiles come from counts on a grid of BAND_STEPS to the unit. So they are the same however the rows are dealt, and
    a language costs as many rows as its perplexities have steps.
    """
    counts = rows.groupBy("band_lang", F.floor(F.col("log_ppl") * BAND_STEPS).alias("at")).agg(F.count("*").alias("n"))
    own = Window.partitionBy("band_lang")
    summed = counts.withColumns({"below": F.sum("n").over(own.orderBy("at")), "total": F.sum("n").over(own)})
    quartile = lambda k: F.min(F.when(4 * F.col("below") >= k * F.col("total"), F.col("at"))) / BAND_STEPS
    found = summed.where(F.col("total") >= MODEL_LEAST).groupBy("band_lang").agg(
        quartile(1).alias("first"), quartile(3).alias("third")
    )
    reach = width * (F.col("third") - F.col("first"))
    return found.select("band_lang", (F.col("first") - reach).alias("low"), (F.col("third") + reach).alias("high"))


def judge(scored: DataFrame, own: Column, width: float) -> DataFrame:
    """Adds base_failed, the band of the row's language (low, high) and kept. A band is a row for each language."""
    bands = _bands(scored.where(~base_failed() & F.col("log_ppl").isNotNull()).select(own.alias("band_lang"), "log_ppl"), width)
    inside = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(True))
    return (
        scored.join(F.broadcast(bands), own == F.col("band_lang"), "left").drop("band_lang")
        .withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & inside)
    )


@dataclass(frozen=True)
class Method:
    """A language model and its widths.

    scores: stores the rows of a table, without some columns, with makers' columns and their log_ppl in models that are
    trained on other rows: (rows, training, the languages' numbers, makers, columns to drop, name).
    """

    scores: Callable[[DataFrame, DataFrame, dict[str, int], list[tuple], tuple[str, ...], str], DataFrame]
    trim: float
    band: float


def class_scores(
    rows: DataFrame, training: DataFrame, langs: dict[str, int], makers: list[tuple], drop: tuple[str, ...], name: str
) -> DataFrame:
    return store(adding(rows, [*makers, perplexity(rows, train(training, langs))], drop), name)


CLASS_METHOD = Method(class_scores, TRIM_WIDTH, BAND_WIDTH)


def judged(documents: DataFrame, drop: tuple[str, ...] = (), method: Method = CLASS_METHOD) -> DataFrame:
    """documents, without the columns in drop, with COUNTS, log_ppl, low, high, base_failed and kept of each."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(OTHER))
    # The list has a name for each language of MODEL_LEAST documents or more.
    common = documents.groupBy(lang.alias("lang")).agg(F.count("*").alias("n")).where(
        (F.col("n") >= MODEL_LEAST) & (F.col("lang") != OTHER)
    )
    langs = [row["lang"] for row in common.orderBy(F.desc("n"), "lang").collect()]
    own = F.when(lang.isin(langs), lang).otherwise(F.lit(OTHER))
    every, out = [*langs, OTHER], None
    for start in range(0, len(every), PASS_LANGS):
        names = every[start : start + PASS_LANGS]
        numbers = {name: k for k, name in enumerate(names)}
        rows = documents if len(names) == len(every) else documents.where(own.isin(names))
        first = method.scores(rows, rows, numbers, [count(rows)], (), "quality-first")
        clean = judge(first, own, method.trim).where("kept")
        scored = method.scores(first.drop("log_ppl"), clean, numbers, [], drop, "quality-scored")
        discard(first)
        part = judge(scored, own, method.band)
        out = part if out is None else out.unionByName(part)
    return out


def verdicts(documents: DataFrame, method: Method = CLASS_METHOD) -> DataFrame:
    """Per document: its counts, base_failed, kept, and the perplexity with its band."""
    found = judged(documents.select("doc_id", "lang", "text"), drop=("text",), method=method)
    return found.select("doc_id", *COUNTS, "base_failed", "kept", "log_ppl", "low", "high")


def keep_good(documents: DataFrame, method: Method = CLASS_METHOD) -> DataFrame:
    """The documents that pass, with their columns. Scored rows are stored, so texts are never joined."""
    inner = {name: f"_q{k}" for k, name in enumerate(documents.columns) if name not in ("doc_id", "lang", "text")}
    rows = documents.withColumnsRenamed(inner)  # so that no column clashes with what is added
    back = {inside: name for name, inside in inner.items()}
    return judged(rows, method=method).where("kept").select(*rows.columns).withColumnsRenamed(back)
