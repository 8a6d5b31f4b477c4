"""The language model of the quality rules: modified Kneser-Ney n-grams of five bytes.

The n-grams are those of the text's own UTF-8 bytes, none folded into another. Spark counts them over all whole texts of
each language. An n-gram's key is its language and its bytes, the third and fourth ones first. All that the estimate of an n-gram
abcde needs of the orders 3 to 5 (abcd, bcde, bcd, cde, cd) has the same c and d, so the counts are sorted by this key and cut
between two such pairs into ranges of at most MODEL_GRAMS n-grams (or one pair). Each range is a model of its own, sorted arrays
that are searched by bisection, and scores the places of a text whose c and d it holds; a text's perplexity is the sum over
all ranges, in one pass over the documents for each. So what is collected or broadcast at once doesn't grow with the corpus,
nothing is pruned, and no result depends on the cuts. Orders 1 and 2 are a table of 65,536 pairs for each language.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgewatch.llm import quality_rules
from ridgewatch.llm.common import discard, give_back_memory, small_batches, store

ORDER = 5
#: N-grams of a range: at most some 100 MB of arrays.
MODEL_GRAMS = 2_000_000
#: Bytes of a text that are looked at at once, and n-grams that a counting task holds before it hands them on.
BLOCK, FLUSH = 1 << 20, 1 << 20
#: Rows of a batch of counts.
BATCH = 1 << 17
#: Quartile distances, chosen on the labelled rows of sf0.1 outside the held-out fold, and the same for all data. The
#: second training leaves out much that is good, too: five bytes would otherwise learn the noise by heart.
TRIM_WIDTH, BAND_WIDTH = 0.25, 6.0
_U = np.uint64


def _low(code: np.ndarray, order: int) -> np.ndarray:
    """The last bytes of n-grams."""
    return code & _U((1 << 8 * order) - 1)


def grams(text: str) -> Iterator[np.ndarray]:
    """A text's n-grams as numbers of five bytes, one for each byte, in blocks; zeros are before the text."""
    data = text.encode()
    for start in range(0, len(data), BLOCK):
        piece = data[max(start - ORDER + 1, 0) : start + BLOCK]
        size = min(BLOCK, len(data) - start)
        points = np.zeros(size + ORDER - 1, dtype=_U)
        points[len(points) - len(piece) :] = np.frombuffer(piece, dtype=np.uint8)
        code = np.zeros(size, dtype=_U)
        for k in range(ORDER):
            code = code << _U(8) | points[k : k + size]
        yield code


def _key(code: np.ndarray) -> np.ndarray:
    """abcde to cdabe."""
    return (code >> _U(8) & _U(0xFFFF)) << _U(24) | code >> _U(24) << _U(8) | code & _U(0xFF)


def _code(key: np.ndarray) -> np.ndarray:
    """cdabe to abcde."""
    return (key >> _U(8) & _U(0xFFFF)) << _U(24) | (key >> _U(24) & _U(0xFFFF)) << _U(8) | key & _U(0xFF)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, count = key[order], count[order]
    starts = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0] if len(key) else np.zeros(0, np.int64)
    return key[starts], np.add.reduceat(count, starts) if len(key) else count


def _number(langs: dict[str, int], lang: str | None) -> int:
    return langs.get(lang or quality_rules.OTHER, langs.get(quality_rules.OTHER, -1))


def gram_counts(documents: DataFrame, langs: dict[str, int]) -> DataFrame:
    """How often each n-gram occurs in each model's texts: gram (the model's number, then the key), n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, count = np.zeros(0, _U), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for start in range(0, len(key), BATCH):
                part = slice(start, start + BATCH)
                yield pa.RecordBatch.from_arrays([pa.array(key[part].astype(np.int64)), pa.array(count[part])], ["gram", "n"])

        def gathered() -> tuple[np.ndarray, np.ndarray]:
            new, times = np.unique(np.concatenate(waiting), return_counts=True)
            return _summed([key, new], [count, times])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                top = _U(_number(langs, name) << 40)
                for code in grams(text.as_py() or ""):
                    waiting.append(_key(code) | top)
                    size += len(code)
                    if size >= BLOCK:
                        key, count = gathered()
                        waiting, size = [], 0
                        if len(key) >= FLUSH:
                            yield from out()
                            key, count = key[:0], count[:0]
        if waiting:
            key, count = gathered()
        yield from out()
        give_back_memory()

    rows = documents.select(F.col("lang").cast("string"), "text").mapInArrow(run, "gram bigint, n bigint")
    return rows.groupBy("gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Model:
    """One range: places whose language and third and fourth byte are from first to before last.

    pairs: for each trained language the log-probabilities of all pairs of bytes; tables: for each language and order
    its sorted n-grams, their log-probabilities, the sorted contexts and their log-weights.
    """

    langs: dict[str, int]
    first: int
    last: int
    pairs: dict[int, np.ndarray]
    tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def logs(self, number: int, code: np.ndarray) -> np.ndarray:
        """Log-probabilities of n-grams of this range."""
        out, left = np.zeros(len(code)), np.arange(len(code))
        for order in range(ORDER, 2, -1):
            if (number, order) not in self.tables:
                continue
            seen, logs, contexts, weights = self.tables[number, order]
            wanted = _low(code[left], order)
            at = np.minimum(np.searchsorted(seen, wanted), len(seen) - 1)
            found = seen[at] == wanted
            out[left[found]] += logs[at[found]]
            left, wanted = left[~found], wanted[~found] >> _U(8)
            at = np.minimum(np.searchsorted(contexts, wanted), len(contexts) - 1)
            out[left] += np.where(contexts[at] == wanted, weights[at], 0.0)
        out[left] += self.pairs[number][_low(code[left], 2).astype(np.int64)]
        return out

    def total(self, lang: str | None, text: str) -> float | None:
        """The sum of the log-probabilities of a text's bytes that lie in this range."""
        number = _number(self.langs, lang)
        if not text or number not in self.pairs:
            return None
        total = 0.0
        for block in grams(text):
            code, counts = np.unique(block, return_counts=True)
            place = (code >> _U(8) & _U(0xFFFF)).astype(np.int64) + (number << 16)
            if self.first > place.min() or self.last <= place.max():
                inside = (place >= self.first) & (place < self.last)
                code, counts = code[inside], counts[inside]
            total += float((self.logs(number, code) * counts).sum())
        return total


def _orders(gram: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, dict[int, tuple[np.ndarray, np.ndarray]]]]:
    """For each language of a range its n-grams of the orders 5 to 3, sorted, with counts (below 5: of the bytes before)."""
    number = gram >> _U(40)
    for lang in np.unique(number):
        mine = number == lang
        key, counts = gram[mine], n[mine]
        code = _code(key)
        order = np.argsort(code)
        found = {ORDER: (code[order], counts[order])}
        for k in range(ORDER - 1, 2, -1):
            found[k] = np.unique(_low(found[k + 1][0], k), return_counts=True)
        yield int(lang), found


def _spectrum(counts: np.ndarray) -> np.ndarray:
    """How many counts are 1, 2, 3 and 4."""
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].astype(np.float64)


def _estimate(
    code: np.ndarray, counts: np.ndarray, discount: np.ndarray, lower: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities of an order's n-grams, all contexts, and the lower order's weight after each."""
    contexts, place = np.unique(code >> _U(8), return_inverse=True)
    cut, total = discount[np.minimum(counts, 3)], np.bincount(place, weights=counts)
    weight = np.bincount(place, weights=cut) / total
    return (counts - cut) / total[place] + weight[place] * lower, contexts, weight


def _log(p: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(p, 1e-12)).astype(np.float32)


def _pairs(two: np.ndarray) -> np.ndarray:
    """Probabilities of all pairs of bytes, from how many bytes were seen before each."""
    seen = np.nonzero(two)[0]
    ends = np.bincount(seen & 0xFF, minlength=256)
    one = 0.999 * ends / ends.sum() + 0.001 / 256
    discount = quality_rules.discounts(_spectrum(two[seen]))
    probability, contexts, weight = _estimate(seen.astype(_U), two[seen], discount, one[seen & 0xFF])
    after = np.ones(256)
    after[contexts.astype(np.int64)] = weight
    out = np.repeat(after, 256) * np.tile(one, 256)
    out[seen] = probability
    return out


def train(documents: DataFrame, langs: dict[str, int]) -> Iterator[Model]:
    """The ranges' models of some languages, at most PASS_LANGS, from documents (columns text and lang)."""
    counted = store(gram_counts(documents, langs), "quality-grams")
    cuts = [0]
    if counted.count() > MODEL_GRAMS:
        held = 0
        units = counted.groupBy(F.shiftright("gram", 24).alias("unit")).agg(F.count("*").alias("n"))
        for unit, n in units.orderBy("unit").collect():  # bounded: PASS_LANGS * 65536 rows
            if held and held + n > MODEL_GRAMS:
                cuts.append(unit)
                held = 0
            held += n
    ranges = list(zip(cuts, [*cuts[1:], len(langs) << 16]))

    def collected(first: int, last: int) -> Iterator[tuple[int, dict[int, tuple[np.ndarray, np.ndarray]]]]:
        part = counted.where(F.shiftright("gram", 24).between(first, last - 1)).toArrow()
        return _orders(part.column("gram").to_numpy().astype(_U), part.column("n").to_numpy())

    spectra: dict[tuple[int, int], np.ndarray] = {}
    twos: dict[int, np.ndarray] = {}
    kept = []
    for bounds in ranges:
        for lang, found in collected(*bounds):
            for order, (_, counts) in found.items():
                spectra[lang, order] = spectra.get((lang, order), 0) + _spectrum(counts)
            twos[lang] = twos.get(lang, 0) + np.bincount(_low(found[3][0], 2).astype(np.int64), minlength=1 << 16)
            if len(ranges) == 1:
                kept.append((lang, found))
    pairs = {lang: _pairs(two) for lang, two in twos.items()}
    logs = {lang: _log(p) for lang, p in pairs.items()}
    for bounds in ranges:
        tables = {}
        for lang, found in kept if len(ranges) == 1 else collected(*bounds):
            lower = pairs[lang][_low(found[3][0], 2).astype(np.int64)]
            for order in range(3, ORDER + 1):
                code, counts = found[order]
                if order > 3:
                    lower = probability[np.searchsorted(found[order - 1][0], _low(code, order - 1))]
                probability, contexts, weight = _estimate(code, counts, quality_rules.discounts(spectra[lang, order]), lower)
                tables[lang, order] = code, _log(probability), contexts, _log(weight)
        yield Model(langs, *bounds, logs, tables)
    discard(counted)


def _adder(documents: DataFrame, model: Model) -> tuple[list[T.StructField], Callable[[pa.RecordBatch], list[pa.Array]]]:
    """Maker of log_ppl, the mean negative log-probability of a text's bytes: this range's part, beside what is there."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    before = "log_ppl" in documents.columns

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        langs, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("lang", "text"))
        held = batch.column(batch.schema.get_field_index("log_ppl")).to_pylist() if before else [0.0] * len(texts)
        out = []
        for lang, text, so_far in zip(langs, texts, held):
            total = shared.value.total(lang, text or "")
            out.append(None if total is None else so_far - total / len(text.encode()))
        return [pa.array(out, pa.float64())]

    return [T.StructField("log_ppl", T.DoubleType())], make


def scores(
    rows: DataFrame, training: DataFrame, langs: dict[str, int], makers: list[tuple], drop: tuple[str, ...], name: str
) -> DataFrame:
    """A stored table of rows, without the columns in drop, with the makers' columns and log_ppl."""
    out, last, models = None, None, train(training, langs)
    with small_batches(rows.sparkSession):
        model = next(models)
    while model is not None:
        with small_batches(rows.sparkSession):
            following = next(models, None)
        added, gone = [*([] if out else makers), _adder(out or rows, model)], ("log_ppl",) if out else ()
        last, out = out, store(quality_rules.adding(out or rows, added, gone if following else (*gone, *drop)), name)
        if last is not None:
            discard(last)
        model = following
    return out


METHOD = quality_rules.Method(scores, TRIM_WIDTH, BAND_WIDTH)
