"""The byte n-gram model of the quality rules: loops over dictionaries, cuts into ranges, edge cases."""

import collections
import math
import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgewatch.llm import byte_grams, quality_rules
from ridgewatch.llm.queries import QUERIES
from tests.llm.test_corpus_operators import band, base

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id bigint, lang string, text string"


class Loops:
    """Modified Kneser-Ney over five bytes in dictionaries."""

    def __init__(self, texts):
        self.counts = {5: collections.Counter(g for t in texts for g in self.grams(t))}
        for k in (4, 3, 2, 1):
            self.counts[k] = collections.Counter(g[1:] for g in self.counts[k + 1])
        self.cut, self.sums, self.kinds = {}, {}, {}
        for k in (2, 3, 4, 5):
            spread = collections.Counter(self.counts[k].values())
            n1, n2, n3, n4 = (spread[n] for n in (1, 2, 3, 4))
            self.cut[k] = [0, 0.5, 0.75, 0.9]
            if n1 and n2 and n3:
                y = n1 / (n1 + 2 * n2)
                raw = ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))
                self.cut[k] = [0] + [min(max(d, 0.05), n - 0.05) for n, d in raw]
            self.sums[k], self.kinds[k] = collections.Counter(), collections.Counter()
            for g, n in self.counts[k].items():
                self.sums[k][g[:-1]] += n
                self.kinds[k][g[:-1]] += self.cut[k][min(n, 3)]

    @staticmethod
    def grams(text):
        data = bytes(4) + text.encode()
        return [data[i : i + 5] for i in range(len(data) - 4)]

    def chance(self, g):
        if len(g) == 1:
            return 0.999 * self.counts[1][g] / sum(self.counts[1].values()) + 0.001 / 256
        k, lower = len(g), self.chance(g[1:])
        if not self.sums[k][g[:-1]]:
            return lower
        n = self.counts[k][g]
        return (n - self.cut[k][min(n, 3)] + self.kinds[k][g[:-1]] * lower) / self.sums[k][g[:-1]]

    def log_ppl(self, text):
        found = self.grams(text)
        return -sum(math.log(self.chance(g)) for g in found) / len(found)


def quality(rows):
    """doc_id -> (kept, log_ppl, low, high) by loops. rows: doc_id, lang, text."""
    sizes = collections.Counter(lang or "" for _, lang, _ in rows)
    own = lambda lang: lang if lang and sizes[lang] >= 20 else ""
    failed = [(n := base(t or ""))[0] < 20 or 100 * n[4] > 30 * n[0] for _, _, t in rows]
    out = {}
    for name in {own(lang) for _, lang, _ in rows}:
        mine = [k for k, (_, lang, _) in enumerate(rows) if own(lang) == name]
        train = [rows[k][2] for k in mine if rows[k][2]]
        for width in (byte_grams.TRIM_WIDTH, byte_grams.BAND_WIDTH):
            model = Loops(train) if train else None
            ppl = {k: model.log_ppl(rows[k][2]) for k in mine if rows[k][2] and model}
            good = [ppl[k] for k in ppl if not failed[k]]
            low, high = band(good, width) if len(good) >= 20 else (None, None)
            train = [rows[k][2] for k in ppl if not failed[k] and (low is None or low <= ppl[k] <= high)]
        for k in mine:
            inside = k not in ppl or low is None or low <= ppl[k] <= high
            out[rows[k][0]] = not failed[k] and inside, ppl.get(k), low, high
    return out


def verdicts(spark, rows):
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    return {r.doc_id: r for r in quality_rules.verdicts(df, byte_grams.METHOD).collect()}


def test_query_equals_loops(spark):
    rows = [(r.doc_id, r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in QUERIES["op8_quality_rules"](spark, SF).collect()}
    wanted = quality(rows)
    assert set(got) == set(wanted) and any(not got[k].kept and not got[k].base_failed for k in got)
    for doc, (kept, ppl, low, high) in wanted.items():
        assert got[doc].log_ppl == pytest.approx(ppl, abs=2e-4)
        assert (got[doc].low, got[doc].high) == (pytest.approx(low, abs=5e-3), pytest.approx(high, abs=5e-3))
        if low is None or min(abs(ppl - low), abs(ppl - high)) > 6e-3:
            assert got[doc].kept == kept


def test_ranges_do_not_change_results(spark, monkeypatch):
    rng, rows = random.Random(8), []
    for lang, letters in (("x", "abcdefg \n"), ("y", "αβγд一二 "), (None, "qrst\x00 ")):
        rows += [(len(rows) + k, lang, "".join(rng.choice(letters) for _ in range(rng.randint(40, 300)))) for k in range(25)]
    rows += [(900, "x", None), (901, "x", ""), (902, "rare", "αβγ abc " * 9), (903, "x", "ZZ" * 70)]
    whole = verdicts(spark, rows)
    wanted = quality(rows)
    models = []
    adder = byte_grams._adder
    monkeypatch.setattr(byte_grams, "_adder", lambda df, model: models.append(model) or adder(df, model))
    monkeypatch.setattr(byte_grams, "MODEL_GRAMS", 1500)
    monkeypatch.setattr(byte_grams, "BLOCK", 64)
    monkeypatch.setattr(byte_grams, "FLUSH", 50)
    cut = verdicts(spark, rows)
    assert len(models) > 6 and max(len(t[0]) for m in models for t in m.tables.values()) <= 1500
    for doc, (_, ppl, *_) in wanted.items():
        if ppl is None:
            assert whole[doc].log_ppl is None and cut[doc].log_ppl is None
        else:
            assert whole[doc].log_ppl == pytest.approx(ppl, abs=2e-4)
            assert cut[doc].log_ppl == pytest.approx(whole[doc].log_ppl, abs=1e-5)
        assert cut[doc].kept == whole[doc].kept


def test_model_is_a_distribution(spark):
    texts = ["abracadabra and a cadaver", "a bra on a café table", "cad"]
    df = spark.createDataFrame([(k, "", t) for k, t in enumerate(texts)], COLUMNS)
    (model,) = byte_grams.train(df, {"": 0})
    for context in (b"abra", b"\0\0\0\0", b"zzzz", b"zabr", b"zzca", b"zzza", b" caf"):
        code = np.array([int.from_bytes(context + bytes([e]), "big") for e in range(256)], dtype=np.uint64)
        assert np.exp(model.logs(0, code)).sum() == pytest.approx(1, abs=1e-5)


def test_bytes_are_told_apart(spark):
    """Symbols, cases and digits that a folded alphabet takes for one another."""
    rng = random.Random(6)
    vocabulary = ["the", "house", "stands", "on", "a", "hill", "near", "water", "in", "1850"]
    good = [(k, "en", " ".join(rng.choice(vocabulary) for _ in range(80))) for k in range(80)]
    odd = [(500, "en", good[0][2].upper()), (501, "en", " ".join(str(rng.randint(0, 9999)) for _ in range(80)))]
    got = verdicts(spark, good + odd)
    assert not any(got[k].kept or got[k].base_failed for k in (500, 501)) and all(got[k].kept for k in range(80) if not got[k].base_failed)


def test_edges(spark):
    good = [(k, " ".join(f"the word{(k * j) % 97} of" for j in range(1, 20)), "en", k) for k in range(60)]
    rows = good + [(100, None, "en", 1), (101, "", None, 1), (None, good[0][1], None, 1), (103, "一鿿あ" * 80 + " x" * 25, "en", 1), (103, good[1][1], "xx", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, log_ppl int").withColumn("kept", F.lit("clash"))
    got = quality_rules.verdicts(df, byte_grams.METHOD).collect()
    kept = quality_rules.keep_good(df, byte_grams.METHOD)
    ids = [r.doc_id for r in kept.collect()]
    assert len(got) == len(rows) and kept.columns == df.columns and 100 not in ids and 101 not in ids
    assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in got if r.kept) and len(ids) > 50
    assert quality_rules.verdicts(df.limit(0), byte_grams.METHOD).count() == 0


def test_bands_reject_bad_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    rows = quality_rules.verdicts(docs, byte_grams.METHOD).where("not base_failed").join(labels, "doc_id").groupBy("quality").agg(
        F.count("*").alias("n"), F.count_if(~F.col("kept")).alias("gone")
    ).collect()
    share = {r.quality: r.gone / r.n for r in rows}
    assert share[0] > 0.6 and share[1] < 0.03


def test_pipeline_stage_tells_bytes_apart(spark):
    rng = random.Random(6)
    vocabulary = ["the", "house", "stands", "on", "a", "hill", "near", "water", "in", "by"]
    good = [(k, "en", " ".join(rng.choice(vocabulary) for _ in range(80))) for k in range(80)]
    mixed = "".join(rng.choice((c, c.upper())) for c in good[0][2])
    df = spark.createDataFrame([*good, (500, "en", mixed)], COLUMNS)
    left = {r.doc_id for r in corpus_pipeline.quality_stage(spark, df, SF).collect()}
    assert 500 not in left and left == {r.doc_id for r in quality_rules.verdicts(df, byte_grams.METHOD).where("kept").collect()}
    assert 500 in {r.doc_id for r in quality_rules.keep_good(df).collect()}  # the classes take it for its lower case
