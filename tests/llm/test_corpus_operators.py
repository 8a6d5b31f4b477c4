"""Joins, scans, rules and models over a corpus: brute force and edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgewatch.llm import decontaminate, license_scan, ngram_join, quality_model, quality_rules, secrets, textstats
from ridgewatch.llm.common import scratch_dir
from ridgewatch.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# Near duplicates


def components(rows, similarity=80):
    """(key, place) -> (set size, smallest key reachable), by comparing all pairs."""
    sets = []
    for _, text in rows:
        words = (text or "").encode().translate(LOWER).split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None:
                if 100 * both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                    root[find(a)] = find(b)
    least = {}
    for k, (key, _) in enumerate(rows):
        if key is not None:
            least[find(k)] = min(least.get(find(k), key), key)
    return sorted((str(key), len(sets[k]), str(least[find(k)] if key is not None else None)) for k, (key, _) in enumerate(rows))


def near(spark, rows, schema=DOCS):
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, schema).repartition(3)).collect()
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got)


@pytest.mark.parametrize(
    "seed,sizes",
    [(1, (3_000_000, 1_000_000, 4_000_000, 250_000, 50_000)), (2, (400, 200, 150, 90, 50_000)), (3, (150, 90, 40, 60, 4)), (5, (300, 90, 4_000_000, 200, 7))],
)
def test_components_equal_brute_force(spark, monkeypatch, seed, sizes):
    for name, value in zip(("FRAGMENT_TOKENS", "CHUNK_TOKENS", "GROUP_TOKENS", "BLOCK_TOKENS", "MOST_TASKS"), sizes):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(seed)
    rows = []
    for _ in range(9):
        base = [rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(rng.randint(1, 70))]
        for _ in range(rng.randint(1, 14)):
            words = list(base if rng.random() < 0.6 or not rows else (rows[-1][1] or "x").split())
            for _ in range(rng.randint(0, 2)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice("XYZ") + str(rng.randint(0, 9))
            rows.append((len(rows), " ".join(words[: rng.randint(0, len(words))] if rng.random() < 0.2 else words)))
    rng.shuffle(rows)
    assert near(spark, rows) == components(rows)


@pytest.mark.parametrize("tokens", [4_000_000, 150])
def test_link_counts_equal_brute_force(spark, monkeypatch, tokens):
    monkeypatch.setattr(ngram_join, "GROUP_TOKENS", tokens)
    rng, rows = random.Random(4), []
    for _ in range(4):
        base = [f"v{rng.randrange(500)}" for _ in range(60)]
        for _ in range(8):
            at = rng.randrange(len(base))
            rows.append((len(rows), " ".join(base[:at] + ["new"] + base[at + 1 :])))
            base = base if rng.random() < 0.5 else rows[-1][1].split()
    rows += [(100, rows[0][1]), (100, rows[0][1]), (None, rows[0][1]), (101, None)]
    grams = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").split()] for i in range(len(w) - 4)}
    sets = [(k, grams(t)) for k, t in rows]
    alike = lambda a, b: bool(a) and 100 * len(a & b) >= 80 * len(a | b)
    wanted = [(str(k), sum(j is not None and m != n and alike(a, b) for n, (j, b) in enumerate(sets)) if k is not None else 0) for m, (k, a) in enumerate(sets)]
    got = ngram_join.link_counts(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((str(r.doc_id), r.n_links) for r in got) == sorted(wanted)


def test_keys_cost_less_than_n_grams(spark):
    sets = {ngram_join.set_id(g): g for g in (ngram_join.ngrams(f"{' '.join(f'k{k}w{j}' for j in range(300))}".encode()) for k in range(300))}
    copies = ngram_join.repeated_sets(spark.createDataFrame([(bytearray(s),) for s in [*sets, *list(sets)[:40]]], "sid binary"), 340)
    bitmap, grams = np.frombuffer(copies, dtype=np.uint8), sum(map(len, sets.values()))
    own_key = ngram_join._bit(np.frombuffer(b"".join(sets), dtype="<u8").reshape(-1, 2), bitmap)
    assert own_key[:40].all() and own_key[40:].mean() < 0.2
    rows = [r for r in ngram_join._cut_chunk(sets, 300, bitmap) if r[0] < 300]
    assert sum(len(r[4]) for r in rows) == 6 * grams
    assert sum(len(r[1]) + len(r[3]) for r in rows) < 5 * grams
    keys = [ngram_join._unpack([r for r in rows if r[0] == part], 6)[0] for part in {r[0] for r in rows}]
    assert len(np.unique(np.concatenate(keys), axis=0)) == len(sets)


@pytest.mark.parametrize("full", [False, True])
def test_copies_in_many_chunks(spark, monkeypatch, full):
    monkeypatch.setattr(ngram_join, "CHUNK_TOKENS", 150)
    monkeypatch.setattr(ngram_join, "FRAGMENT_TOKENS", 400)
    if full:  # all keys are of ids
        monkeypatch.setattr(ngram_join, "repeated_sets", lambda ids, rows: b"\xff")
    rng, rows = random.Random(6), []
    for k in range(120):
        words = [f"g{k % 40}w{j}" for j in range(640 if k == 5 else 40)]
        if k % 4 == 3:
            words[rng.randrange(40)] = "other"
        rows.append((k, " ".join(words)))
    rng.shuffle(rows)
    assert near(spark, rows) == components(rows)


def test_similarity_bound_is_exact(spark):
    base = [f"w{k}" for k in range(94)]
    rows = [(1, " ".join(base)), (2, " ".join(base[10:])), (3, " ".join(base[19:])), (4, " ".join([*base[18:], "x"]))]
    assert near(spark, rows) == components(rows)


def test_near_duplicate_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (None, "one two"), (6, "one two three"), (4, "one two"), (7, "é ü"), (8, "É ü")]
    assert near(spark, rows) == components(rows)
    assert near(spark, []) == []
    df = spark.createDataFrame([(1, "a b c d e f", "s"), (2, "a b c d e f", "s"), (None, "a b c d e f", "s")], "doc_id bigint, text string, stay string")
    kept = ngram_join.one_of_each(df).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "None"] and kept[0].stay == "s"


def test_more_than_65536_fragments(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FRAGMENT_TOKENS", 1)
    monkeypatch.setattr(ngram_join, "MOST_TASKS", 8)
    rows = [(k, " ".join(f"w{k // 2 * 4000 + j}" for j in range(k % 2, 3500))) for k in range(20)]
    rows += [(100, rows[3][1]), (101, "a few words of its own here")]
    assert near(spark, rows) == components(rows)


def test_chains_within_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP_TOKENS", 500)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 300)
    rng, rows = random.Random(11), []
    words = [f"v{k}" for k in range(80)]
    for k in range(60):
        rows.append((k, " ".join(words)))
        words[rng.randrange(80)] = f"n{k}"
    rng.shuffle(rows)
    assert near(spark, rows) == components(rows)


def test_one_row_of_each_component_stays(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(3, b), (5, a), (5, b), (7, a), (9, c), (9, c), (None, a), (None, a), (4, None), (4, " "), (4, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("mark", F.lit("clash")).withColumn("stay", F.lit(1))
    kept = ngram_join.one_of_each(df.repartition(3))
    wanted = [(3, b), (5, a), (9, c), (None, a), (None, a), (4, None), (4, " "), (4, None)]
    assert kept.columns == df.columns and sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted((str(k), str(t)) for k, t in wanted)


def test_near_duplicates_of_very_long_texts(spark):
    rows = [(1, "a" + " " * 2_000_000 + "b"), (2, "a\n" * 400_000), (3, "A " * 400_000), (4, "x" * 1_000_000), (5, " ".join(f"w{k}" for k in range(100_000))), (6, " ".join(f"w{k}" for k in range(5, 100_000)))]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, DOCS).withColumn("sid", F.lit("clash")).withColumn("key", F.lit(0))).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 2, 3: 2, 4: 4, 5: 5, 6: 5}


def test_a_third_of_all_rows_are_copies(spark):
    rows = [(k, "same text here for all of these rows") for k in range(300)] + [(k, f"own words {k} " * 9) for k in range(300, 500)]
    got = near(spark, rows)
    assert sum(c == "0" for _, _, c in got) == 300


def test_near_duplicate_query(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    got = QUERIES["op3_ngram_join"](spark, SF).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == components(rows)


# Secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secret_spans(text):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_secret_spans(spark):
    rng = random.Random(8)
    parts = ["token: token: abcdefgh", 'Password = "abc', "passwd:abcdef", "api_key==x+/.=-", "APIKEY = 'zzzzzz'", "AKIA" + "A" * 16, "AKIA" + "B" * 15, "AKIAAKIA" + "C" * 12, "0123456789abcdef" * 2, "f" * 23, "é", "😀", "\n", " ", "secret:secret:secret", "x"]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))) for k in range(300)] + [(None, None), (1000, ""), (1001, "y " * 200_000 + "f" * 30)]
    df = spark.createDataFrame(rows, DOCS).withColumn("blob", F.lit("clash")).withColumn("spans", F.lit(1))
    for row in secrets.digests(df).collect():
        text = dict(rows)[row.doc_id] or ""
        base = secret_spans(text)
        assert row.base_sha256 == sha(base) and row.spans == base
        assert (row.n_assign, row.n_access, row.n_hex) == tuple(base.count(f"{k}:") for k in ("assign", "access", "hex"))


def test_ledger_scans_only_what_it_lacks(spark):
    ledger = secrets.Ledger(spark, scratch_dir(spark, "ledger"))
    first = spark.createDataFrame([("a", 1, "token=abcdefg"), ("b", 1, "token=abcdefg"), ("c", 1, None)], "path string, version int, content string")
    found = secrets.scan_history(first, ledger)
    assert {(r.path, len(r.spans)) for r in found.collect()} == {("a", 1), ("b", 1), ("c", 0)}
    assert ledger.scans().count() == 2 * len(secrets.RULES)  # two blobs
    more = first.unionByName(spark.createDataFrame([("a", 2, "f" * 24), ("d", 1, "token=abcdefg")], first.schema))
    assert {(r.path, r.version, len(r.spans)) for r in secrets.scan_history(more, ledger).collect()} == {("a", 1, 1), ("b", 1, 1), ("c", 1, 0), ("a", 2, 1), ("d", 1, 1)}
    assert ledger.scans().groupBy("run").count().count() == 2 and ledger.scans().count() == 3 * len(secrets.RULES)
    newer = (*secrets.RULES[:2], secrets.Rule("hex", "[0-9a-f]{7,}", version=2))
    again = {(r.path, r.version, len(r.spans)) for r in secrets.scan_history(more, ledger, newer).collect()}
    assert ("a", 2, 1) in again and ledger.scans().where("rule = 'hex@2'").count() == 3
    assert ledger.scans().count() == 3 * len(secrets.RULES) + 3


def test_findings_of_a_broken_run_are_ignored(spark):
    ledger = secrets.Ledger(spark, scratch_dir(spark, "ledger"))
    spark.createDataFrame([("x", "hex@1", 0, 5, "broken")], secrets._FINDINGS).write.parquet(ledger.findings_path)
    assert ledger.findings().count() == 0
    secrets.update(spark.createDataFrame([("f" * 24,)], "content string"), ledger)
    assert [r.end for r in ledger.findings().collect()] == [24]


def test_redaction(spark):
    rows = [(1, "a token=abcdef0123456789abcdef01234567 b", 41, "k"), (2, "clean é", 7, None), (None, None, None, "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, new_text string")
    got = {r.doc_id: r for r in secrets.without_secrets(df).collect()}
    assert got[1].text == "a [assign] b" and got[1].n_chars == 12 and got[2].text == "clean é" and got[None].text is None
    assert secrets.without_secrets(df).columns == df.columns and secrets.without_secrets(df.limit(0)).count() == 0


def test_redaction_of_copies_in_shared_buckets(spark, monkeypatch):
    rows = [(k, f"text {k % 9} " + ("f" * 24 if k % 3 else ""), 5) for k in range(60)] + [(7, "text 7 " + "f" * 24, 5)] * 2
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    expected = sorted((k, t.replace("f" * 24, "[hex]"), len(t) - 19 if "f" * 24 in t else n) for k, t, n in rows)
    for buckets in (1, 4, secrets.BUCKETS):
        monkeypatch.setattr(secrets, "BUCKETS", buckets)
        assert sorted(map(tuple, secrets.without_secrets(df).collect())) == expected


def test_secret_query(spark):
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    for row in QUERIES["op1_secret_scan"](spark, SF).collect():
        assert row.base_sha256 == sha(secret_spans(texts[row.doc_id]))


# Decontamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contamination(docs, items):
    windows, sizes = collections.defaultdict(set), set()
    for item, text in items:
        words = WORD.findall((text or "").translate(CAPITALS))
        for i in range(max(1, len(words) - 12) if words and item is not None else 0):
            windows[tuple(words[i : i + 13])].add(item)
            sizes.add(len(words[i : i + 13]))
    out = []
    for doc, text in docs:
        words, hit, met = WORD.findall((text or "").translate(CAPITALS)), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if found := windows.get(tuple(words[i : i + size])):
                    hit |= set(range(i, i + size))
                    met |= found
        listed = sha(",".join(sorted(map(str, met))))
        out.append((str(doc), len(words), len(hit), len(met), listed, bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out)


def report(spark, docs, items):
    index = decontaminate.build_index(spark.createDataFrame(docs, DOCS).withColumn("ref", F.lit("clash")).withColumn("postings", F.lit(1)))
    rows = decontaminate.report(index, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_contamination_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 3 if seed == 2 else 200_000)
    rng = random.Random(seed)
    vocabulary = ["the", "of", "É", "ß", "zürich", *"abcdefgh", *(f"w{k}" for k in range(40))]
    items = [(k, rng.choice([" ", "-", "\n"]).join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 13, 14, 30])))) for k in range(12)]
    items += [(3, items[3][1]), (50, items[4][1]), (None, "w1 w2"), (51, None), (52, "--"), (53, "nowhere " * 3)]
    docs = []
    for k in range(60):
        text = [rng.choice(vocabulary).upper() if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(rng.randint(0, 50))]
        for _ in range(rng.randint(0, 2)):
            words = (rng.choice(items)[1] or "").split()
            start = rng.randint(0, max(0, len(words) - 1))
            text[rng.randint(0, len(text)) :][:0] = []
            text = text[: (at := rng.randint(0, len(text)))] + words[start:] + text[at:]
        docs.append((k, " ".join(text)))
    docs += [(1, docs[1][1]), (None, docs[2][1]), (200, None), (201, ""), (1, "another text with id 1")]
    assert report(spark, docs, items) == contamination(docs, items)


def test_contamination_without_items_or_documents(spark):
    assert report(spark, [(1, "a b"), (2, None)], []) == contamination([(1, "a b"), (2, None)], [])
    assert report(spark, [], [(1, "a b")]) == []


def test_contaminated_documents_go(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    docs = spark.createDataFrame([(1, "x " + passage), (2, "clean words only"), (None, passage), (3, None)], DOCS).withColumn("bad_text", F.lit("c"))
    kept = decontaminate.without_contaminated(docs, spark.createDataFrame([(9, passage)], "item_id bigint, text string"))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "3"] and kept.columns == docs.columns


def test_proximity_matches(spark):
    item = " ".join(f"p{k}" for k in range(40))
    changed = " ".join(f"p{k} zz" if k % 9 == 8 else f"p{k}" for k in range(40))
    docs = spark.createDataFrame([(1, "a b " + changed), (2, "p1 other words")], DOCS)
    index = decontaminate.build_index(docs)
    rows = {r.doc_id: r for r in decontaminate.report(index, spark.createDataFrame([(9, item)], "item_id bigint, text string")).collect()}
    assert rows[1].n_hit == 0 and rows[1].n_near == 1 and rows[2].n_near == 0
    again = decontaminate.report(index, spark.createDataFrame([(8, "other words"), (7, "Other")], "item_id bigint, text string"))
    assert {r.doc_id: (r.n_hit, r.items) for r in again.collect()} == {1: (0, []), 2: (2, ["7", "8"])}


def test_contamination_of_very_long_texts(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    docs = [(1, "a" + " " * 2_000_000 + passage), (2, "b\n" * 300_000), (3, "x" * 1_000_000), (4, "the " * 200_000 + passage + " the" * 100_000), (5, "-" * 1_000_000)]
    items = [(1, passage), (2, "the " * 14), (3, "b")]
    assert report(spark, docs, items) == contamination(docs, items)


def test_proximity_of_short_and_unseen_items(spark, tmp_path):
    items = [(1, "p0 p1 p2 p3 p4 p5 p6 p7 p8 p9"), (2, " ".join(f"absent{k}" if k % 8 == 4 else f"q{k}" for k in range(30)))]
    docs = [(1, "a p0 p1 p2 p3 zz p5 p6 p7 p8 p9 b"), (2, " ".join("zz" if k % 8 == 4 else f"q{k}" for k in range(30))), (3, "p1 alone"), (4, items[0][1])]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r.doc_id: (r.items, r.near_items) for r in QUERIES["op7_proximity"](spark, str(tmp_path)).collect()}
    assert rows == {1: ([], ["1"]), 2: ([], ["2"]), 3: ([], []), 4: (["1"], ["1"])}


def test_contamination_query(spark):
    docs = [(r.doc_id, r.text) for r in documents(spark).collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = QUERIES["op7_decontamination"](spark, SF).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows) == contamination(docs, items)


# Quality rules


def base(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            duplicates += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), duplicates, len(repeated)


def counted(text):
    data = text.encode()
    words = data.split()
    return textstats.base_counts(text, data, words, textstats.word_ids(words))


def test_base_counts():
    rng = random.Random(9)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b", "é", " ", "\n", "\x0b", " ", "#", "<", "a b c d e f g h ", "a b c d e f g h i\n"]) for _ in range(rng.randint(0, 40)))
        assert counted(text) == base(text)


def test_model_is_a_distribution():
    rng = np.random.default_rng(2)
    code = np.unique(rng.integers(0, 5, (400, 3)) @ np.array([4096, 64, 1]))
    counts = rng.integers(1, 20, len(code))
    keys, values = (np.concatenate(x) for x in quality_rules._arrays(0, code, counts))
    order = np.argsort(keys)
    model = quality_rules.Model({"": 0}, keys[order], values[order], frozenset([0]))
    for context in (code[0] // 64, 63 * 64 + 1, 63 * 64 + 63):
        assert np.exp(model._logs(0, context * 64 + np.arange(64))).sum() == pytest.approx(1, abs=0.02)


class Loops:
    """Modified Kneser-Ney in dictionaries."""

    def __init__(self, texts):
        three = collections.Counter(int(c) for t in texts for c in quality_rules.trigram_codes(t))
        self.counts = {3: three}
        self.counts[2] = collections.Counter(c % 4096 for c in three)
        self.counts[1] = collections.Counter(c % 64 for c in self.counts[2])
        self.cut, self.sums, self.kinds = {}, {}, {}
        for order in (2, 3):
            spread = collections.Counter(min(n, 4) if n < 4 else (4 if n == 4 else 5) for n in self.counts[order].values())
            n1, n2, n3, n4 = (spread[k] for k in (1, 2, 3, 4))
            cut = [0, 0.5, 0.75, 0.9]
            if n1 and n2 and n3:
                y = n1 / (n1 + 2 * n2)
                cut = [0] + [min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]
            self.cut[order] = cut
            self.sums[order], self.kinds[order] = collections.Counter(), collections.Counter()
            for code, n in self.counts[order].items():
                self.sums[order][code // 64] += n
                self.kinds[order][code // 64] += cut[min(n, 3)]

    def chance(self, order, code):
        if order == 1:
            seen = self.counts[1][code]
            return 0.999 * seen / sum(self.counts[1].values()) + 0.001 / 64 if seen else 1e-6
        lower, context, n = self.chance(order - 1, code % 64 ** (order - 1)), code // 64, self.counts[order][code]
        if not self.sums[order][context]:
            return lower
        return ((n - self.cut[order][min(n, 3)]) + self.kinds[order][context] * lower) / self.sums[order][context]

    def log_ppl(self, text):
        codes = collections.Counter(int(c) for c in quality_rules.trigram_codes(text))
        return -sum(n * np.log(self.chance(3, c)) for c, n in codes.items()) / len(text)


def band(values, width):
    steps = sorted(int(np.floor(v * 10_000)) for v in values)
    first, third = (steps[-(-k * len(steps) // 4) - 1] / 10_000 for k in (1, 3))
    return first - width * (third - first), third + width * (third - first)


def quality(rows):
    """(doc_id, kept, log_ppl, band) by loops. rows: doc_id, lang, text."""
    sizes = collections.Counter(lang or "" for _, lang, _ in rows)
    own = lambda lang: lang if lang and sizes[lang] >= 20 else ""
    failed = [(n := base(t or ""))[0] < 20 or 100 * n[4] > 30 * n[0] for _, _, t in rows]
    out = []
    for name in {own(lang) for _, lang, _ in rows}:
        mine = [k for k, (_, lang, _) in enumerate(rows) if own(lang) == name]
        train = [rows[k][2] for k in mine if rows[k][2]]
        for width in (quality_rules.TRIM_WIDTH, quality_rules.BAND_WIDTH):
            model = Loops(train) if train else None
            ppl = {k: model.log_ppl(rows[k][2]) for k in mine if rows[k][2] and model}
            good = [ppl[k] for k in ppl if not failed[k]]
            low, high = band(good, width) if len(good) >= 20 else (-np.inf, np.inf)
            train = [rows[k][2] for k in ppl if not failed[k] and low <= ppl[k] <= high]
        out += [(rows[k][0], not failed[k] and (k not in ppl or low <= ppl[k] <= high), ppl.get(k), (low, high)) for k in mine]
    return out


def test_verdicts_equal_loops(spark):
    rows = [(r.doc_id, r.lang, r.text) for r in documents(spark).collect()]
    rng = random.Random(12)
    rows += [(1000 + k, "en", " ".join("".join(rng.choice("qxzjkvw0987~^") for _ in range(6)) for _ in range(40))) for k in range(3)]
    rows += [(2000 + k, "xx", "a rare language of a few documents " * 2 + " ".join(f"w{k}x{j}" for j in range(30))) for k in range(5)]
    rows += [(3000, "en", None), (3001, None, "")]
    got = {r.doc_id: r for r in quality_rules.verdicts(spark.createDataFrame(rows, "doc_id bigint, lang string, text string").repartition(3)).collect()}
    wanted = quality(rows)
    assert len(got) == len(wanted) and not all(got[k].kept or got[k].base_failed for k in got)
    for doc, kept, ppl, (low, high) in wanted:
        assert got[doc].log_ppl == (None if ppl is None else pytest.approx(ppl, abs=1e-4))
        if got[doc].low is not None:
            assert (got[doc].low, got[doc].high) == (pytest.approx(low, abs=2e-3), pytest.approx(high, abs=2e-3))
        if ppl is None or min(abs(ppl - low), abs(ppl - high)) > 3e-3:
            assert got[doc].kept == kept


def test_thirty_languages_in_passes(spark, monkeypatch):
    rng, rows = random.Random(4), []
    for lang in range(30):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyzαβγδεζηθабвгдежз一二三四五六", 12)
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(60)]
        rows += [(lang * 100 + k, f"l{lang}", " ".join(rng.choice(words) for _ in range(60))) for k in range(20 if lang else 19)]
    df = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    found = []
    for size in (64, 7):
        monkeypatch.setattr(quality_rules, "PASS_LANGS", size)
        found.append(sorted((r.doc_id, r.kept, round(r.log_ppl, 5), r.low, r.high) for r in quality_rules.verdicts(df).collect()))
    assert found[0] == found[1] and all((low is None) == (doc < 100) for doc, _, _, low, _ in found[0])
    other = rows[150:160] + [(9000 + k, "l5", t) for k, (_, _, t) in enumerate(rows[400:403])]  # texts of another language
    gone = {r.doc_id for r in quality_rules.verdicts(spark.createDataFrame([*rows, *other[10:]], df.schema)).where("not kept").collect()}
    assert {9000, 9001, 9002} <= gone


def test_quality_query(spark):
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    rows = QUERIES["op8_quality_rules"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, chars, symbols, lines, repeated = base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeated)
        assert r.base_failed == (n < 20 or 100 * repeated > 30 * n)
        inside = r.log_ppl is None or r.low is None or r.low <= r.log_ppl <= r.high
        assert r.kept == (not r.base_failed and inside)


def test_quality_edges(spark):
    good = [(k, " ".join(f"the word{(k * j) % 97} of" for j in range(1, 20)), "en", k) for k in range(60)]
    rows = good + [(100, None, "en", 1), (101, "", None, 1), (None, good[0][1], None, 1), (103, "一鿿あ" * 80 + " x" * 25, "en", 1), (103, good[1][1], "xx", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, log_ppl int").withColumn("kept", F.lit("clash"))
    got = quality_rules.verdicts(df).collect()
    assert len(got) == len(rows) and not [r for r in got if r.doc_id == 100][0].kept
    kept = quality_rules.keep_good(df)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == df.columns and 100 not in ids and 101 not in ids
    assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in got if r.kept) and len(ids) > 50
    assert quality_rules.verdicts(df.limit(0)).count() == 0


def test_perplexity_rejects_noise(spark):
    rng = random.Random(3)
    good = [(k, " ".join(rng.choice(["the", "house", "stands", "on", "a", "hill", "near", "water"]) for _ in range(60)), "en") for k in range(80)]
    noise = (500, " ".join("".join(rng.choice("qxzjkvw0987~^`") for _ in range(6)) for _ in range(60)), "en")
    flat = (501, " ".join("on" + "o" * (k % 3) for k in range(60)), "en")
    got = {r.doc_id: r for r in quality_rules.verdicts(spark.createDataFrame([*good, noise, flat], "doc_id bigint, text string, lang string")).collect()}
    assert not got[500].base_failed and not got[500].kept and got[500].log_ppl > got[500].high
    assert sum(got[k].kept for k in range(80)) == sum(not got[k].base_failed for k in range(80))


def test_bands_reject_bad_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    rows = quality_rules.verdicts(docs).where("not base_failed").join(labels, "doc_id").groupBy("quality").agg(
        F.count("*").alias("n"), F.count_if(~F.col("kept")).alias("gone")
    ).collect()
    share = {r.quality: r.gone / r.n for r in rows}
    assert share[0] > 0.6 and share[1] < 0.03


# Quality classifier


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    forest = quality_model.fit(x, y)
    test = rng.random((1000, 4))
    assert ((forest.scores(test) > 0.5) == ((test[:, 0] > 0.5) ^ (test[:, 1] > 0.3))).mean() > 0.97


def test_one_class_or_no_labels():
    assert quality_model.fit(np.ones((5, 2)), np.ones(5)).scores(np.ones((1, 2)))[0] > 0.99
    assert quality_model.fit(np.zeros((0, 2)), np.zeros(0)).scores(np.ones((2, 2))).tolist() == [0.5, 0.5]


def test_flat_traversal_equals_walking():
    rng = np.random.default_rng(4)
    x = rng.random((500, 3))
    forest = quality_model.fit(x, (x[:, 2] > 0.6).astype(float))
    for row in x[:20]:
        margin = forest.base
        for f, t, leaf in zip(forest.feature, forest.threshold, forest.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            margin += leaf[node - len(f)]
        assert forest.scores(row[None])[0] == pytest.approx(1 / (1 + np.exp(-margin)))


def test_classifier_query(spark):
    rows = QUERIES["op10_quality_classifier"](spark, "/root/testdata/sf0.01").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50 and sum(p == y for p, y in held) / len(held) > 0.95


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None, 9), (None, "", 9), (2, "word " * 50_000, 9), (2, "a", 9)], "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = quality_model.classify(docs, labels).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got) and not [r for r in got if r.doc_id is None][0].held_out
    assert quality_model.classify(docs.limit(0), labels).count() == 0


def test_held_out_labels_are_never_used(spark):
    docs = documents(spark)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(quality_model.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({(r.doc_id, round(r.score, 9)) for r in quality_model.classify(docs, x).collect()} for x in (labels, flipped))
    assert a == b


# Licences


def licences(files):
    """The scan in loops."""
    cited, tags = {}, {}
    for row, (_, _, text) in enumerate(files):
        if text and re.search(license_scan.CUES, text):
            lines = {x for x in text.split("\n") if re.search(license_scan.CUES, x)}
            blocks = {x for x in re.split(license_scan.PARAGRAPHS, text) if "\n" in x and re.search(license_scan.CUES, x)}
            cited[row] = sorted({(x, False) for x in lines | blocks} | {(text, True)})
            tags[row] = m[1] if (m := re.search(license_scan.SPDX, text)) else None
    terms = lambda x: collections.Counter(re.findall("[a-z0-9]+", x.translate(CAPITALS)))
    unique = {}
    for parts in cited.values():
        for passage, _ in parts:
            unique[passage] = unique.get(passage, 0) + 1
    df = collections.Counter()
    for passage, times in unique.items():
        for t in set(terms(passage)):
            df[t] += times
    for _, _, text in license_scan.templates():
        df.update(set(terms(text)))
    total = sum(unique.values()) + len(license_scan.templates())
    vector = lambda x: {t: n * (np.log((1 + total) / (1 + df[t])) + 1) for t, n in terms(x).items()}

    def cosine(a, b):
        norm = np.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
        return sum(v * b.get(t, 0) for t, v in a.items()) / norm if norm else 0

    fixed = [(name, vector(x)) for name, _, x in license_scan.templates()]
    best = {p: min((-round(cosine(vector(p), v), 6), name) for name, v in fixed) for p in unique}
    own, ruled = {}, {}
    for row, parts in cited.items():
        found = [(*best[p], whole) for p, whole in parts if -best[p][0] >= license_scan.THRESHOLD]
        only = any(whole for *_, whole in found)
        if tags[row]:
            own[row] = ((-1.0, tags[row]), only)
        elif found:
            own[row] = (min(f[:2] for f in found), only)
    for row, (_, path, _) in enumerate(files):
        if row in own and path is not None and (own[row][1] or re.search(license_scan.NAMES, path.rsplit("/")[-1])):
            place = path.rsplit("/", 1)[0] if "/" in path else ""
            ruled[place] = min(ruled.get(place, own[row][0]), own[row][0])
    out = []
    for row, (key, path, _) in enumerate(files):
        mine = own[row][0][1] if row in own else None
        parts = path.split("/")[:-1] if path is not None else None
        above = next(("/".join(parts[:k]) for k in range(len(parts), -1, -1) if "/".join(parts[:k]) in ruled), None) if parts is not None else None
        takes = mine is None and above is not None
        out.append((str(key), mine, mine or (ruled[above][1] if above is not None else None), above if takes else None))
    return sorted(out, key=repr)


def notice(name, number=0):
    return license_scan.NOTICES[name][number]


def full(name):
    return [text for other, _, text in license_scan.templates() if other == name][-1]


FILES = "key bigint, path string, text string"


def test_licences_equal_loops(spark):
    mit, gpl = notice("MIT"), notice("GPL-3.0")
    header = "\n".join(f"# {license_scan.HEADERS['GPL-2.0'][k : k + 70]}" for k in range(0, len(license_scan.HEADERS["GPL-2.0"]), 70))
    files = [
        (1, "a/LICENSE", mit), (2, "a/b/c/x.py", "code\nmore"), (3, "a/b/y.py", "code\nmore\nThis work is licensed under the GNU General Public License version 3\nx"),
        (4, "z/x.py", "code"), (5, None, "code"), (6, "a/b/NOTICE", None), (None, "a/q.py", "code"), (7, "x.py", "Copyright 2020 nobody at all\nline\nline"),
        (8, "a/b/COPYING", gpl), (9, "a/b/COPYING2", mit), (2, "a/b/c/x.py", "code\nmore"), (10, "m/LICENSE", "Licensed under\nsomething"), (11, "n", ""),
        (12, "h/x.c", header + "\n\nint main;\nreturn 0;"), (13, "t/x.c", "// SPDX-License-Identifier: LGPL-2.1-or-later\nx"), (14, "t/LICENSE", "SPDX-License-Identifier: MIT OR Apache-2.0"),
        (15, "t/u/v.c", "v"), (1, "r/x", mit), (1, "r/x", "code"), (16, "w/COPYING", full("MIT").replace("<year>", "2019").replace("<copyright holders>", "Some One")), (17, "w/q", "q"), (None, "s/LICENSE", gpl), (18, "s/b", "b"),
    ]
    df = spark.createDataFrame(files, FILES).withColumn("license", F.lit("clash")).withColumn("mark", F.lit(1))
    got = sorted(((str(r.key), r.own_license, r.license, r.inherited_from) for r in license_scan.scan(df.repartition(3)).collect()), key=repr)
    assert got == licences(files)
    assert license_scan.scan(df.limit(0)).count() == 0


def test_known_licences_are_found(spark):
    wanted = {
        "SPDX-License-Identifier: Apache-2.0": "Apache-2.0", "x = 1\n# SPDX-License-Identifier: LGPL-2.1-or-later\n": "LGPL-2.1-or-later",
        "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n": "LGPL-2.1",
        "BSD 2-Clause License": "BSD-2-Clause", "ISC License": "ISC", "some code\n\n# Released under the MIT License.\n": "MIT",
    }
    for name in license_scan.NOTICES:
        wanted[notice(name)] = name
        if any(other == name for other, *_ in license_scan.templates()[2 * len(license_scan.NOTICES) :]):
            text = full(name).replace("<year>", "2021").replace("<copyright holders>", "A. Nyone").replace("<owner>", "A. Nyone")
            wanted["\n".join(f" * {line}" for line in text.split("\n")) + " "] = name
    for name, header in license_scan.HEADERS.items():
        wanted["/* " + header.replace(", ", ",\n * ") + " */\n\nint x;\n" * 40] = name
    rows = [(k, f"d{k}/f.c", text) for k, text in enumerate(wanted)]
    got = {r.key: r.own_license for r in license_scan.scan(spark.createDataFrame(rows, FILES)).collect()}
    assert [got[k] for k, _, _ in rows] == list(wanted.values())


def test_licences_of_deep_paths_and_long_texts(spark):
    mit, gpl = notice("MIT"), notice("GPL-3.0")
    deep = "/".join(f"d{k}" for k in range(40))
    rows = [(1, "LICENSE", gpl), (2, f"{deep}/LICENSE", mit), (3, f"{deep}/x/code.py", "x = 1"), (4, "q/a.txt", "a" + " " * 2_000_000 + "license"), (5, "q/b.txt", "word " * 300_000 + "\n" + mit)]
    got = {r.key: (r.license, r.inherited_from) for r in license_scan.scan(spark.createDataFrame(rows, FILES)).collect()}
    assert got[3] == ("MIT", deep) and got[4] == ("GPL-3.0", "") and got[5] == ("MIT", None)


def test_licence_query(spark):
    files = [tuple(r) for r in license_scan.document_paths(documents(spark)).select("doc_id", "path", "text").collect()]
    got = QUERIES["op9_license_scan"](spark, SF).collect()
    assert sorted(((str(r.doc_id), r.own_license, r.license, r.inherited_from) for r in got), key=repr) == licences(files)
