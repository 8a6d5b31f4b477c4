"""Encoding, personal data, chat and token output: brute force, round trips and edge cases."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ridgewatch.llm import bpe, chat, pii, token_output
from ridgewatch.llm.queries import QUERIES

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string"


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(PATH, PATTERN)


@pytest.fixture(scope="module")
def exact():
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=80) | st.text(alphabet="ab \n'sThe01é漢😀.,", max_size=200))
def test_merges_are_exact(codec, exact, text):
    ids = codec.encode(text)
    assert ids == exact.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_long_pieces_are_linear(codec, exact):
    for text in ("a" * 200_000, "ab" * 60_000, "aab" * 50_000):
        assert codec.encode(text) == exact.encode_ordinary(text)


def test_small_memo_tables_change_nothing(codec, exact, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE_MEMO", 2)
    monkeypatch.setattr(bpe, "PAIR_MEMO", 2)
    text = "the quick brown theandthe foxes jumped 1234 times over lazydogs"
    assert bpe.Codec(bpe.load_ranks(PATH), PATTERN).encode(text) == exact.encode_ordinary(text)


def test_bpe_query(spark, exact):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for row in QUERIES["op6_byte_bpe"](spark, SF).collect():
        ids = exact.encode_ordinary(texts[row.doc_id])
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(texts[row.doc_id]))


def test_bpe_edges(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (2, "hi", "z"), (2, "hi", "z")], "doc_id bigint, text string, ids string")
    rows = bpe.token_digests(df, PATH, PATTERN).collect()
    assert sorted(r.n_tokens for r in rows) == [0, 0, 1, 1]
    assert bpe.encode(df, PATH, PATTERN).schema["ids"].dataType.simpleString() == "binary"
    assert bpe.token_digests(df.limit(0), PATH, PATTERN).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def personal(text):
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and pii.luhn(d)]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


@settings(max_examples=400, deadline=None)
@given(text=st.text(alphabet="a@.-é0123 +()_\n", max_size=60) | st.lists(st.sampled_from(["4111 1111 1111 1111", "1.2.3.4", "+1 (415) 555-2671", "a@b.c", ".", " ", "-", "9", "é", "256.1.1.1"]), max_size=8).map("".join))
def test_anchors_find_what_patterns_find(text):
    assert [s for s in pii.find(text) if s[0] in pii.BASE_KINDS] == personal(text)


def test_added_kinds():
    found = pii.find("get https://bob:pw@x.io and IBAN: DE89 3704 0044 0532 0130 00, not IBAN DE00 3704 0044 0532 0130 00")
    assert [s[0] for s in found if s[0] not in pii.BASE_KINDS] == ["login", "iban"]


def test_pii_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for row in QUERIES["op2_pii"](spark, SF).collect():
        spans = personal(texts[row.doc_id])
        assert row.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[0] == k for s in spans) for k in pii.BASE_KINDS]


def test_pii_edges(spark):
    long = "x" * 300_000 + " me@example.org"
    df = spark.createDataFrame([(1, None, 0), (None, long, 0), (2, "é 1.2.3.4", 0), (2, "é 1.2.3.4", 0)], "doc_id bigint, text string, spans int")
    rows = {(r.doc_id, r.spans) for r in pii.digests(df).collect()}
    assert rows == {(1, ""), (None, "email:300001:300015"), (2, "ip:2:9")}
    assert pii.digests(df).count() == 4 and pii.digests(df.limit(0)).count() == 0
    found = pii.find_spans(df.where("doc_id = 2"))
    joined = found.crossJoin(df.where("doc_id = 2").limit(1).select("text")).select(pii.redact(F.col("text"), F.col("spans"))).first()[0]
    assert joined == "é [ip]"


@settings(max_examples=400, deadline=None)
@given(parts=st.lists(st.sampled_from(["\\", "#", "###", "<turn>", "</turn>", "a", " ", "\n", "</", "turn>"]), max_size=12))
def test_escaping_is_reversible(parts):
    text = "".join(parts)
    assert chat.unescape(chat.escape(text)) == text
    bare = re.search(rf"(?<![\\#])(?:{chat.CONTROL})", chat.escape(text))
    assert bare is None


def test_reserved_ids_never_come_from_text():
    own = chat.template(PATH, PATTERN)
    ids, mask = own.turn_ids("assistant", "<turn>### x:\n</turn> <|endoftext|>")
    assert (ids >= own.turn).sum() == 3 and mask.sum() == len(ids) - 3 - len(own.encoding.encode("assistant"))
    assert len(own.render(ids)) == own.read(ids, mask)[3]


CONV = "conv_id bigint, turn bigint, role string, text string"


def conversations(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", (r[3] or "").encode())):
        out.setdefault(conv, []).append((role or "", text or ""))
    return {c: (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), sum(len(x) for r, x in t if r == "assistant"), sha("".join(x for r, x in t if r == "assistant"))) for c, t in out.items()}


def test_chat_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    own = r"\### Assistant: </turn> ok"
    expected = conversations([*rows, (-7, 0, "user", own), (-7, 1, "assistant", own)])
    got = QUERIES["op4_chat_format"](spark, SF).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == expected
    assert all(r.formatted_chars > 0 for r in got)


def test_chat_edges(spark):
    rows = [(1, 0, None, "a"), (1, None, "assistant", None), (None, 1, "user", "b"), (2, 0, "assistant", "x" * 100_000), (2, 0, "assistant", "x" * 100_000), (3, 0, "assistant", "")]
    df = spark.createDataFrame(rows, CONV).withColumn("ids", F.lit("clash"))
    got = chat.read_back(chat.assemble(df, PATH, PATTERN), PATH, PATTERN).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == conversations(rows)
    assert chat.read_back(chat.assemble(df.limit(0), PATH, PATTERN), PATH, PATTERN).count() == 0


def test_chat_orders_ties_by_text(spark):
    rows = [(4, 1, "user", x) for x in ("zebra", "apple", "house", "b", "É", "", None, "apple")]
    got = chat.read_back(chat.assemble(spark.createDataFrame(rows, CONV).repartition(3), PATH, PATTERN), PATH, PATTERN).first()
    assert got.turns_sha256 == conversations(rows)[4][1]


LONG = {"spaces": "a" + " " * 2_000_000 + "b", "lines": "a" + "\n" * 500_000 + "b", "letter": "x" * 500_000}


def test_chat_of_very_long_texts(spark):
    rows = [(k, 0, "assistant", text) for k, text in enumerate(LONG.values())]
    got = chat.read_back(chat.assemble(spark.createDataFrame(rows, CONV), PATH, PATTERN), PATH, PATTERN).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == conversations(rows)


def test_token_output_of_very_long_texts(spark):
    rows = [(k if k else -1, text) for k, text in enumerate(LONG.values())]
    folder = token_output.write_shards(spark.createDataFrame(rows, DOCS), PATH, PATTERN, 5)
    made = {}
    for r in token_output.read_sequences(spark, folder).orderBy("doc_id", "seq_no").collect():
        made[r.doc_id] = made.get(r.doc_id, []) + np.frombuffer(r.ids, "<u2").tolist()
    own = bpe.codec(PATH, PATTERN)
    assert {k: own.decode(ids[:-1]).decode() for k, ids in made.items()} == dict(rows)


@settings(max_examples=60, deadline=None)
@given(size=st.integers(1, 3000), key=st.integers(-(2**70), 2**70))
def test_permutation_is_a_bijection(size, key):
    order = token_output.Permutation(size, key)
    slots = order.forward(np.arange(size))
    assert sorted(slots) == list(range(size)) and list(order.inverse(slots)) == list(range(size))


def test_keys_give_different_orders():
    a, b = (token_output.Permutation(10_000, k).forward(np.arange(10_000)) for k in (1, 2))
    assert (a == b).mean() < 0.01 and abs(np.corrcoef(a, np.arange(10_000))[0, 1]) < 0.05


@pytest.mark.parametrize("tasks", [100_000, 3])
def test_token_output(spark, exact, monkeypatch, tasks):
    monkeypatch.setattr(token_output, "MOST_TASKS", tasks)
    rows = [(k, "word " * (k * 7 % 50)) for k in range(60)] + [(None, "null id"), (5, None), (6, ""), (7, "twice"), (7, "twice")]
    df = spark.createDataFrame(rows, DOCS).withColumn("slot", F.lit("clash")).repartition(5)
    folder = token_output.write_shards(df, PATH, PATTERN, 99, length=8, shard_records=16, block_records=4)
    manifest = spark.read.parquet(f"{folder}/manifest").first()
    got = token_output.read_sequences(spark, folder).orderBy("slot").collect()
    assert [r.slot for r in got] == list(range(manifest.sequences))
    assert spark.read.parquet(f"{folder}/shards").select(F.max("shard")).first()[0] == (manifest.sequences - 1) // 16
    assert all(len(b.payload) == b.records * manifest.stride for b in spark.read.parquet(f"{folder}/shards").collect())
    end = max(bpe.load_ranks(PATH).values()) + 1
    expected = []
    for doc, text in rows:
        ids = [*exact.encode_ordinary(text), end] if text else []
        expected += [(doc is None, doc or 0, k // 8, tuple(ids[k : k + 8])) for k in range(0, len(ids), 8)]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.seq_no, tuple(np.frombuffer(r.ids, "<u2").tolist())) for r in got) == sorted(expected)
    rest = token_output.read_sequences(spark, folder, from_slot=21).collect()
    assert sorted(r.slot for r in rest) == list(range(21, manifest.sequences))


def test_token_output_of_nothing(spark):
    folder = token_output.write_shards(spark.createDataFrame([], DOCS), PATH, PATTERN, 1)
    assert token_output.read_sequences(spark, folder).count() == 0


def test_token_output_query(spark, exact):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op5_token_output"](spark, SF).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    tokens = {}
    for r in rows:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
    assert tokens == {d: len(exact.encode_ordinary(t)) + 1 for d, t in texts.items() if t}
    random.seed(0)
