"""Byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1 characters so that one pyahocorasick automaton finds, in a single pass over a piece,
the longest vocabulary entry at every position. The encoder then walks left to right with those longest entries and
backtracks to shorter ones until each token is compatible with the one before it. Two adjacent tokens are compatible
when merging by rank would never have crossed the border between them; that verdict depends on the two ids alone, so
it is memoised. Each position is left at most once as a dead end, hence the time is linear in the piece.

The result equals merging by lowest rank (what tiktoken's encode_ordinary does). Pieces are the matches of the
split pattern; a piece that is itself an entry becomes that entry.

Defined results: null text is empty text and has no tokens; repeated rows are encoded each; other columns are kept.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgewatch.llm.common import map_batches, store

#: Bounds of a worker's memo tables; a full table starts anew, results don't depend on them.
PIECE_MEMO, PAIR_MEMO = 400_000, 600_000
#: Longer pieces aren't memoised, so that the table's bytes are bounded too.
PIECE_MEMO_BYTES = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """An encoder and decoder for one rank table and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.shorter = {rank: self._shorter(token) for token, rank in ranks.items()}
        self.pairs: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        for rank in sorted(self.tokens):
            self.halves[rank] = self._halves(rank)
        self.compatible.clear()
        self.pieces: dict[str, tuple[int, ...]] = {}

    def _shorter(self, token: bytes) -> int:
        """The longest entry that is a proper prefix of token, or -1."""
        for size in range(len(token) - 1, 0, -1):
            if (rank := self.ranks.get(token[:size])) is not None:
                return rank
        return -1

    def _halves(self, rank: int) -> tuple[int, int]:
        """The two entries whose merge makes this one; the entry itself twice if none does."""
        token, left = self.tokens[rank], self.shorter[rank]
        while left >= 0:
            right = self.ranks.get(token[self.sizes[left] :])
            if right is not None and left < rank and right < rank and self._fits(left, right):
                self.pairs[left, right] = rank
                return left, right
            left = self.shorter[left]
        return rank, rank

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves the border between left and right as it is: the pair test of public BPE work.

        Undo the merges on both sides, latest first: if the two tokens that then touch could merge before the merge
        that was undone, the border would have been crossed.
        """
        before = 1 << 62
        while True:
            merged = self.pairs.get((left, right))
            if merged is not None and merged < before:
                return False
            inner_left, inner_right = self.halves.get(left, (left, left))[1], self.halves.get(right, (right, right))[0]
            if left > right and inner_left != left or inner_right == right:
                if inner_left == left:
                    return True
                before, left = left, inner_left
            else:
                before, right = right + 1, inner_right

    def fits(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) >= PAIR_MEMO:
                self.compatible.clear()
            known = self.compatible[key] = self._fits(left, right)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """The tokens of one piece."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        end_of = len(piece)
        longest: list[int] = [-1] * end_of
        for end, (rank, size) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - size + 1] = rank  # ends ascend, so the last one seen at a start is the longest
        dead = bytearray(end_of + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < end_of:
            while token >= 0:
                end = at + self.sizes[token]
                if not dead[end] and (not out or self.fits(out[-1], token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < end_of else -1
            elif out:
                dead[at] = 1
                token = out.pop()
                at -= self.sizes[token]
            else:
                raise ValueError("the vocabulary doesn't cover this piece")
        return out

    def encode(self, text: str) -> list[int]:
        """The tokens of a text; no string in it is special."""
        out: list[int] = []
        pieces = self.pieces
        for piece in self.split.findall(text):
            ids = pieces.get(piece)
            if ids is None:
                ids = tuple(self.encode_piece(piece.encode()))
                if len(piece) <= PIECE_MEMO_BYTES:
                    if len(pieces) >= PIECE_MEMO:
                        pieces.clear()
                    pieces[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.tokens[i] for i in ids])


@lru_cache(maxsize=4)
def vocabulary(path: str) -> dict[int, bytes]:
    """The bytes of each id: all that decoding needs."""
    return {rank: token for token, rank in load_ranks(path).items()}


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    """A worker's codec of a rank file, built once per process."""
    return Codec(load_ranks(path), pattern)


class Encoder:
    """The encoder of operators that only need ids: tiktoken's, with the codec for texts that its split gives up on.

    Its split of a run of some hundred thousand spaces overflows a stack: an error, or in some calls a panic.
    """

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken  # only here: workers of the codec needn't hold it

        self.path, self.pattern, ranks = path, pattern, load_ranks(path)
        self.fast = tiktoken.Encoding("ridgewatch", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        #: The first id above the vocabulary.
        self.free = max(ranks.values()) + 1

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        except BaseException as error:  # a panic isn't an Exception
            if not isinstance(error, ValueError) and type(error).__name__ != "PanicException":
                raise
            return np.array(codec(self.path, self.pattern).encode(text), dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        return self.fast.decode(ids.tolist())


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.array(ids, dtype="<u4").tobytes()


def unpack(data: bytes) -> list[int]:
    return np.frombuffer(data, dtype="<u4").tolist()


def _adding(df: DataFrame, source: str, makers: dict[str, Callable[[list], list]]) -> DataFrame:
    """df with binary columns made from source, in place of columns of their names; each maker gets the last one's."""
    df = df.drop(*makers)
    schema = T.StructType([*df.schema.fields, *(T.StructField(name, T.BinaryType()) for name in makers)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, columns = batch.column(batch.schema.get_field_index(source)).to_pylist(), []
        for make in makers.values():
            values = make(values)
            columns.append(pa.array(values, pa.binary()))
        return pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *makers])

    return map_batches(df, run, schema)


def _encoder(path: str, pattern: str) -> Callable[[list], list]:
    return lambda texts: [pack(codec(path, pattern).encode(t or "")) for t in texts]


def _decoder(path: str) -> Callable[[list], list]:
    def decode_all(packed: list) -> list:
        tokens = vocabulary(path)
        return [b"".join([tokens[i] for i in unpack(ids or b"")]) for ids in packed]

    return decode_all


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the token ids of a text column, packed as little-endian unsigned 32-bit integers."""
    return _adding(df, text, {ids: _encoder(path, pattern)})


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that packed ids stand for; null ids are no ids."""
    return _adding(df, ids, {out: _decoder(path)})


def round_trip(
    df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", out: str = "decoded"
) -> DataFrame:
    """encode() and decode() of its ids in one pass, by one worker a task."""
    return _adding(df, text, {ids: _encoder(path, pattern), out: _decoder(path)})


def token_digests(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: n_tokens, the digest of its ids and that of the bytes decoded from them."""
    coded = round_trip(documents.select("doc_id", "text"), path, pattern)
    digests = coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
    return store(digests, "token-digests")
