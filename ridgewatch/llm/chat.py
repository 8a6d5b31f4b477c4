"""Chat formatting by token-level assembly.

Each turn's segments (role, text) are encoded separately and spliced between reserved ids that lie above the
vocabulary, so no text can ever produce one. The loss mask of a turn is the prefix sum of +1 where an assistant's text
begins and -1 where it ends. In the rendered form a turn reads

    <turn>### role:
    text
    </turn>

and control strings that occur in a text get one more backslash than they had in front, which reading back removes.

Encoding runs row by row before the only shuffle, so one hot conversation costs its task no more than passing over
its rows in order; conversations are streamed, never held whole. Texts travel beside their ids, for rows of equal turn
and role are ordered by text.

Defined results: null text and null role are empty; rows are ordered by turn (null first), then role and text, so
ties and repeated rows have one order; a null conv_id is a conversation of its own; an empty table has no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgewatch.llm.bpe import Encoder
from ridgewatch.llm.common import map_batches

#: Control strings of the rendered form.
CONTROL = r"<turn>|</turn>|###"
_ESCAPE, _UNESCAPE = re.compile(rf"(\\*)({CONTROL})"), re.compile(rf"\\(\\*)({CONTROL})")
#: How the reserved ids TURN, SEP and END are rendered.
RENDERED = ("<turn>### ", ":\n", "\n</turn>\n")
ASSISTANT = "assistant"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


class Template:
    """Encodes and reads turns with one rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        self.encoding = Encoder(path, pattern)
        self.turn = self.encoding.free
        self.sep, self.end = self.turn + 1, self.turn + 2
        #: How ids are stored.
        self.kind = "<u2" if self.end < 1 << 16 else "<u4"

    def turn_ids(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """A turn's ids and its loss mask."""
        head, body = (self.encoding.encode(escape(x)) for x in (role, text))
        ids = np.concatenate([[self.turn], head, [self.sep], body, [self.end]]).astype(self.kind)
        steps = np.zeros(len(ids) + 1, dtype=np.int8)
        if role == ASSISTANT:
            steps[len(head) + 2] += 1
            steps[len(ids) - 1] -= 1
        return ids, np.cumsum(steps[:-1], dtype=np.int8)

    def read(self, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, str, int]:
        """Role, text, text under the mask, and code points of the rendered form of one turn, all from its ids."""
        sep, end = int(np.argmax(ids == self.sep)), len(ids) - 1
        if ids[0] != self.turn or ids[sep] != self.sep or ids[end] != self.end:
            raise ValueError("not a turn")
        role, text = (self.encoding.decode(ids[a:b]) for a, b in ((1, sep), (sep + 1, end)))
        under = self.encoding.decode(ids[mask == 1])
        return unescape(role), unescape(text), unescape(under), len(role) + len(text) + sum(map(len, RENDERED))

    def render(self, ids: np.ndarray) -> str:
        """The rendered form of any assembled ids."""
        out, marks, begin = [], {self.turn: 0, self.sep: 1, self.end: 2}, 0
        for at in np.nonzero(ids >= self.turn)[0]:
            out += [self.encoding.decode(ids[begin:at]), RENDERED[marks[int(ids[at])]]]
            begin = at + 1
        return "".join(out) + self.encoding.decode(ids[begin:])


@lru_cache(maxsize=2)
def template(path: str, pattern: str) -> Template:
    return Template(path, pattern)


def format_turns(conversations: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per turn: conv_id, turn, role, text, ids (little-endian, of 2 bytes where they fit, else 4) and mask (a byte an id)."""
    rows = conversations.select(
        "conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = template(path, pattern)
        made = [own.turn_ids(r, t) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        ids, mask = (pa.array([m[k].tobytes() for m in made], pa.binary()) for k in (0, 1))
        return pa.RecordBatch.from_arrays([*batch.columns, ids, mask], [*batch.schema.names, "ids", "mask"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return map_batches(
        rows, run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, ids binary, mask binary"
    )


def assemble(conversations: DataFrame, path: str, pattern: str) -> DataFrame:
    """The turns of each conversation next to each other and in order; reading them in a row gives its sequence."""
    turns = format_turns(conversations, path, pattern)
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("text")


def read_back(assembled: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per conversation of assemble(): counts and digests of what its ids and mask say."""
    kind = assembled.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, open_row, turns, loss = template(path, pattern), None, None, None

        def closed(row: list) -> tuple:
            return (row[0], row[1], turns.hexdigest(), row[2], loss.hexdigest(), row[3], row[4])

        for batch in batches:
            done = []
            key_type = batch.schema.field("conv_id").type
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "ids", "mask")]
            for conv, ids, mask in zip(*columns):
                if open_row is None or open_row[0] != conv:
                    if open_row is not None:
                        done.append(closed(open_row))
                    open_row, turns, loss = [conv, 0, 0, 0, 0], hashlib.sha256(), hashlib.sha256()
                ids = np.frombuffer(ids, dtype=own.kind)
                role, text, under, chars = own.read(ids, np.frombuffer(mask, dtype=np.int8))
                turns.update(f"{role}\n{text}\n".encode())
                loss.update(under.encode())
                for place, more in ((1, 1), (2, len(under)), (3, chars), (4, len(ids))):
                    open_row[place] += more
            yield _rows(done, names, key_type)
        if open_row is not None:
            yield _rows([closed(open_row)], names, key_type)

    return assembled.select("conv_id", "ids", "mask").mapInArrow(
        run,
        f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint, n_tokens bigint",
    )


def _rows(rows: list[tuple], names: list[str], key: pa.DataType) -> pa.RecordBatch:
    kinds = [key, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
