"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, a plus before a digit, digit-dot-digit, adjacent digits
(also over one space or hyphen), "://" and identifier cues. From each anchor a deterministic local parser expands to
the left and right as far as its grammar allows and validates what it has found. Nothing is scanned twice: a parser
never goes left of the end of its kind's last match.

Base kinds, leftmost and non-overlapping per kind: email, ip, card, phone. The method adds two kinds:
login (user and password in front of a host in a URL) and iban (an account number after its cue, checked mod 97).

Defined results: null text is empty text; repeated rows are searched each; spans are code points, end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgewatch.llm.common import map_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "login", "iban")
IBAN_CUES = ("IBAN", "iban", "Iban")

DIGITS = frozenset("0123456789")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
CAPITALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOCAL = DIGITS | LETTERS | frozenset("._%+-")
LABEL = DIGITS | LETTERS | {"-"}
PHONE = DIGITS | frozenset(" ().-")
USERINFO = DIGITS | LETTERS | frozenset("-._~!$&'()*+,;=:%")

Span = tuple[str, int, int]


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    """The automaton; each word carries its kind and its length less one."""
    out = ahocorasick.Automaton()
    digits = sorted(DIGITS)
    words = {"@": "email", "://": "login"} | dict.fromkeys(IBAN_CUES, "iban") | {f"+{d}": "phone" for d in digits}
    words |= {f"{a}.{b}": "ip" for a, b in product(digits, digits)}
    words |= {f"{a}{sep}{b}": "card" for sep in ("", " ", "-") for a, b in product(digits, digits)}
    for word, kind in words.items():
        out.add_word(word, (kind, len(word) - 1))
    out.make_automaton()
    return out


def _run(text: str, at: int, allowed: frozenset[str]) -> int:
    """The end of the run of allowed characters from at."""
    end = len(text)
    while at < end and text[at] in allowed:
        at += 1
    return at


def _back(text: str, at: int, least: int, allowed: frozenset[str]) -> int:
    """The start of the run of allowed characters that ends before at, not left of least."""
    while at > least and text[at - 1] in allowed:
        at -= 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _octet(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) < 4 and int(short or "0") <= 255


# A parser gets the text, an anchor and the end of its kind's last match. It returns the match's bounds or None, the
# place where the next search of the kind may begin, and whether the match is valid.


def _email(text: str, at: int, least: int) -> tuple[int, int, bool] | None:
    start = _back(text, at, least, LOCAL)
    end = _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    labels = 1
    while text[end : end + 1] == "." and (further := _run(text, end + 1, LABEL)) > end + 1:
        end, labels = further, labels + 1
    return (start, end, True) if labels > 1 else None


def _ip(text: str, at: int, least: int) -> tuple[int, int, bool] | None:
    start = _back(text, at, least, DIGITS)
    end = _run(text, start, DIGITS)
    parts = [text[start:end]]
    while len(parts) < 4 and text[end : end + 1] == "." and (further := _run(text, end + 1, DIGITS)) > end + 1:
        parts.append(text[end + 1 : further])
        end = further
    return (start, end, all(map(_octet, parts))) if len(parts) == 4 else None


def _card(text: str, at: int, least: int) -> tuple[int, int, bool] | None:
    end, digits, last = at + 1, [text[at]], len(text)
    while end < last:
        step = end + (text[end] in " -")
        if step >= last or text[step] not in DIGITS:
            break
        digits.append(text[step])
        end = step + 1
    return at, end, 16 <= len(digits) <= 19 and luhn("".join(digits))


def _phone(text: str, at: int, least: int) -> tuple[int, int, bool] | None:
    end = _run(text, at + 2, PHONE)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end < at + 4:
        return None
    return at, end, 8 <= sum(c in DIGITS for c in text[at:end]) <= 15


def _login(text: str, at: int, least: int) -> tuple[int, int, bool] | None:
    end = _run(text, at + 3, USERINFO)
    if end == at + 3 or text[end : end + 1] != "@":
        return None
    return at + 3, end, ":" in text[at + 3 : end]


def _iban(text: str, at: int, least: int) -> tuple[int, int, bool] | None:
    start = at + 4
    while text[start : start + 1] in (" ", ":") and text[start : start + 1]:
        start += 1
    end, letters = start, []
    while len(letters) < 34 and end < len(text):
        step = end + (text[end] == " " and end > start)
        if step >= len(text) or text[step] not in DIGITS and text[step] not in CAPITALS:
            break
        letters.append(text[step])
        end = step + 1
    code = "".join(letters)
    if len(code) < 15 or not code[:2].isalpha() or not code[2:4].isdigit():
        return None
    return start, end, int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


PARSERS = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "login": _login, "iban": _iban}


def find(text: str) -> list[Span]:
    """All spans of a text, by kind and start."""
    ends = dict.fromkeys(KINDS, 0)
    found: dict[str, list[Span]] = {}
    for last, (kind, back) in anchors().iter(text):
        at = last - back
        if at < ends[kind]:
            continue
        if (got := PARSERS[kind](text, at, ends[kind])) is not None:
            start, ends[kind], valid = got
            if valid:
                found.setdefault(kind, []).append((kind, start, ends[kind]))
    return [span for kind in KINDS for span in found.get(kind, ())]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def find_spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key and spans, an array of kind, start and end ordered by kind and start."""
    own = df.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [
            [{"kind": k, "start": s, "end": e} for k, s, e in find(t or "")] for t in batch.column(1).to_pylist()
        ]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(SPAN))], ["key", "spans"])

    kind = own.schema["key"].dataType.simpleString()
    out = map_batches(own, run, f"key {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")
    return out.withColumnRenamed("key", key)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; a span inside an earlier one is dropped with it."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = F.struct(
            s["end"].alias("at"),
            F.concat(
                acc["out"],
                F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
                F.concat(F.lit("["), s["kind"], F.lit("]")),
            ).alias("out"),
        )
        return F.when(s["start"] >= acc["at"], new).otherwise(acc)

    return F.aggregate(
        ordered, state, step, lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int")))
    )


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def digests(documents: DataFrame) -> DataFrame:
    """Per document: the counts of the base kinds, the digest of the base spans, and all spans as text."""
    found = find_spans(documents)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    count = [F.array_size(F.filter("spans", _is(kind))).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select(
        "doc_id", *count, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
