"""Statistics of one whole text, shared by the quality rules and the quality classifier."""

from __future__ import annotations

import numpy as np

from ridgewatch.llm.common import WORD_SPACES

SYMBOLS = b"#*$%&|<>"
UPPER, DIGIT, STOPS, SHOUT = (bytes(range(65, 91)), bytes(range(48, 58)), b".,;:?", b"!")
#: Words of a window that counts as repeated when the text has it twice.
WINDOW = 8
_MIX = np.uint64(0x9E3779B97F4A7C15)


def count_bytes(data: bytes, members: bytes) -> int:
    return len(data) - len(data.translate(None, members))


def word_ids(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words; they hold within this process only."""
    return np.array([hash(w) for w in words], dtype=np.int64).view(np.uint64)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of the text found twice or more, the first one included."""
    if len(ids) <= window:
        return 0
    rolled, width = ids * _MIX ^ ids >> np.uint64(29), 1
    while width < window:  # doubling: the code of 2k words from two codes of k words
        rolled = rolled[:-width] * _MIX + (rolled[width:] ^ rolled[width:] >> np.uint64(31))
        width *= 2
    _, inverse, counts = np.unique(rolled, return_inverse=True, return_counts=True)
    starts = np.nonzero(counts[inverse] > 1)[0]
    if not len(starts):
        return 0
    edges = np.zeros(len(ids) + 1, dtype=np.int32)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def duplicate_lines(data: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and all lines with a word."""
    lines = [line for line in data.split(b"\n") if line.strip(WORD_SPACES)]
    return len(lines) - len(set(lines)), len(lines)


def base_counts(text: str, data: bytes, words: list[bytes], ids: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    return (
        len(words),
        len(text) - count_bytes(data, WORD_SPACES),
        count_bytes(data, SYMBOLS),
        duplicate_lines(data)[0],
        repeated_words(ids),
    )


#: The classifier's inputs, in order.
FEATURES = (
    "log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share",
    "stop_share", "shout_share", "bar_share", "non_ascii_share", "distinct_share", "line_words", "top_word_share",
    "short_word_share", "long_word_share", "space_share", "end_marks_per_line", "at_share", "distinct_char_share",
)


def features(text: str) -> list[float]:
    """The classifier's inputs for one text; an empty text has zeros."""
    if not text:
        return [0.0] * len(FEATURES)
    data = text.encode()
    words = data.split()
    ids = word_ids(words)
    n_words, word_chars, n_symbols, n_dup, n_repeat = base_counts(text, data, words, ids)
    n_lines, chars, n = duplicate_lines(data)[1], len(text), max(n_words, 1)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n_words)
    counts = np.unique(ids, return_counts=True)[1] if n_words else np.zeros(1)
    return [
        float(np.log1p(n_words)), word_chars / n, n_symbols / chars, n_dup / max(n_lines, 1), n_repeat / n,
        count_bytes(data, UPPER) / chars, count_bytes(data, DIGIT) / chars, count_bytes(data, STOPS) / chars,
        count_bytes(data, SHOUT) / chars, data.count(b"|") / chars,
        (len(data) - chars) / chars,
        len(counts) / n, n / max(n_lines, 1), float(counts.max()) / n,
        float((sizes <= 2).mean()) if n_words else 0.0, float((sizes >= 12).mean()) if n_words else 0.0,
        count_bytes(data, WORD_SPACES) / chars, data.count(b".\n") / max(n_lines, 1), data.count(b"@") / n,
        len(set(text)) / chars,
    ]
