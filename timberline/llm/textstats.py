"""Statistics of whole texts, computed in Arrow batches with numpy; memory follows one small group of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from timberline.llm.common import BLANKS

_BLANKS = BLANKS.encode()
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = b"0123456789"
_MARKS = b"!?"
_ENDS = b".,;:"

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words",
    "n_upper", "n_lower", "n_digits", "n_marks", "n_ends", "n_bytes",
)
#: Shares that the models look at, each from the counts above.
RATES = ("log_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "upper_rate", "digit_rate", "mark_rate", "end_rate", "line_words")


def repeated_words(ids: np.ndarray, lengths: list[int], window: int = 5) -> np.ndarray:
    """Per text, how many words lie in windows that occur more than once in that text.

    ``ids`` are word numbers of all texts in a row, where no number serves two texts. Windows are named
    exactly, by pairs of pairs, so that no hash can collide.
    """

    def pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a.astype(np.int64) << 32 | b, return_inverse=True)[1]

    counts = np.zeros(len(lengths), np.int64)
    if len(ids) < window:
        return counts
    two = pairs(ids[:-1], ids[1:])
    four = pairs(two[:-2], two[2:])
    named, many = np.unique(four[: len(ids) - 4].astype(np.int64) << 32 | ids[4:], return_inverse=True, return_counts=True)[1:]
    # Windows across two texts never repeat wrongly: they hold numbers of both texts; a repeat means the same place pair.
    twice = many[named] > 1
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, np.flatnonzero(twice), 1)
    np.add.at(change, np.flatnonzero(twice) + window, -1)
    inside = np.cumsum(change[:-1]) > 0
    ends = np.cumsum(lengths)
    total = np.concatenate([[0], np.cumsum(inside)])
    return total[ends] - total[ends - np.asarray(lengths)]


def text_counts(texts: list[str]) -> np.ndarray:
    """A row of ``COUNTS`` per text. Words are runs without space and \\x09-\\x0D."""
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    ids: list[int] = []
    lengths = []
    first = 0
    for k, text in enumerate(texts):
        raw = text.encode()
        words = raw.split()
        known: dict[bytes, int] = {}
        for w in words:
            ids.append(first + known.setdefault(w, len(known)))
        first += len(known)
        lengths.append(len(words))
        lines = text.split("\n")
        dup = 0
        if len(lines) > 1:
            seen = set()
            for line in lines:
                if line in seen:
                    dup += bool(line.strip(BLANKS))
                else:
                    seen.add(line)
        gone = lambda chars: len(raw) - len(raw.translate(None, chars))
        out[k] = (
            len(words), len(text) - gone(_BLANKS), gone(_SYMBOLS), dup, 0, len(lines), len(known),
            gone(_UPPER), gone(_LOWER), gone(_DIGITS), gone(_MARKS), gone(_ENDS), len(raw),
        )
    if texts:
        out[:, 4] = repeated_words(np.asarray(ids, np.int64), lengths)
    return out


def rates(counts: np.ndarray) -> np.ndarray:
    """A row of ``RATES`` per row of ``COUNTS``; a text without words has zeros."""
    c = dict(zip(COUNTS, counts.T.astype(np.float64)))
    words, chars, letters = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_upper"] + c["n_lower"], 1)
    return np.stack(
        [
            np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words, c["n_dup_lines"] / np.maximum(c["n_lines"], 1),
            c["n_repeat_words"] / words, c["n_distinct_words"] / words, c["n_upper"] / letters, c["n_digits"] / chars,
            c["n_marks"] / words, c["n_ends"] / words, c["n_words"] / np.maximum(c["n_lines"], 1),
        ],
        axis=1,
    )


def groups_of(batch: pa.RecordBatch, column: int, most_chars: int = 1_000_000) -> Iterator[tuple[int, int, list[str]]]:
    """``begin, end, texts`` of stretches of a batch that hold about ``most_chars`` characters; null is an empty text."""
    texts, at = batch.column(column), 0
    while at < batch.num_rows:
        begin, size, some = at, 0, []
        while at < batch.num_rows and size < most_chars:
            some.append(texts[at].as_py() or "")
            size += len(some[-1])
            at += 1
        yield begin, at, some


def with_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``COUNTS`` (long) of every row."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[doc_id].dataType
    names = ["doc_id", *COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, texts in groups_of(batch, 1):
                found = text_counts(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin).cast(to_arrow_type(kind)), *map(pa.array, found.T)], names=names)

    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind.simpleString()}, " + ", ".join(f"{c} bigint" for c in COUNTS))
