"""Deciding and decoding text encodings of log lines."""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DETECT_BYTES = 64 * 1024

# Code pages with a decoder, those named cpNNN and those under another name.
CP_PAGES = (
    37, 273, 424, 437, 500, 720, 737, 775, 850, 852, 855, 856, 857, 858, 860, 861, 862, 863, 864, 865, 866, 869,
    874, 875, 932, 949, 950, 1006, 1026, 1125, 1140, 1250, 1251, 1252, 1253, 1254, 1255, 1256, 1257, 1258,
)
OTHER_PAGES = {
    936: "gbk",
    1361: "johab",
    10000: "mac_roman",
    20127: "ascii",
    20866: "koi8_r",
    20932: "euc_jp",
    21866: "koi8_u",
    28591: "latin_1",
    28592: "iso8859_2",
    28595: "iso8859_5",
    28597: "iso8859_7",
    28605: "iso8859_15",
    51932: "euc_jp",
    51949: "euc_kr",
    54936: "gb18030",
    65001: "utf_8",
}
PAGES = tuple(sorted({*CP_PAGES, *OTHER_PAGES}))


# Pages whose digits and punctuation are not those of ASCII.
EBCDIC_PAGES = (37, 273, 424, 500, 875, 1026, 1140)


# Pages in which a character may take more than one byte.
WIDE_PAGES = (932, 936, 949, 950, 1361, 20932, 51932, 51949, 54936, 65001)


def codec_of(page: int) -> str:
    """Codec name of a known code page."""
    return OTHER_PAGES.get(page) or f"cp{page:03d}"


def known_codepage(page: Column) -> Column:
    """Is there a decoder for this code page?"""
    return page.isin(*PAGES)


def named_codepage(name: Column) -> Column:
    """Page number of ``windows-<number>`` (any case, blanks around), NULL for another form or 0."""
    digits = F.regexp_extract(F.lower(F.trim(name)), "^windows-([0-9]+)$", 1)
    number = F.nullif(digits, F.lit("")).try_cast("bigint")
    return F.when((number > 0) & (number < (1 << 32)), number)


def _hex_tail(data: Column, n: int) -> Column:
    return F.hex(F.substring(data, -n, n))


def valid_utf8(data: Column) -> Column:
    """Are these bytes valid UTF-8 throughout?"""
    return F.is_valid_utf8(data.cast("string"))


def valid_utf8_head(data: Column) -> Column:
    """Valid UTF-8 except that the last character may be cut off."""
    # The start of a multi-byte character, by how many of its bytes are there.
    starts = {
        1: "^(C[2-9A-F]|D.|E.|F[0-4])$",
        2: "^(E0[AB].|E[1-9A-CEF][89AB].|ED[89].|F0[9AB].|F[1-3][89AB].|F48.)$",
        3: "^(F0[9AB].|F[1-3][89AB].|F48.)[89AB].$",
    }
    result = valid_utf8(data)
    for n, pattern in starts.items():
        rest = F.substring(data, F.lit(1), F.greatest(F.octet_length(data) - n, F.lit(0)))
        result = result | ((F.octet_length(data) >= n) & _hex_tail(data, n).rlike(pattern) & valid_utf8(rest))
    return result


def utf8_text(data: Column) -> Column:
    """Decode UTF-8, one U+FFFD per undecodable stretch."""
    return F.make_valid_utf8(data.cast("string"))


def _decode_one(data: bytes, codec: str) -> tuple[str, list[int]]:
    """Text of ``data`` and the offsets of undecodable stretches, in one pass."""
    bad: list[int] = []

    def replaced(error: UnicodeDecodeError) -> tuple[str, int]:
        byte = error.object[error.start]
        if codec.startswith("cp125") and 0x80 <= byte <= 0x9F:
            # unassigned in the table, passed through as the control character of that number
            return chr(byte), error.start + 1
        bad.append(error.start)
        return "\ufffd", max(error.end, error.start + 1)

    codecs.register_error("timberline-positions", replaced)
    return data.decode(codec, "timberline-positions"), bad


def byte_table(page: int) -> str:
    """The character of each of the 256 bytes of a single-byte page; U+FFFD for a byte without one."""
    return "".join(_decode_one(bytes([b]), codec_of(page))[0] for b in range(256))


def page_text(data: Column, page: int) -> Column:
    """Decode a single-byte page in the JVM: bytes as characters of their numbers, and those replaced by the page's."""
    table = byte_table(page)
    moved = [b for b in range(256) if table[b] != chr(b)]
    latin = F.decode(data, "ISO-8859-1")
    return F.translate(latin, "".join(map(chr, moved)), "".join(table[b] for b in moved)) if moved else latin


def page_gaps(data: Column, page: int) -> Column:
    """The offsets of bytes that have no character in a single-byte page."""
    none = F.array().cast("array<bigint>")
    gaps = "".join(chr(b) for b, c in enumerate(byte_table(page)) if c == "\ufffd")
    if not gaps:
        return none
    latin = F.decode(data, "ISO-8859-1")
    has_gap = F.translate(latin, gaps, "") != latin
    places = F.filter(F.sequence(F.lit(0), F.octet_length(data) - 1), lambda k: F.contains(F.lit(gaps), F.substr(latin, k + 1, F.lit(1))))
    return F.when(has_gap, places.cast("array<bigint>")).otherwise(none)


_DECODED = T.StructType([T.StructField("text", T.StringType()), T.StructField("bad_at", T.ArrayType(T.LongType()))])


@F.pandas_udf(_DECODED)
def decode_codepage(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """Decode bytes with a code page each; NULL bytes stay NULL. Arrow batches, one pass."""
    for data, page in batches:
        rows = [
            (None, None) if value is None else _decode_one(bytes(value), codec_of(int(number)))
            for value, number in zip(data, page)
        ]
        yield pd.DataFrame(rows, columns=["text", "bad_at"])
