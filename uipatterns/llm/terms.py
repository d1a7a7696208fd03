"""Terms of texts inside tasks: lower-cased runs of letters (and digits), on UTF-8 bytes.

Only A-Z are lower-cased and every byte from 0x80 on belongs to a term, so one
byte table both lowers and cuts; no text is decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

from uipatterns.llm.common import by_value

by_value(__name__)

LETTERS = b"abcdefghijklmnopqrstuvwxyz"
DIGITS = b"0123456789"


def byte_table(kept: bytes) -> bytes:
    """Maps a byte to itself if it belongs to terms, A-Z to a-z, all else to a space."""
    own = set(kept) | set(range(0x80, 0x100))
    return bytes(c if c in own else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


WORDS, WORDS_AND_NUMBERS = byte_table(LETTERS), byte_table(LETTERS + DIGITS)


def terms_of(text: bytes, table: bytes, piece: int = 1 << 22) -> Iterator[list[bytes]]:
    """The terms of a whole text, in lists of bounded size: a very long text comes in several."""
    if len(text) <= piece:
        yield text.translate(table).split()
        return
    at = 0
    while at < len(text):
        part = text[at:at + piece].translate(table)
        cut = len(part)
        if at + piece < len(text):
            cut = part.rfind(b" ") + 1
            if not cut:  # one term longer than a piece: take text up to its end
                rest = text[at:].translate(table)
                cut = rest.find(b" ") + 1 or len(rest)
                part = rest[:cut]
        yield part[:cut].split()
        at += cut


def utf8(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    """The values of a string column as bytes; empty for null."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    return (column[i].as_py() or b"" for i in range(len(column)))
