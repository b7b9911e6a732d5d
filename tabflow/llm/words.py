"""Words of a text by byte classes: one pass that lower-cases A-Z and blanks every
separator, so that splitting gives the maximal runs of word characters."""

from __future__ import annotations


def byte_table(word_bytes: bytes) -> bytes:
    """Translation that keeps ``word_bytes`` and every byte of a character beyond
    ASCII, lower-cases A-Z, and turns all other bytes into blanks."""
    keep = set(word_bytes) | set(range(0x80, 0x100))
    return bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in keep else 0x20 for b in range(256))


_LETTERS = bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B))

#: runs of ``[^\x00-\x40\x5B-\x60\x7B-\x7F]``
LETTERS = byte_table(_LETTERS)
#: runs of ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]``
LETTERS_AND_DIGITS = byte_table(_LETTERS + b"0123456789")


def words(text: str | None, table: bytes) -> list[bytes]:
    """The words as UTF-8 bytes, in order; a null text has none."""
    return text.encode("utf-8").translate(table).split() if text else []
