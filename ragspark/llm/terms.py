"""Terms of UTF-8 texts inside Arrow tasks: maximal runs of term characters, ASCII capitals folded."""

from __future__ import annotations

import string

_LETTERS, _DIGITS = string.ascii_letters.encode(), string.digits.encode()


def _table(kept: bytes) -> bytes:
    return bytes(b if b in kept or b > 127 else 32 for b in range(256)).lower()


#: Letters and everything beyond ASCII; with digits besides.
WORDS, WORDS_AND_DIGITS = _table(_LETTERS), _table(_LETTERS + _DIGITS)


def terms_of(text: bytes, table: bytes) -> list[bytes]:
    """Bytes beyond ASCII are never separators, so every term is whole UTF-8 characters."""
    return text.translate(table).split()
