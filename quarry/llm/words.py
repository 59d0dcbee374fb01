"""Plain words of a text: lower case, ASCII punctuation as white space."""

from __future__ import annotations

import string

TABLE = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(TABLE).split()
