"""Rows with everything that an operator has to bear, and plain Python of what the contracts say."""

from __future__ import annotations

import re
import zlib

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"river{i % 97} stone and water" for i in range(12_000))
PROSE = "the old house by the river was quiet and the people of the town came to see it every summer with their children"
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Nulls in every column, empty, blank and very long texts, ties, repeated rows.
ROWS = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, " \t\n\x0b\x0c\r ", None, None, None),
    (4, PROSE, "en", "a", len(PROSE)),
    (5, PROSE, "en", "b", len(PROSE)),
    (5, PROSE, "en", "b", len(PROSE)),
    (None, PROSE + " again", "en", None, None),
    (None, None, None, None, None),
    (6, LONG, "en", "a", len(LONG)),
    (7, "1234 5678 !!!", "fr", "b", 13),
    (8, "Café NOIR 中文 \U0001f600 mot\u0085fin É", "fr", "c", 20),
    (9, "x", None, "c", 1),
    (10, "one line\none line\n\none line\n", "de", "é", 28),
    (11, "# $ % & * < > |", "de", "", 15),
]


def lowered(text: str | None) -> str:
    """A-Z only."""
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def remainder(doc_id: int | None, of: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % of


def ordered(rows) -> list[tuple]:
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)


def collected(df, *columns: str) -> list[tuple]:
    return ordered(tuple(r[c] for c in columns) for r in df.collect())
