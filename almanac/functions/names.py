"""Column names: default names, unique names, clean names (driver side, names only)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from .text import RESERVED_PATTERN, SINGLE_CHARACTERS, WIDENED_CHARACTERS, ascii_text

ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def default_name(position: int) -> str:
    return f"_field_{position}"


def repeat_suffix(repeat: int) -> str:
    """Suffix of the n-th repeat of a name: 1 -> b, 2 -> c, ... 25 -> z, 26 -> za."""
    full, rest = divmod(repeat, len(ALPHABET))
    return ALPHABET[-1] * full + ALPHABET[rest]


def unique_names(names: Sequence[str], nocase: bool = True) -> list[str]:
    """Make names unique from left to right by adding a suffix to later repeats."""
    fold = str.lower if nocase else str
    taken: set[str] = set()
    result = []
    for name in names:
        candidate, repeat = name, 0
        while fold(candidate) in taken:
            repeat += 1
            candidate = name + repeat_suffix(repeat)
        taken.add(fold(candidate))
        result.append(candidate)
    return result


def clean_name(name: str, level: int = 1, lower: bool = False, length: int | None = None) -> str:
    """The rules of :func:`almanac.functions.text.clean_text` for one name."""
    if level not in (-1, 0, 1, 2):
        raise ValueError(f"level must be -1, 0, 1 or 2, not {level!r}")
    text = ascii_text(name)
    if level == 2:
        text = re.sub(RESERVED_PATTERN, lambda m: "_" + m.group(1).upper(), text)
    if level >= 1:
        text = text.translate(str.maketrans({**SINGLE_CHARACTERS, **WIDENED_CHARACTERS}))
    elif level == 0:
        text = re.sub("'+", "''", text)
    if lower:
        text = text.lower()
    return text[:length] if length else text
