"""Text functions on columns. All of them are built-in expressions."""

from __future__ import annotations

import string
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that level-2 cleaning marks with an underscore.
RESERVED_WORDS = [
    "ADD",
    "EXTERNAL",
    "PROCEDURE",
    "ALL",
    "FETCH",
    "PUBLIC",
    "ALTER",
    "FILE",
    "RAISERROR",
    "AND",
    "FILLFACTOR",
    "READ",
    "ANY",
    "FOR",
    "READTEXT",
    "AS",
    "FOREIGN",
    "RECONFIGURE",
    "ASC",
    "FREETEXT",
    "REFERENCES",
    "AUTHORIZATION",
    "FREETEXTTABLE",
    "REPLICATION",
    "BACKUP",
    "FROM",
    "RESTORE",
    "BEGIN",
    "FULL",
    "RESTRICT",
    "BETWEEN",
    "FUNCTION",
    "RETURN",
    "BREAK",
    "GOTO",
    "REVERT",
    "BROWSE",
    "GRANT",
    "REVOKE",
    "BULK",
    "GROUP",
    "RIGHT",
    "BY",
    "HAVING",
    "ROLLBACK",
    "CASCADE",
    "HOLDLOCK",
    "ROWCOUNT",
    "CASE",
    "IDENTITY",
    "ROWGUIDCOL",
    "CHECK",
    "IDENTITY_INSERT",
    "RULE",
    "CHECKPOINT",
    "IDENTITYCOL",
    "SAVE",
    "CLOSE",
    "IF",
    "SCHEMA",
    "CLUSTERED",
    "IN",
    "SECURITYAUDIT",
    "COALESCE",
    "INDEX",
    "SELECT",
    "COLLATE",
    "INNER",
    "SEMANTICKEYPHRASETABLE",
    "COLUMN",
    "INSERT",
    "SEMANTICSIMILARITYDETAILSTABLE",
    "COMMIT",
    "INTERSECT",
    "SEMANTICSIMILARITYTABLE",
    "COMPUTE",
    "INTO",
    "SESSION_USER",
    "CONSTRAINT",
    "IS",
    "SET",
    "CONTAINS",
    "JOIN",
    "SETUSER",
    "CONTAINSTABLE",
    "KEY",
    "SHUTDOWN",
    "CONTINUE",
    "KILL",
    "SOME",
    "CONVERT",
    "LEFT",
    "STATISTICS",
    "CREATE",
    "LIKE",
    "SYSTEM_USER",
    "CROSS",
    "LINENO",
    "TABLE",
    "CURRENT",
    "LOAD",
    "TABLESAMPLE",
    "CURRENT_DATE",
    "MERGE",
    "TEXTSIZE",
    "CURRENT_TIME",
    "NATIONAL",
    "THEN",
    "CURRENT_TIMESTAMP",
    "NOCHECK",
    "TO",
    "CURRENT_USER",
    "NONCLUSTERED",
    "TOP",
    "CURSOR",
    "NOT",
    "TRAN",
    "DATABASE",
    "NULL",
    "TRANSACTION",
    "DBCC",
    "NULLIF",
    "TRIGGER",
    "DEALLOCATE",
    "OF",
    "TRUNCATE",
    "DECLARE",
    "OFF",
    "TRY_CONVERT",
    "DEFAULT",
    "OFFSETS",
    "TSEQUAL",
    "DELETE",
    "ON",
    "UNION",
    "DENY",
    "OPEN",
    "UNIQUE",
    "DESC",
    "OPENDATASOURCE",
    "UNPIVOT",
    "DISK",
    "OPENQUERY",
    "UPDATE",
    "DISTINCT",
    "OPENROWSET",
    "UPDATETEXT",
    "DISTRIBUTED",
    "OPENXML",
    "USE",
    "DOUBLE",
    "OPTION",
    "USER",
    "DROP",
    "OR",
    "VALUES",
    "DUMP",
    "ORDER",
    "VARYING",
    "ELSE",
    "OUTER",
    "VIEW",
    "END",
    "OVER",
    "WAITFOR",
    "ERRLVL",
    "PERCENT",
    "WHEN",
    "ESCAPE",
    "PIVOT",
    "WHERE",
    "EXCEPT",
    "PLAN",
    "WHILE",
    "EXEC",
    "PRECISION",
    "WITH",
    "EXECUTE",
    "PRIMARY",
    "WITHIN GROUP",
    "EXISTS",
    "PRINT",
    "WRITETEXT",
    "EXIT",
    "PROC",
]

# Character rules of level-1 and level-2 cleaning.
SINGLE_CHARACTERS = {"-": "_", " ": "_", "(": "", ")": "", '"': "", ";": "", ":": ""}
WIDENED_CHARACTERS = {"'": "''", "&": "and"}

RESERVED_PATTERN = r"(?i)\s(" + "|".join(RESERVED_WORDS) + r")\s"

UPPER = string.ascii_uppercase
LOWER = string.ascii_lowercase


def ascii_text(text: str) -> str:
    """Canonical decomposition, then everything outside ASCII removed."""
    return unicodedata.normalize("NFD", text).encode("ascii", "ignore").decode("ascii")


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Every single character that decomposes to something with an ASCII part, and that part."""
    source, target = [], []
    for code in range(0x80, 0x2300):  # no later character has an ASCII part
        char = chr(code)
        if unicodedata.decomposition(char)[:1] not in ("", "<"):
            plain = ascii_text(char)
            if plain:
                source.append(char)
                target.append(plain)
    return "".join(source), "".join(target)


def _plain(col: Column, then: dict[str, str] | None = None) -> Column:
    """Accents off and everything outside ASCII removed, with ASCII characters mapped by
    ``then`` on the way (to one character, or to nothing). One pass over the text."""
    then = then or {}
    source, target = _accent_table()
    pairs = [(a, then.get(b, b)) for a, b in zip(source, target)] + list(then.items())
    pairs.sort(key=lambda pair: pair[1] == "")  # characters without a partner are deleted
    mapped = F.translate(col, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    return F.regexp_replace(mapped, r"[^\x00-\x7F]", "")


def strip_accents(col: Column) -> Column:
    """Letters lose their accents, other characters outside ASCII are removed.

    Same result as decomposing and encoding to ASCII, but as one character map,
    so the value never leaves the JVM.
    """
    return _plain(col)


def fold_case(col: Column) -> Column:
    """Lower-case the 26 ASCII letters only."""
    return F.translate(col, UPPER, LOWER)


def _mark_reserved(col: Column) -> Column:
    pieces = F.split(col, RESERVED_PATTERN, -1)
    words = F.regexp_extract_all(col, F.lit(RESERVED_PATTERN), F.lit(1))
    return F.array_join(
        F.zip_with(pieces, words, lambda p, w: F.concat(p, F.coalesce(F.concat(F.lit("_"), F.upper(w)), F.lit("")))),
        "",
    )


def clean_text(col: Column, level: int = 0, lower: bool = False, length: int | None = None) -> Column:
    """Clean a string column.

    ``level`` -1: accents only; 0: runs of ``'`` become ``''``; 1: drop ``()":;``,
    double ``'``, ``-`` and space become ``_``, ``&`` becomes ``and``; 2: also mark
    reserved words that stand between white space.
    """
    if level not in (-1, 0, 1, 2):
        raise ValueError(f"level must be -1, 0, 1 or 2, not {level!r}")
    if level == 1:
        text = _plain(col, SINGLE_CHARACTERS)
    else:
        text = strip_accents(col)
    if level == 2:
        text = F.translate(_mark_reserved(text), "".join(SINGLE_CHARACTERS), "".join(SINGLE_CHARACTERS.values()))
    if level >= 1:
        for char, replacement in WIDENED_CHARACTERS.items():
            text = F.replace(text, F.lit(char), F.lit(replacement))
    elif level == 0:
        text = F.regexp_replace(text, "'+", "''")
    if lower:
        text = F.lower(text)
    return F.substring(text, 1, length) if length else text


def word_set(col: Column) -> Column:
    """Trimmed, lower-cased, punctuation removed, split at white space: the sorted set of words.

    NULL gives the empty set.
    """
    plain = F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"\p{Punct}+", "")
    return F.sort_array(F.array_distinct(F.array_remove(F.split(plain, r"\s+"), "")))


def bare_number(col: Column) -> Column:
    """Text trimmed and without commas; whole numbers also without plus sign and leading zeros.

    Names its input once, so that nothing is computed twice where Spark cannot share it.
    """
    plain = F.trim(F.replace(col, F.lit(","), F.lit("")))
    return F.regexp_replace(plain, r"^\+?(-?)0*(?=\d+$)", "$1")


def number_text(col: Column) -> Column:
    """:func:`bare_number`, with NULL where nothing is left."""
    return F.nullif(bare_number(col), F.lit(""))


def number_value(col: Column) -> Column:
    """The number written in a text with thousands commas, NULL where there is none."""
    plain = F.trim(F.replace(col, F.lit(","), F.lit("")))
    return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), plain).try_cast("double")
