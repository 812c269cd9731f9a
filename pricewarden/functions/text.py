"""Accent folding, link fingerprints and region aliases, all inside the JVM."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

COMBINING_MARKS = "[\\u0300-\\u036f]"
# The characters the source system counts as white space besides the plain blank.
ODD_SPACE = "\\t\\n\\x0B\\f\\r\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
# Runs of white space that are not already one plain blank: most texts have few, so little is replaced. Marks, digits and letters
# of ASCII are ruled out first, as the long list of blanks is dear to look through.
BLANK_RUNS = f"(?![!-~])(?: (?![!-~])[ {ODD_SPACE}]+|(?! )[{ODD_SPACE}][ {ODD_SPACE}]*)"
MOJIBAKE = (
    ("Ã‘", "Ñ"),
    ("Ã±", "ñ"),
    ("Ã¡", "á"),
    ("Ã©", "é"),
    ("Ã\u00ad", "í"),
    ("Ã³", "ó"),
    ("Ãº", "ú"),
    ("Ã“", "Ó"),
    ("Ã‰", "É"),
    ("Ãš", "Ú"),
    ("Ã¼", "ü"),
)
REGION_ALIASES = {"CERCADO DE LIMA": "LIMA"}


@lru_cache(maxsize=1)
def _folding_pairs() -> tuple[str, str]:
    """Every character whose canonical decomposition is one base character plus marks we drop."""
    composed, bases = [], []
    for code in range(0x00C0, sys.maxunicode + 1):
        char = chr(code)
        kept = [c for c in unicodedata.normalize("NFD", char) if not 0x0300 <= ord(c) <= 0x036F]
        if len(kept) == 1 and kept[0] != char:
            composed.append(char)
            bases.append(kept[0])
    return "".join(composed), "".join(bases)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times in `body`; keeps long text rules linear in size."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_accents(col: Column) -> Column:
    composed, bases = _folding_pairs()
    return F.regexp_replace(F.translate(F.coalesce(col, F.lit("")), composed, bases), COMBINING_MARKS, "")


def fold_text(value: str) -> str:
    """What `fold` makes of a constant, by the same table, computed while the plan is built."""
    plain = value.translate(str.maketrans(*_folding_pairs()))
    return "".join(c for c in plain if not 0x0300 <= ord(c) <= 0x036F).upper()


def squeeze(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, BLANK_RUNS, " "))


def fold(col: Column) -> Column:
    """Upper case without accents."""
    return F.upper(strip_accents(col))


def link_text(col: Column) -> Column:
    """The only normalisation a link may use: accents, case and blanks. No abbreviations."""
    return squeeze(fold(col))


def link_key(legal_name: Column, address: Column, district: Column, scheme: str) -> Column:
    """32 hex digits of the normalised triple, or null if any part is empty.

    `scheme` names the publisher's way of making keys; both sides of a link must use the same.
    """

    def key(parts: Column) -> Column:
        body = F.concat(F.lit(f"{scheme}|"), F.to_json(parts))
        return F.when(~F.array_contains(parts, F.lit("")), F.substring(F.sha2(body, 256), 1, 32))

    return let(F.array(*[link_text(part) for part in (legal_name, address, district)]), key)


def repair_mojibake(col: Column) -> Column:
    for broken, sound in MOJIBAKE:
        col = F.replace(col, F.lit(broken), F.lit(sound))
    return col


def plain_upper(col: Column) -> Column:
    """Repaired, accent-free, upper-case text."""
    return fold(repair_mojibake(F.coalesce(col, F.lit(""))))


def canonical_region(col: Column) -> Column:
    def known(name: Column) -> Column:
        expr = name
        for alias, target in REGION_ALIASES.items():
            expr = F.when(name == alias, F.lit(target)).otherwise(expr)
        return expr

    return let(squeeze(plain_upper(col)), known)
