"""Text folding and cleaning as native column expressions.

Accent folding is a ``translate`` over a table built from Unicode decompositions, so it stays in the JVM.
Characters that expand to several letters (ligatures, fractions) are left to :func:`fold_exact`.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import lru_cache
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

COMBINING = "[\\u0300-\\u036f]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Use a value several times in ``body`` but compute it once per row."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), 0)


@lru_cache(maxsize=None)
def _fold_table(form: str) -> tuple[str, str]:
    """Characters whose decomposition is one ASCII letter or digit plus combining marks."""
    source, target = [], []
    for point in range(0x80, 0x10000):
        char = chr(point)
        parts = unicodedata.normalize(form, char)
        base = "".join(c for c in parts if unicodedata.category(c) != "Mn")
        if parts != char and len(base) == 1 and base.isascii() and base.isalnum():
            source.append(char)
            target.append(base)
    return "".join(source), "".join(target)


def strip_accents(text: Column, form: str = "NFD") -> Column:
    """Drop diacritics. ``form`` NFKD also folds full-width and super/subscript characters."""
    source, target = _fold_table(form)
    return F.regexp_replace(F.translate(text, source, target), COMBINING, "")


def plain(text: Column) -> Column:
    """Accent-free lower case; punctuation stays."""
    return F.lower(strip_accents(text))


def squeeze(text: Column) -> Column:
    """Collapse white space and trim."""
    return F.trim(F.regexp_replace(text, "[\\s\\u00a0]+", " "))


def fold_text(text: Column, form: str = "NFKD") -> Column:
    """Accent-free lower case with every other character run turned into one space."""
    lowered = F.lower(strip_accents(F.coalesce(text.cast("string"), F.lit("")), form))
    return F.trim(F.regexp_replace(lowered, "[^a-z0-9]+", " "))


@F.pandas_udf(StringType())
def fold_exact(values: pd.Series) -> pd.Series:
    """Opt-in Arrow version of :func:`fold_text` that also expands ligatures and fractions."""
    kept = values.fillna("").map(
        lambda v: "".join(c for c in unicodedata.normalize("NFKD", v) if not 0x300 <= ord(c) <= 0x36F)
    )
    return kept.str.lower().str.replace(r"[^a-z0-9]+", " ", regex=True).str.strip()


def squash(text: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def normalize_identifier(text: Column) -> Column:
    """Upper case, ``A-Z0-9`` only. Accented letters are dropped, full-width ones are folded."""
    source, target = _fold_table("NFKC")
    folded = F.translate(F.coalesce(text.cast("string"), F.lit("")), source, target)
    return F.regexp_replace(F.upper(folded), "[^A-Z0-9]", "")


def tokens(text: Column) -> Column:
    """Distinct folded words in order of appearance."""
    return F.array_distinct(F.filter(F.split(fold_text(text), " "), lambda t: t != ""))


def slugify(text: Column, limit: int = 160, fallback: str = "composant") -> Column:
    slug = F.substring(F.regexp_replace(fold_text(text), " ", "-"), 1, limit)
    return F.when(slug == "", F.lit(fallback)).otherwise(slug)


# Symbols and site names removed when printed text is cleaned.
LIGATURES = (("ﬁ", "fi"), ("ﬂ", "fl"), (" ", " "))
POLLUTION = ("Tom's Hardware Forum", "TweakTown", "Wccftech", "Newegg", "Pangoly", "VideoCardz")


def clean_printed(text: Column) -> Column:
    """Undo ligatures, drop site names, collapse spaces and trim edge punctuation."""
    value = text
    for old, new in LIGATURES:
        value = F.replace(value, F.lit(old), F.lit(new))
    value = F.btrim(F.regexp_replace(value, "\\s+", " "), F.lit(" ,.;"))
    for phrase in POLLUTION:
        value = F.replace(value, F.lit(phrase), F.lit(""))
    return F.btrim(F.regexp_replace(value, "\\s+", " "), F.lit(" ,.;"))


def clean_cell(text: Column) -> Column:
    """One line, runs of commas merged, edge separators trimmed."""
    value = F.regexp_replace(squeeze(text), "(?:\\s*,\\s*)+", ", ")
    return F.btrim(value, F.lit(" ,;:·"))


_REFERENCE = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


@lru_cache(maxsize=None)
def _named_characters() -> str:
    """The named characters of HTML 4 as one JSON literal."""
    names = {name: chr(point) for name, point in name2codepoint.items()}
    return json.dumps({**names, "apos": "'"}, ensure_ascii=False)


def _character(reference: Column) -> Column:
    """One character reference resolved; a name nobody knows stays as it is printed."""
    name = F.substring(reference, F.lit(2), F.length(reference) - 2)
    hexadecimal = F.conv(F.regexp_extract(name, "^#[xX](.*)$", 1), 16, 10)
    code = F.when(name.rlike("^#[xX]"), hexadecimal).when(F.startswith(name, F.lit("#")), F.substring(name, 2, 8)).cast("bigint")
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    numbered = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd"))
    named = F.from_json(F.lit(_named_characters()), "map<string,string>")[name]
    return F.when(F.startswith(name, F.lit("#")), numbered).otherwise(F.coalesce(named, reference))


def unescape_html(text: Column) -> Column:
    """Resolve character references in one pass, so that nothing is resolved twice. Texts without ``&`` pass through."""
    def resolve(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(_REFERENCE), F.lit(0)), _character)
        gaps = F.split(t, _REFERENCE)
        joined = F.array_join(F.zip_with(gaps, found, lambda gap, char: F.concat(gap, F.coalesce(char, F.lit("")))), "")
        return F.when(F.contains(t, F.lit("&")), joined).otherwise(t)

    return let(text, resolve)


def clean_markup(text: Column, limit: int | None = None) -> Column:
    """Tags to spaces, character references resolved, one line, optional display limit."""
    value = squeeze(unescape_html(F.regexp_replace(text, "<[^>]+>", " ")))
    return value if limit is None else F.substring(value, 1, limit)
