"""Text functions: cleaning, token normal form, whole-word tests, slugs."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folds() -> tuple[str, str]:
    """Accented lower-case letters that decompose to one ASCII letter, and these letters."""
    found = []
    for i in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(i)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not "̀" <= x <= "ͯ")
        if c == c.lower() and base != c and len(base) == 1 and base.isascii():
            found.append((c, base))
    return "".join(a for a, _ in found), "".join(b for _, b in found)


ACCENTED, PLAIN = _folds()

def let(value: Column, then) -> Column:
    """then(value), where value is evaluated once however often then uses it.

    A column used n times in an expression is n copies of it; nested, these grow
    without bound, so functions that use an argument more than once bind it first.
    """
    return F.get(F.transform(F.array(value), then), F.lit(0))


#: White space beyond ASCII, which Java's \s leaves out.
BLANKS = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def clean(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{BLANKS}]+", " "))


def folded(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.regexp_replace(F.lower(text), r"[\x{0300}-\x{036F}]", ""), ACCENTED, PLAIN)


def token(text: Column) -> Column:
    """Lower-case ASCII words and numbers, one space between them."""
    return F.trim(F.regexp_replace(folded(text), "[^a-z0-9]+", " "))


def plain_token(text: str) -> str:
    """token() of a Python string."""
    low = "".join(x for x in unicodedata.normalize("NFD", text.lower()) if not "̀" <= x <= "ͯ")
    return re.sub("[^a-z0-9]+", " ", low).strip()


def has_any(normal: Column, phrases) -> Column:
    """Whether text in token() form holds one of the phrases as whole words."""
    words = sorted({p for p in map(plain_token, phrases) if p})
    return F.concat(F.lit(" "), normal, F.lit(" ")).rlike(f" (?:{'|'.join(words)}) ")


def slug(text: Column) -> Column:
    """Words joined by dashes, without one at either end."""
    dashed = F.regexp_replace(folded(text), "[^a-z0-9]+", "-")
    return F.regexp_replace(F.regexp_replace(dashed, "^-", ""), "-$", "")


def text_or_null(value: Column) -> Column:
    """The trimmed text, null where nothing is left."""
    own = F.regexp_replace(F.regexp_replace(value, f"^[{BLANKS}]+", ""), f"[{BLANKS}]+$", "")
    return F.when(own != "", own)


def list_or_null(value: Column) -> Column:
    """The trimmed items of a text split at commas and line ends; null where none is left."""
    items = F.filter(F.transform(F.split(value, r"[\r\n,]+"), text_or_null), lambda x: x.isNotNull())
    return F.when(F.size(items) > 0, items)


def joined(*parts: Column) -> Column:
    """Texts and arrays of texts with a space between any two."""
    return F.concat_ws(" ", *parts)
