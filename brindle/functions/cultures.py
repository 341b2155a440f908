"""How numbers, dates and letters are written in some cultures."""

from __future__ import annotations

from dataclasses import dataclass

from brindle.diagnostics import fail
from brindle.functions.registry import Bound


@dataclass(frozen=True)
class Culture:
    """date, time: patterns as Spark has them."""

    decimal: str = "."
    group: str = ","
    date: str = "MM/dd/yyyy"
    time: str = "HH:mm:ss"
    dotless: bool = False


INVARIANT = Culture()
# Marks for fractions and thousands, and short dates with long times, by culture.
CULTURES = {
    "": INVARIANT,
    "en": Culture(date="M/d/yyyy", time="h:mm:ss a"),
    "en-us": Culture(date="M/d/yyyy", time="h:mm:ss a"),
    "en-gb": Culture(date="dd/MM/yyyy"),
    "de": Culture(",", ".", "dd.MM.yyyy"),
    "de-de": Culture(",", ".", "dd.MM.yyyy"),
    "de-at": Culture(",", " ", "dd.MM.yyyy"),
    "de-ch": Culture(".", "’", "dd.MM.yyyy"),
    "fr-fr": Culture(",", " ", "dd/MM/yyyy"),
    "es-es": Culture(",", ".", "d/M/yyyy", "H:mm:ss"),
    "it-it": Culture(",", ".", "dd/MM/yyyy"),
    "nl-nl": Culture(",", ".", "dd-MM-yyyy"),
    "pt-br": Culture(",", ".", "dd/MM/yyyy"),
    "sv-se": Culture(",", " ", "yyyy-MM-dd"),
    "ru-ru": Culture(",", " ", "dd.MM.yyyy", "H:mm:ss"),
    "tr-tr": Culture(",", ".", "d.MM.yyyy", dotless=True),
    "ja-jp": Culture(date="yyyy/MM/dd", time="H:mm:ss"),
}


def culture_of(name: Bound) -> Culture:
    found = CULTURES.get(str(name.value).lower()) if name.literal and name.value is not None else None
    if found is None:
        raise fail("UnsupportedCulture", f"the culture has to be given as a literal, one of {', '.join(repr(c) for c in CULTURES)}")
    return found


def written(number: str, culture: Culture) -> str:
    """A number's text with the culture's marks for the invariant ones."""
    if (culture.group, culture.decimal) == (",", "."):
        return number
    return f"translate({number}, ',.', '{culture.group}{culture.decimal}')"


def read(text: str, culture: Culture, groups: bool) -> str:
    """A number's text with the invariant marks; marks of thousands are dropped where they may stand."""
    if groups and culture.group:
        text = f"replace({text}, '{culture.group}', '')"
    return text if culture.decimal == "." else f"replace({text}, '{culture.decimal}', '.')"


def upper(text: str, culture: Culture) -> str:
    return f"upper(translate({text}, 'iı', 'İI'))" if culture.dotless else f"upper({text})"


def lower(text: str, culture: Culture) -> str:
    return f"lower(translate({text}, 'Iİ', 'ıi'))" if culture.dotless else f"lower({text})"
