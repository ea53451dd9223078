"""Text normalisation (X-11 ... X-19, Z-20): one Arrow pass with compiled rules.

Unicode composition has no JVM expression and the rules rewrite each other's
output in order, so the whole chain is one vectorised Pandas UDF instead of some
two hundred passes of ``regexp_replace``. A rule with a fixed text runs only
where that text occurs. Whitespace alone (``spaces``) stays in the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import ABBREVIATIONS, MISREAD

_KEYWORDS = ("Điều", "Khoản", "Điểm", "Chương", "Mục", "Phần", "Phụ lục", "số", "ngày", "tháng", "năm")
_KINDS = "|".join(("chỉ thị", "luật", "nghị định", "quyết định", "thông tư"))
_LAWS = "|".join(("bộ luật", "luật", "nghị định", "thông tư"))
_N, _NAME = r"(\d+)", "([^,.;]+)"
_CODE = r"\s*/\s*".join((_N, _N, "([A-Z0-9Đ-]+)"))


def _spaced(*parts: str) -> re.Pattern:
    """Parts with white space between them, case ignored."""
    return re.compile(r"\s+".join(parts), re.I)


def spaces(text: Column) -> Column:
    """X-12: white space collapsed and trimmed, in the JVM."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def compose(text: str) -> str:
    """X-11."""
    return unicodedata.normalize("NFC", text)


_misread = [(k, re.compile(rf"\b{k}\b"), right) for right, keys in MISREAD.items() for k in keys]
_short = [(k, re.compile(rf"\b{re.escape(k)}\b"), v) for k, v in ABBREVIATIONS.items()]
_dotted = [(k, re.compile(rf"\b{re.escape(k)}\s"), v + " ") for k, v in ABBREVIATIONS.items() if k.endswith(".")]


def _replace(text: str, rules) -> str:
    for key, pattern, value in rules:
        if key in text:
            text = pattern.sub(value, text)
    return text


def correct(text: str) -> str:
    """X-13: misread words, whole words only."""
    return _replace(text, _misread)


def expand(text: str, every: bool = False) -> str:
    """X-14: dotted abbreviations before white space, or every one as a whole word."""
    return _replace(text, _short if every else _dotted)


_STOPS, _BLACK = "([.,;:!?)])", r"(\S)"


def _between_digits(signs: str) -> re.Pattern:
    return re.compile(rf"(?<=\d)\s*[{signs}]\s*(?=\d)")


# Matches take their neighbours along, so of touching matches only every other one is rewritten.
_signs = [(re.compile(p), r) for p, r in ((_STOPS + _BLACK, r"\1 \2"), (_BLACK + r"\s+" + _STOPS, r"\1\2"), (r"\(" + _BLACK, r"( \1"), (_BLACK + r"\s+\(", r"\1 ("))]
_signs += [(_between_digits("-–—"), "-"), (_between_digits(r"/\\"), "/")]
_cased = [(re.compile(rf"{w}\s+", re.I), w + " ") for w in _KEYWORDS]


def punctuation(text: str) -> str:
    """X-15: one space after signs and none before, dashes and slashes between digits closed up, keywords in their usual case."""
    for pattern, value in _signs + _cased:
        text = pattern.sub(value, text)
    return text


_number = [(re.compile(p), r) for p, r in ((f"{_N},{_N}", r"\1.\2"), (_N + r"\.(\d{3})(?!\d)", r"\1,\2"), (r"(?<=\d)\s+(?=%|°C)", ""))]


def numbers(text: str) -> str:
    """X-16: decimal commas become points, points before exactly three digits commas; no space before % and °C."""
    for pattern, value in _number:
        text = pattern.sub(value, text)
    return text


def _capital(word: str) -> str:
    return word[:1].upper() + word[1:].lower()


_numbered: list[tuple[re.Pattern, str | Callable]] = [
    (_spaced("số", _CODE + r"\s*-\s*([A-Z0-9]+)"), r"Số \1/\2/\3-\4"),
    (_spaced(f"({_KINDS})", "số", _CODE), lambda m: f"{_capital(m[1])} số " + "/".join(m.groups()[1:])),
    (_spaced("điều", _N, "khoản", _N, "điểm", "([a-z])"), lambda m: " ".join(x for pair in zip(_KEYWORDS, m.groups()) for x in pair)),
    (_spaced("ngày", r"(\d{1,2})", "tháng", r"(\d{1,2})", "năm", r"(\d{4})"), lambda m: " ".join(x for pair in zip(_KEYWORDS[8:], m.groups()) for x in pair)),
]


def document_numbers(text: str) -> str:
    """X-17."""
    for pattern, value in _numbered:
        text = pattern.sub(value, text)
    return text


_BASIS = "|".join(("áp dụng", "căn cứ", "chiếu", "quy định tại", "theo"))


def _joined(m: re.Match, *capitals: int) -> str:
    """The groups with single spaces, some with a capital."""
    return " ".join(_capital(g) if i in capitals else "số" if g.lower() == "số" else g for i, g in enumerate(m.groups(), 1))


_crossed: list[tuple[re.Pattern, Callable]] = [
    (_spaced(f"({_BASIS})", "(điểm|điều|khoản)", r"(\d+|[a-z])", rf"(?:tại|của)?\s*({_LAWS})", _NAME), lambda m: _joined(m, 2, 4)),
    (_spaced("(căn cứ|chiếu|theo)", f"({_LAWS})", _NAME, "(số)", r"(\d+/\d+/[A-Z0-9-]+)"), lambda m: _joined(m, 2)),
    (_spaced("(điều)", _N, f"({_LAWS})", _NAME), lambda m: _joined(m, 1, 3)),
]


def cross_references(text: str) -> str:
    """X-18."""
    for pattern, value in _crossed:
        text = pattern.sub(value, text)
    return text


def clean_text(text: str, abbreviations: bool = False, legal: bool = False) -> str:
    """X-19 of one text."""
    text = correct(re.sub(r"\s+", " ", compose(text)).strip())
    text = numbers(punctuation(expand(text, True) if abbreviations else text))
    return cross_references(document_numbers(text)) if legal else text


def clean(text: Column, abbreviations: bool = False, legal: bool = False) -> Column:
    """X-19 over a column; null stays null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else clean_text(t, abbreviations, legal))

    return run(text)


def without_furniture(text: Column) -> Column:
    """Z-20: page numbers, ruled header lines, list marks and odd characters removed; at most two line breaks in a row."""
    text = F.regexp_replace(text, r"(?iu)trang\s*\d+", "")
    text = F.regexp_replace(text, r"(?m)^-{3,}.*?-{3,}$", "")
    text = F.regexp_replace(text, r"(?m)^[-*+]\s*", "")
    text = F.regexp_replace(text, r"[^\p{L}\p{N}_\s.,;:!?()/%&'\"-]", "")
    return F.regexp_replace(text, r"\n{3,}", "\n\n")
