"""Links and markup in reviews, and folding of what looks alike."""

from __future__ import annotations

import html
import re
import unicodedata

import regex

#: Letters of other scripts that look like Latin ones (Cyrillic, Greek and a few Latin variants), before lower-casing.
LOOKALIKES = str.maketrans(
    {
        "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G",
        "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "Ӏ": "l", "ѵ": "v", "г": "r", "п": "n", "ґ": "r", "ь": "b", "ё": "e", "ї": "i", "є": "e",
        "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
        "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "η": "n", "ω": "w", "ϲ": "c", "ϳ": "j",
        "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "l", "ɴ": "n", "ʀ": "r", "ѐ": "e", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "ƅ": "b",
        "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "յ": "j",
    }
)

LINK = re.compile(r"(?:(?:https?|hxxps?|ftp)://|www\.)[^\s<>\"')\]]+|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}(?:/[^\s<>\"')\]]*)?(?![\w@])|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}/[^\s<>\"')\]]*", re.I)
TAGS = re.compile(r"<[^<>]*>")
#: Accents, and format and control characters other than line break, tab and our own marks.
_GONE = regex.compile(r"[\u0300-\u036f]+|(?![\n\t\x01-\x03])[\p{Cf}\p{Cc}]")


def unescape(text: str) -> str:
    """Character entities resolved, escaped ones of entities too."""
    for _ in range(2):
        if "&" not in text:
            break
        text = html.unescape(text)
    return text


def fold(text: str) -> str:
    """Compatibility forms, look-alikes, accents of Latin letters and invisible characters folded; lower case. The marks \x01 to \x03 stay."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text).translate(LOOKALIKES)
    return _GONE.sub("", text).casefold()
