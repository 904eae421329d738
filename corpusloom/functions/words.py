"""Texts to plain words: apart from case, accents, Unicode form, punctuation, markup, escapes and invisible characters."""

from __future__ import annotations

import html
import re
import unicodedata

INLINE = re.compile(r"</?(?:a|b|i|u|em|strong|span|mark|sub|sup|small|code|font|wbr)(?:\s[^<>]*)?/?>", re.IGNORECASE)
TAG = re.compile(r"<(?:/?[a-zA-Z!][^<>]*)>")
LINK_TARGET = re.compile(r"\]\([^()\s]*\)")
ESCAPED_CODE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})")
ESCAPED_BLANK = re.compile(r"\\[nrt]")
PERCENT = re.compile(r"(?:%[0-9a-fA-F]{2})+")
#: Dropped without a gap: apostrophes, hyphens, soft hyphens, emphasis marks; a hyphen at a line's end joins its word.
JOINED = re.compile(r"['’‘`´*_~‐‑­]|-(?:\s*\n\s*)?")
WORD = re.compile(r"[^\W_]+")
ASCII_WORD = re.compile(r"[a-z0-9]+")
SPECIAL = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "ł": "l", "þ": "th", "ı": "i"}
DROPPED = {c: None for c in range(0x300, 0x110000) if unicodedata.combining(chr(c)) or unicodedata.category(chr(c)) == "Cf"} | {0xAD: None}
FOLDED = str.maketrans(SPECIAL) | DROPPED
#: All that FOLDED may change.
OTHER = re.compile(r"[^\x00-\x7f]+")


def _percent(m: re.Match) -> str:
    try:
        return bytes.fromhex(m[0].replace("%", "")).decode()
    except UnicodeDecodeError:
        return m[0]


def unmarked(text: str) -> str:
    """``text`` without tags, link targets, entities and escapes."""
    if "\\" in text:
        text = ESCAPED_CODE.sub(lambda m: chr(int(m[1] or m[2], 16)), text)
        text = ESCAPED_BLANK.sub("\n", text)
    if "%" in text:
        text = PERCENT.sub(_percent, text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub(" ", INLINE.sub("", text))
    if "](" in text:
        text = LINK_TARGET.sub("]", text)
    return text


def fold(text: str) -> str:
    """Lower case without accents and invisible characters, compatibility forms unified."""
    if text.isascii():
        return text.lower()
    return OTHER.sub(lambda m: m[0].translate(FOLDED), unicodedata.normalize("NFKD", text.casefold()))


def words(text: str | None) -> list[str]:
    """The words of a text in order; none for null and blank texts. Letters and digits only, folded."""
    if not text:
        return []
    text = JOINED.sub("", fold(unmarked(text)))
    return (ASCII_WORD if text.isascii() else WORD).findall(text)
