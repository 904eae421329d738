"""The Porter stemmer (M. F. Porter, An algorithm for suffix stripping, 1980) for lower-case words."""

from __future__ import annotations

import re
from functools import lru_cache

C, V = "[^aeiou](?:[^aeiouy]*)", "[aeiouy][aeiou]*"
MEASURE_1 = re.compile(f"^({C})?{V}{C}")
EXACTLY_1 = re.compile(f"^({C})?{V}{C}({V})?$")
MEASURE_2 = re.compile(f"^({C})?{V}{C}{V}{C}")
HAS_VOWEL = re.compile(f"^({C})?[aeiouy]")
DOUBLED = re.compile(r"([^aeiouylsz])\1$")
SHORT = re.compile(f"^{C}[aeiouy][^aeiouwxy]$")
#: The suffixes of steps 2, 3 and 4.
STEP_2 = dict(
    x.split(":") for x in "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log".split()
)
STEP_3 = dict((x + ":").split(":")[:2] for x in "icate:ic ative alize:al iciti:ic ical:ic ful ness".split())
STEP_4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()
ENDING_2, ENDING_3, ENDING_4 = (re.compile(f"^(.+?)({'|'.join(sorted(x, key=len, reverse=True))})$") for x in (STEP_2, STEP_3, STEP_4))


@lru_cache(100_000)
def stem(word: str) -> str:
    if len(word) < 3:
        return word
    first = word[0] == "y"
    w = "Y" + word[1:] if first else word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if MEASURE_1.match(w[:-3]) else w
    elif m := re.match(r"^(.+?)(ed|ing)$", w):
        if HAS_VOWEL.match(m[1]):
            w = m[1]
            if w.endswith(("at", "bl", "iz")) or SHORT.match(w):
                w += "e"
            elif DOUBLED.search(w):
                w = w[:-1]
    if w.endswith("y") and HAS_VOWEL.match(w[:-1]):
        w = w[:-1] + "i"
    if (m := ENDING_2.match(w)) and MEASURE_1.match(m[1]):
        w = m[1] + STEP_2[m[2]]
    if (m := ENDING_3.match(w)) and MEASURE_1.match(m[1]):
        w = m[1] + STEP_3[m[2]]
    if m := ENDING_4.match(w):
        w = m[1] if MEASURE_2.match(m[1]) else w
    elif (m := re.match(r"^(.+?)(s|t)(ion)$", w)) and MEASURE_2.match(m[1] + m[2]):
        w = m[1] + m[2]
    if w.endswith("e"):
        root = w[:-1]
        if MEASURE_2.match(root) or EXACTLY_1.match(root) and not SHORT.match(root):
            w = root
    if w.endswith("ll") and MEASURE_2.match(w):
        w = w[:-1]
    return "y" + w[1:] if first else w
