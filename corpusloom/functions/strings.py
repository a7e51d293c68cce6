"""Text functions without a built-in equivalent, as Arrow-backed UDFs."""

from __future__ import annotations

import base64
import re
import unicodedata

import pandas as pd
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SCRIPT = re.compile(r"//[^\n]*|/\*.*?\*/|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`|[A-Za-z_$][\w$]*|;|\S", re.S)


def script_links(source: str) -> list[str]:
    """String literals that follow the identifier ``href`` before the next semicolon."""
    out, armed = [], False
    for token in _SCRIPT.findall(source):
        if token == "href":
            armed = True
        elif token == ";":
            armed = False
        elif armed and token[0] in "'\"`" and len(token) > 1:
            out.append(token[1:-1].strip())
            armed = False
    return out


def raw_urls(content: bytes) -> list[str]:
    """Possible urls in arbitrary bytes: runs without white space or control bytes with a scheme or a dotted name."""
    out = []
    for run in re.findall(rb"[\x21-\x7e\x80-\xff]{4,}", content):
        text = run.decode("utf-8", "ignore")
        m = re.search(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^\s<>\"'()]+|(?:[\w-]+\.)+[a-zA-Z]{2,}(?::\d+)?(?:/[^\s<>\"'()]*)?|\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?(?:/[^\s<>\"'()]*)?)", text)
        if m:
            out.append(m[0].rstrip(".,;!?"))
    return out


def porter(word: str) -> str:
    """English stem: plural, -ed and -ing endings and common suffixes (steps 1 to 5 of Porter's algorithm)."""

    def kinds(w: str) -> str:
        out = ""
        for i, c in enumerate(w):
            out += "v" if c in "aeiou" or c == "y" and i and out[-1] == "c" else "c"
        return out

    def measure(w: str) -> int:
        return len(re.findall("v+c+", kinds(w)))

    def short(w: str) -> bool:
        return kinds(w)[-3:] == "cvc" and w[-1] not in "wxy"

    w = word
    if len(w) <= 2:
        return w
    for end, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + new
            break
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in kinds(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif kinds(w)[-2:] == "cc" and w[-1] == w[-2] and w[-1] not in "lsz":
                    w = w[:-1]
                elif measure(w) == 1 and short(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in kinds(w[:-1]):
        w = w[:-1] + "i"
    two = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
    three = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
    for table in (two, three):
        for end in sorted(table, key=len, reverse=True):
            if w.endswith(end):
                if measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + table[end]
                break
    for end in sorted(("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"), key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (measure(w[:-1]) > 1 or measure(w[:-1]) == 1 and not short(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and measure(w) > 1:
        w = w[:-1]
    return w


def german(word: str) -> str:
    """German stem (endings of steps 1 to 3 of the Snowball stemmer within the regions R1 and R2)."""
    w = word.replace("ß", "ss")
    vowels = "aeiouyäöü"

    def region(text: str, start: int) -> int:
        for i in range(start + 1, len(text)):
            if text[i] not in vowels and text[i - 1] in vowels:
                return i + 1
        return len(text)

    r1 = max(3, region(w, 0))
    r2 = region(w, region(w, 0) - 1) if region(w, 0) < len(w) else len(w)

    def cut(ends: tuple[str, ...], at: int, before: str | None = None) -> bool:
        nonlocal w
        for end in sorted(ends, key=len, reverse=True):
            if w.endswith(end):
                if len(w) - len(end) >= at and (before is None or w[: -len(end)][-1:] in before):
                    w = w[: -len(end)]
                    return True
                return False
        return False

    if not cut(("em", "ern", "er", "e", "en", "es"), r1):
        cut(("s",), r1, "bdfghklmnrt")
    if not cut(("en", "er", "est"), r1) and len(w) > 5:
        cut(("st",), r1, "bdfghklmnt")
    if not cut(("end", "ung"), r2) and not cut(("ig", "ik", "isch"), r2) and not cut(("lich", "heit"), r2):
        cut(("keit",), r2)
    return w.replace("ä", "a").replace("ö", "o").replace("ü", "u")


STEMMERS = {"en": porter, "de": german}


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


@F.pandas_udf(T.StringType())
def stem(term: pd.Series, lang: pd.Series) -> pd.Series:
    """Stem in lower case; languages without a stemmer keep the word."""
    return pd.Series([None if t is None else STEMMERS.get(x, str)(t.lower()) for t, x in zip(term, lang, strict=True)])


@F.pandas_udf(T.StringType())
def digest(content: pd.Series) -> pd.Series:
    """Labelled 128-bit digest in base 32 of bytes."""
    return content.map(lambda c: None if c is None else "xxh128:" + base64.b32encode(xxhash.xxh3_128_digest(bytes(c))).decode().rstrip("="))


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("invalid", T.IntegerType())]))
def robust_text(content: pd.Series) -> pd.DataFrame:
    """UTF-8 text of bytes without invalid ones, and how many there were."""
    rows = []
    for c in content:
        if c is None:
            rows.append((None, None))
        else:
            text = bytes(c).decode("utf-8", "ignore")
            rows.append((text, len(bytes(c)) - len(text.encode())))
    return pd.DataFrame(rows, columns=["text", "invalid"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def links_of_script(source: pd.Series) -> pd.Series:
    return source.map(lambda s: None if s is None else script_links(s))


@F.pandas_udf(T.ArrayType(T.StringType()))
def links_of_bytes(content: pd.Series) -> pd.Series:
    return content.map(lambda c: None if c is None else raw_urls(bytes(c)))
