"""Language codes of ISO 639: three letters, two letters and English names of the languages that detectors know."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TABLE = """afr af Afrikaans;amh am Amharic;ara ar Arabic;aze az Azerbaijani;bel be Belarusian;ben bn Bengali;bul bg Bulgarian;cat ca Catalan;ces cs Czech;
cmn zh Mandarin;cym cy Welsh;dan da Danish;deu de German;ell el Greek;eng en English;epo eo Esperanto;est et Estonian;eus eu Basque;fas fa Persian;fin fi Finnish;
fra fr French;gle ga Irish;glg gl Galician;guj gu Gujarati;heb he Hebrew;hin hi Hindi;hrv hr Croatian;hun hu Hungarian;hye hy Armenian;ind id Indonesian;
isl is Icelandic;ita it Italian;jav jv Javanese;jpn ja Japanese;kan kn Kannada;kat ka Georgian;khm km Khmer;kor ko Korean;lat la Latin;lav lv Latvian;
lit lt Lithuanian;mal ml Malayalam;mar mr Marathi;mkd mk Macedonian;mya my Burmese;nep ne Nepali;nld nl Dutch;nob nb Norwegian;ori or Oriya;pan pa Punjabi;
pes fa Persian;pol pl Polish;por pt Portuguese;ron ro Romanian;rus ru Russian;sin si Sinhala;slk sk Slovak;slv sl Slovenian;sna sn Shona;spa es Spanish;
sqi sq Albanian;srp sr Serbian;swe sv Swedish;tam ta Tamil;tel te Telugu;tgl tl Tagalog;tha th Thai;tuk tk Turkmen;tur tr Turkish;ukr uk Ukrainian;
urd ur Urdu;uzb uz Uzbek;vie vi Vietnamese;yid yi Yiddish;zul zu Zulu"""
ROWS = [tuple(row.strip().split(" ", 2)) for row in _TABLE.split(";")]
THREE_TO_TWO = {three: two for three, two, _ in ROWS}
_NAMES = {two: name for _, two, name in ROWS}
_THREE = {two: three for three, two, _ in reversed(ROWS)} | {"fa": "fas"}


def _looked_up(value: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), value)


def code(lang: Column) -> Column:
    """Three-letter code of a code or an English name in any case; null if it isn't known."""
    own = F.lower(F.trim(lang))
    by_name = {name.lower(): _THREE[two] for two, name in _NAMES.items()}
    return F.coalesce(_looked_up(own, _THREE), F.when(own.isin(*THREE_TO_TWO), own), _looked_up(own, by_name))


def name(lang: Column) -> Column:
    """English name of a language given as for ``code``."""
    return _looked_up(_looked_up(code(lang), THREE_TO_TWO), _NAMES)
