"""Text, tags, charsets and formats of HTML pages as Spark columns; links are read by ``page``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLAIN_URL = r"https?://[^\s<>\"')\]}]+"
CHARSET = r"(?i)<meta\s[^>]*charset\s*=\s*[\"']?([a-zA-Z0-9_-]+)"
TAG = r"<([a-zA-Z][a-zA-Z0-9]*)[\s/>]"

CATEGORIES = {
    "basic": "body br h1 h2 h3 h4 h5 h6 head hr html p title",
    "formatting": "abbr acronym address b bdi bdo big blockquote center cite code del dfn em font i ins kbd mark meter pre progress q rp rt ruby s samp small strike strong sub sup template time tt u var wbr",
    "form": "button datalist fieldset form input label legend optgroup option output select textarea",
    "frame": "frame frameset iframe noframes",
    "image": "area canvas figcaption figure img map picture svg",
    "audio_video": "audio source track video",
    "link": "a link nav",
    "list": "dd dir dl dt li menu ol ul",
    "table": "caption col colgroup table tbody td tfoot th thead tr",
    "style": "article aside data details dialog div footer header hgroup main search section span style summary",
    "meta": "base basefont meta",
    "programming": "applet embed noscript object param script",
}


def text_of(html: Column) -> Column:
    """Text without comments, scripts, styles and tags, with single spaces."""
    bare = F.regexp_replace(html, r"(?s)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), r"\s+", " "))


def plain_urls(text: Column) -> Column:
    """URLs with a scheme in plain text, without trailing punctuation."""
    return F.transform(F.regexp_extract_all(text, F.lit(PLAIN_URL), F.lit(0)), lambda u: F.regexp_replace(u, "[.,;:!?]+$", ""))


def charset(html: Column) -> Column:
    found = F.regexp_extract(html, CHARSET, 1)
    return F.lower(F.when(found != "", found))


def looks_like_html(text: Column) -> Column:
    """Case counts: a doctype at the very start; or ``<html`` before ``</html>``; or, without an end, ``<html`` at
    the very start or after a doctype."""
    doctype, start, end = (F.instr(text, x) for x in ("<!DOCTYPE html", "<html", "</html>"))
    opened = F.when(end > 0, (start > 0) & (start < end)).otherwise((start == 1) | ((doctype > 0) & (doctype < start)))
    return (doctype == 1) | opened


def category(tag: Column) -> Column:
    out: Column | None = None
    for name, own in CATEGORIES.items():
        case = tag.isin(own.split())
        out = F.when(case, name) if out is None else out.when(case, name)
    return out.otherwise("unknown")
