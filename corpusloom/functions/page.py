"""Start tags, attributes and links of HTML source in one pass, with the syntax that browsers accept.

Attribute values may be in double quotes, single quotes or bare; character references are resolved. Comments and
the content of elements that hold raw text (scripts, styles, titles, noscript, ...) have no tags.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

from corpusloom.functions.strings import script_links

_OPEN = re.compile(r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|([a-zA-Z][^\s/>]*)|[!?/][^>]*>?)", re.S)
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_END = re.compile(r"[\s/]*>")
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
LINKS, MEDIA = frozenset(("a", "area", "link")), frozenset("audio embed iframe img input source track video".split())
ONCLICK = re.compile(r"location\s*\.\s*href\s*=\s*'\s*([^']*)'")


def tags(source: str) -> Iterator[tuple[str, dict[str, str], str]]:
    """(tag, attributes, raw text) of each start tag; of repeated attributes the first counts."""
    at, size = 0, len(source)
    low: str | None = None
    while at < size:
        found = _OPEN.search(source, at)
        if not found:
            return
        at = found.end()
        if not found[1]:
            continue
        tag, attributes = found[1].lower(), {}
        while True:
            end = _END.match(source, at)
            if end:
                at = end.end()
                break
            own = _ATTRIBUTE.match(source, at)
            if not own:
                return
            at = own.end()
            value = next((g for g in own.groups()[1:] if g is not None), "")
            attributes.setdefault(own[1].lower(), entities.unescape(value) if "&" in value else value)
        text = ""
        if tag in _RAW:
            low = source.lower() if low is None else low
            # lower case may change a text's length; then the places are looked up without it
            close = low.find(f"</{tag}", at) if len(low) == size else next((m.start() for m in re.compile(f"</{tag}", re.I).finditer(source, at)), -1)
            text, at = (source[at:], size) if close < 0 else (source[at:close], close)
        yield tag, attributes, text


def links(source: str) -> tuple[bool, str | None, list[tuple[str, str]]]:
    """(follows, base, links): whether the robots tag lets links be followed, the first base element's href, and
    (method, target) of the page's different links in order, those of elements with rel "nofollow" aside."""
    follows, base, based = True, None, False
    found: dict[tuple[str, str], None] = {}
    for tag, attributes, text in tags(source):
        if tag == "meta":
            follows &= not (attributes.get("name") == "robots" and attributes.get("content") == "nofollow")
        elif tag == "base" and not based:
            base, based = attributes.get("href"), True
        elif tag in LINKS:
            if "href" in attributes and attributes.get("rel") != "nofollow":
                found["Href", attributes["href"]] = None
        elif tag in MEDIA:
            if "src" in attributes:
                found["Embedded", attributes["src"]] = None
        elif tag == "form":
            if "action" in attributes:
                found["Form", attributes["action"]] = None
        elif tag == "script":
            if "src" in attributes:
                found["JavaScript", attributes["src"]] = None
            else:
                found.update({("JavaScriptEmbedded", x): None for x in script_links(text)})
        if "onclick" in attributes:
            target = ONCLICK.search(attributes["onclick"])
            if target:
                found["OnClick", target[1].strip()] = None
    return follows, base, list(found)


_SKIPPED = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_PLAIN = re.compile(r"\b[a-zA-Z][a-zA-Z0-9+.\-]*://[^\s<>\"')\]}]+")


def text(source: str) -> str:
    """Text without comments, scripts, styles and tags, with single spaces."""
    return " ".join(entities.unescape(re.sub(r"<[^>]*>", " ", _SKIPPED.sub(" ", source))).split())


def plain_urls(text_: str) -> list[str]:
    """Different urls with a scheme in plain text, without trailing punctuation."""
    return list(dict.fromkeys(u.rstrip(".,;:!?") for u in _PLAIN.findall(text_)))
