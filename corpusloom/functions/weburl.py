"""URLs by the WHATWG URL standard: absolute parse, resolution against a base, normal form.

Plain Python for one url; ``urls.normal`` and ``urls.resolve`` apply it to the different values of Arrow batches.
Windows drive letters of file urls have no special treatment.
"""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from dataclasses import dataclass, field, replace
from functools import lru_cache
from urllib.parse import unquote_to_bytes

PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21, "file": None}
_SCHEME = re.compile(r"[a-zA-Z][a-zA-Z0-9+.\-]*(?=:)")
_EDGES = "".join(map(chr, range(0x21)))
_FRAGMENT = frozenset(' "<>`')
_QUERY = frozenset(' "#<>')
_PATH = _QUERY | frozenset("?^`{}")
_USER = _PATH | frozenset("/:;=@[\\]|")
_BAD_HOST = re.compile(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]")
_BAD_OPAQUE = re.compile(r"[\x00\t\n\r #/:<>?@\[\\\]^|]")
_SINGLE, _DOUBLE = {".", "%2e"}, {"..", ".%2e", "%2e.", "%2e%2e"}


@dataclass(frozen=True)
class Url:
    scheme: str
    user: str = ""
    password: str = ""
    host: str | None = None
    port: int | None = None
    path: tuple[str, ...] | str = field(default_factory=tuple)  # a string if the path is opaque
    query: str | None = None
    fragment: str | None = None

    @property
    def special(self) -> bool:
        return self.scheme in PORTS

    def __str__(self) -> str:
        out = self.scheme + ":"
        path = self.path if isinstance(self.path, str) else "".join("/" + s for s in self.path)
        if self.host is not None:
            out += "//"
            if self.user or self.password:
                out += self.user + (":" + self.password if self.password else "") + "@"
            out += self.host + (f":{self.port}" if self.port is not None else "")
        elif path.startswith("//"):
            out += "/."
        out += path
        if self.query is not None:
            out += "?" + self.query
        return out if self.fragment is None else out + "#" + self.fragment


def encoded(text: str, reserved: frozenset[str] = frozenset()) -> str:
    """``text`` with control characters, all beyond ASCII and those of ``reserved`` as percent codes."""
    if text.isascii() and text.isprintable() and not reserved.intersection(text):
        return text
    return "".join(c if " " <= c <= "~" and c not in reserved else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def _ipv4(host: str) -> str | None:
    """Dotted form of an address in decimal, octal or hexadecimal numbers of 1 to 4 parts; empty if it is wrong."""
    parts = host.split(".")
    if parts[-1] == "" and len(parts) > 1:
        parts.pop()
    last = parts[-1]
    if not (last.isascii() and last.isdigit() or re.fullmatch(r"0[xX][0-9a-fA-F]*", last)):
        return None
    numbers = []
    for part in parts:
        try:
            if part[:2] in ("0x", "0X"):
                numbers.append(int(part[2:] or "0", 16))
            elif len(part) > 1 and part[0] == "0":
                numbers.append(int(part, 8))
            else:
                numbers.append(int(part) if part.isascii() and part.isdigit() else -1)
        except ValueError:
            return ""
    if len(numbers) > 4 or min(numbers) < 0 or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        return ""
    value = numbers[-1] + sum(n << 8 * (3 - k) for k, n in enumerate(numbers[:-1]))
    return str(ipaddress.IPv4Address(value))


@lru_cache(maxsize=65_536)
def host_of(text: str, special: bool) -> str | None:
    """Normal form of a host, none if it isn't valid."""
    if text.startswith("["):
        try:
            return f"[{ipaddress.IPv6Address(text[1:-1]).compressed}]" if text.endswith("]") and "%" not in text else None
        except ValueError:
            return None
    if not special:
        return None if _BAD_OPAQUE.search(text) else encoded(text)
    name = unquote_to_bytes(text).decode("utf-8", "replace")
    if not name.isascii():
        name = unicodedata.normalize("NFKC", re.sub("[。．｡]", ".", name).replace("­", "")).lower()
        try:
            name = ".".join(label if label.isascii() else "xn--" + label.encode("punycode").decode() for label in name.split("."))
        except UnicodeError:
            return None
    name = name.lower()
    if not name or _BAD_HOST.search(name):
        return None
    address = _ipv4(name)
    return name if address is None else address or None


def _segments(text: str, special: bool, start: tuple[str, ...] = ()) -> tuple[str, ...]:
    """Path of ``text`` (without its first slash) after the segments ``start``; dots are resolved."""
    out = list(start)
    parts = (text.replace("\\", "/") if special else text).split("/")
    for i, part in enumerate(parts):
        low, last = part.lower(), i == len(parts) - 1
        if low in _DOUBLE:
            if out:
                out.pop()
            if last:
                out.append("")
        elif low in _SINGLE:
            if last:
                out.append("")
        else:
            out.append(encoded(part, _PATH))
    return tuple(out)


def _rest(url: Url, text: str, start: tuple[str, ...] | None = ()) -> Url:
    """``url`` with path, query and fragment of ``text``; no path is read where ``start`` is none."""
    text, sharp, fragment = text.partition("#")
    text, mark, query = text.partition("?")
    if start is not None:
        slash = text[:1] == "/" or url.special and text[:1] == "\\"
        if slash:
            path = _segments(text[1:], url.special)
        elif text or start or url.special:
            path = _segments(text, url.special, start)
        else:
            path = ()
        url = replace(url, path=path)
    return replace(url, query=encoded(query, _QUERY | {"'"} if url.special else _QUERY) if mark else None, fragment=encoded(fragment, _FRAGMENT) if sharp else None)


def _authority(scheme: str, text: str) -> Url | None:
    special = scheme in PORTS
    end = re.search(r"[/?#\\]" if special else "[/?#]", text)
    own, text = (text[: end.start()], text[end.start() :]) if end else (text, "")
    user, at, place = own.rpartition("@")
    user, _, password = user.partition(":")
    found = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::(.*))?", place, re.S)
    if not found or at and not place:
        return None
    host, port = found[1], found[2]
    if host or special and scheme != "file":
        host = host_of(host, special)
        if host is None:
            return None
    if scheme == "file":
        if at or port:
            return None
        host = "" if host == "localhost" else host
    number = None
    if port:
        if not (port.isascii() and port.isdigit()) or int(port) > 65_535:
            return None
        number = None if int(port) == PORTS.get(scheme) else int(port)
    return _rest(Url(scheme, encoded(user, _USER), encoded(password, _USER), host, number), text)


def parse(text: str, base: Url | None = None) -> Url | None:
    """The url of ``text``, seen from ``base`` if it is relative; none if it isn't valid."""
    text = re.sub("[\t\n\r]", "", text.strip(_EDGES))
    found = _SCHEME.match(text)
    if found:
        scheme, rest = found[0].lower(), text[found.end() + 1 :]
        if scheme not in PORTS:
            if rest.startswith("//"):
                return _authority(scheme, rest[2:])
            if rest.startswith("/"):
                return _rest(Url(scheme), rest)
            path, cut, tail = re.fullmatch(r"([^?#]*)([?#]?)(.*)", rest, re.S).groups()
            return _rest(Url(scheme, path=encoded(path)), cut + tail, None)
        if scheme != "file":
            if base is None or base.scheme != scheme or rest[:2] == "//":
                return _authority(scheme, rest.lstrip("/\\"))
            text = rest
        else:
            slashes = re.match(r"[/\\]*", rest)[0]
            if len(slashes) >= 2:
                return _authority("file", rest[2:])
            if base is None or base.scheme != "file":
                return _rest(Url("file", host=""), "/" + rest[len(slashes) :])
            text = rest
    elif base is None:
        return None
    if isinstance(base.path, str):
        return _rest(base, text, None) if text.startswith("#") else None
    if base.special:
        text = re.sub(r"^[/\\]{2}", "//", text)
    if text.startswith("//"):
        return _authority(base.scheme, text[2:].lstrip("/\\") if base.special and base.scheme != "file" else text[2:])
    if not text or text.startswith("#"):
        query = base.query
        return replace(_rest(base, text, None), query=query)
    if text.startswith("?"):
        return _rest(base, text, None)
    if text[0] == "/" or base.special and text[0] == "\\":
        return _rest(base, "/" + text[1:])
    return _rest(base, text, base.path[:-1])


@lru_cache(maxsize=16_384)
def _base(text: str) -> Url | None:
    return parse(text)


def normal(text: str | None) -> str | None:
    """Normal form of an absolute url."""
    found = None if text is None else parse(text)
    return None if found is None else str(found)


def resolve(base: str | None, target: str | None) -> str | None:
    """Normal form of ``target`` seen from ``base``; a base that isn't a url lets absolute targets through."""
    if target is None:
        return None
    found = parse(target, None if base is None else _base(base))
    return None if found is None else str(found)
