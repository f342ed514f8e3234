"""Url parsing after the WHATWG rules that matter for http pages, and what follows from it.

Python parses and resolves; keys, groups and matches on the parts are columns.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple
from urllib.parse import parse_qsl, quote, unquote_to_bytes, urlencode

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = re.compile(r"^([a-zA-Z][a-zA-Z0-9+.\-]*):(.*)$", re.DOTALL)
# Default ports of special schemes.
_PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}
_PATH_SAFE = "!$%&'()*+,-./:;=@[]_|~\\^"
_QUERY_SAFE = "!$%&()*+,-./:;=?@[]_|~\\^`{}"
_FRAGMENT_SAFE = "!#$%&'()*+,-./:;=?@[]_|~\\^{}"


class Url(NamedTuple):
    scheme: str
    host: str  # with a port that is not the default
    path: str
    query: str  # with its ?, else ''
    fragment: str  # with its #, else ''

    @property
    def href(self) -> str:
        head = f"{self.scheme}://{self.host}" if self.scheme in _PORTS or self.host else f"{self.scheme}:"
        return f"{head}{self.path}{self.query}{self.fragment}"


def _segments(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")[1:]
    for i, p in enumerate(parts):
        last, low = i == len(parts) - 1, p.lower().replace("%2e", ".")
        if low == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif low == ".":
            if last:
                out.append("")
        else:
            out.append(quote(p, safe=_PATH_SAFE))
    return "/" + "/".join(out)


def parse(raw: str, base: Url | None = None) -> Url | None:
    """A url, resolved against base if it is relative; None if it is none."""
    text = re.sub(r"[\t\n\r]", "", raw.strip("".join(map(chr, range(33)))))
    m = _SCHEME.match(text)
    scheme = m[1].lower() if m else None
    if scheme is None or (base and scheme == base.scheme and scheme in _PORTS and not re.match(r"[/\\]{2}", m[2])):
        if scheme is not None:
            text = m[2]
        elif base is None:
            return None
        if base.scheme not in _PORTS:
            return None
        return _relative(text, base)
    rest = m[2]
    rest, query, fragment = _tails(rest)
    if scheme not in _PORTS:
        return Url(scheme, "", quote(rest, safe=_PATH_SAFE + " ?#"), query, fragment)
    rest = rest.replace("\\", "/").lstrip("/")
    return _absolute(scheme, rest, query, fragment)


def _tails(text: str) -> tuple[str, str, str]:
    text, hash_, fragment = text.partition("#")
    text, mark, query = text.partition("?")
    return text, f"?{quote(query, safe=_QUERY_SAFE)}" if mark and query else "", f"#{quote(fragment, safe=_FRAGMENT_SAFE)}" if hash_ and fragment else ""


def _absolute(scheme: str, rest: str, query: str, fragment: str) -> Url | None:
    authority, slash, path = rest.partition("/")
    host, colon, port = authority.rpartition("@")[2].partition(":")
    host = unquote_to_bytes(host).decode("utf-8", "replace").lower()
    if not host or re.search(r"[\x00-\x20#%/:<>?@\[\\\]^|]", host) or (colon and port and not port.isdigit()) or (port and int(port) > 65535):
        return None
    if not host.isascii():
        try:
            host = host.encode("idna").decode()
        except UnicodeError:
            return None
    port = str(int(port)) if port else ""
    if port and port != _PORTS[scheme]:
        host = f"{host}:{port}"
    return Url(scheme, host, _segments("/" + path) if slash else "/", query, fragment)


def _relative(text: str, base: Url) -> Url | None:
    rest, query, fragment = _tails(text)
    rest = rest.replace("\\", "/")
    if rest.startswith("//"):
        return _absolute(base.scheme, rest.lstrip("/"), query, fragment)
    if rest.startswith("/"):
        return Url(base.scheme, base.host, _segments(rest), query, fragment)
    if not rest:
        return Url(base.scheme, base.host, base.path, query if "?" in text.partition("#")[0] else base.query, fragment)
    return Url(base.scheme, base.host, _segments(base.path.rpartition("/")[0] + "/" + rest), query, fragment)


@lru_cache(maxsize=4096)
def parse_cached(raw: str) -> Url | None:
    return parse(raw)


def page_key(raw: str) -> str:
    """Key by which a page's own url, its canonical and its hreflang links compare: no fragment, no end slash, query as it is."""
    u = parse_cached(raw)
    if u is None:
        return re.sub(r"/$", "", re.sub(r"#.*$", "", raw.strip()))
    path = u.path[:-1] if len(u.path) > 1 and u.path.endswith("/") else u.path
    return f"{u.scheme}://{u.host}{path}{u.query}"


# Characters whose escapes stay when a path is decoded.
_RESERVED = set(";/?:@&=+$,#")


def _decode_path(path: str) -> str:
    """Percent-decode, but for reserved characters; a malformed path stays."""
    def run(m: re.Match[str]) -> str:
        raw = bytes.fromhex(m[0].replace("%", ""))
        text = raw.decode("utf-8")
        return "".join(f"%{ord(c):02X}" if c in _RESERVED else c for c in text)

    if re.search(r"%(?![0-9a-fA-F]{2})", path):
        return path
    try:
        return re.sub(r"(?:%[0-9a-fA-F]{2})+", run, path)
    except UnicodeDecodeError:
        return path


def crawl_key(raw: str, base: str | None = None, keep_query: bool = False) -> str | None:
    """Key by which a crawl tells urls apart; None for what is not crawled."""
    text = (raw or "").strip()
    low = text.lower()
    if not text or text.startswith("#") or low.startswith(("mailto:", "tel:", "javascript:", "data:")):
        return None
    u = parse(text, parse_cached(base) if base else None)
    if u is None or u.scheme not in ("http", "https"):
        return None
    query = ""
    if keep_query and u.query:
        pairs = sorted(parse_qsl(u.query[1:], keep_blank_values=True))
        query = "?" + urlencode(pairs) if pairs else ""
    path = _decode_path(u.path)
    path = path[:-1] if len(path) > 1 and path.endswith("/") else path
    return f"{u.scheme}://{u.host}{path}{query}"


# ---------------------------------------------------------------- columns

def host_of(key: Column) -> Column:
    """Lower-case host with port of a parsed http url; '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(key, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1))


def path_of(key: Column) -> Column:
    p = F.regexp_extract(F.coalesce(key, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def path_group(path: Column) -> Column:
    """/first segment, or / for the root."""
    return F.concat(F.lit("/"), F.coalesce(F.get(segments(path), 0), F.lit("")))


def is_internal(host: Column, root_host: str, follow_subdomains: bool = False) -> Column:
    if not follow_subdomains:
        return host == root_host.lower()
    root = re.sub(r"^www\.", "", root_host.lower())
    return (host == root) | host.endswith("." + root)


def glob_regex(pattern: str) -> str:
    """Java regex of a path glob: * and ? stay within a segment, ** crosses them, [..] and {a,b} as usual; case does not matter."""
    out, i, braces = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            if pattern[i : i + 2] == "**":
                whole = (i == 0 or pattern[i - 1] == "/") and (i + 2 == len(pattern) or pattern[i + 2] == "/")
                if whole and i + 2 < len(pattern):
                    out, i = out + "(?:[^/]+/)*", i + 3
                    continue
                out, i = out + (".*" if whole else "[^/]*"), i + 2
                continue
            alone = (i == 0 or pattern[i - 1] == "/") and (i + 1 == len(pattern) or pattern[i + 1] == "/")
            out += "[^/]+" if alone else "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end
        elif c == "{" and "}" in pattern[i:]:
            out, braces = out + "(?:", braces + 1
        elif c == "}" and braces:
            out, braces = out + ")", braces - 1
        elif c == "," and braces:
            out += "|"
        else:
            out += re.escape(c) if not c.isalnum() and c not in "/_" else c
        i += 1
    return f"(?i)^{out}$"


def glob_match(path: Column, pattern: str) -> Column:
    """Whether a path matches; blank never does, and /x/* or /x/** also match the prefix and all below it."""
    p = pattern.strip()
    if not p:
        return F.lit(False)
    out = path.rlike(glob_regex(p))
    for tail in ("/**", "/*"):
        if p.endswith(tail):
            prefix = p[: -len(tail)]
            return out | (path == prefix) | path.startswith(prefix + "/")
    return out


def any_glob(path: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | glob_match(path, p)
    return out
