"""Hosts of URLs, as the URL standard reads them: IPv4 numbers in any base, bracketed IPv6, percent-decoded names; invalid ones raise BadUrl."""

from __future__ import annotations

import ipaddress
import re
import unicodedata
from urllib.parse import unquote_to_bytes

#: Schemes with an authority and a default port; fixed values.
SPECIAL = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}
_PARTS = re.compile(r"([a-z][a-z0-9+.-]*):[/\\]*([^/\\?#]*)", re.IGNORECASE | re.ASCII)
_OPAQUE = re.compile(r"([a-z][a-z0-9+.-]*)://([^/?#]*)", re.IGNORECASE | re.ASCII)
_FORBIDDEN = frozenset("\0\t\n\r #/:<>?@[\\]^|%\x7f") | frozenset(map(chr, range(32)))


class BadUrl(ValueError):
    pass


def _number(part: str) -> int | None:
    """An IPv4 part: hexadecimal after 0x, octal after 0, else decimal."""
    try:
        if part[:2].lower() == "0x":
            return int(part[2:] or "0", 16) if all(c in "0123456789abcdefABCDEF" for c in part[2:]) else None
        if not part.isascii() or not part.isdigit():
            return None
        return int(part, 8) if len(part) > 1 and part[0] == "0" else int(part)
    except ValueError:
        return None


def _ipv4(host: str) -> str | None:
    """Canonical dotted form if the last label is a number; BadUrl if that doesn't make an address."""
    parts = host.split(".")
    if parts[-1] == "" and len(parts) > 1:
        parts.pop()
    if not (parts[-1].isascii() and parts[-1].isdigit()) and _number(parts[-1]) is None or parts[-1] == "":
        return None
    numbers = [_number(p) if p else None for p in parts]
    if len(parts) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(parts)):
        raise BadUrl(host)
    value = numbers[-1] + sum(n << 8 * (3 - k) for k, n in enumerate(numbers[:-1]))
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def host_of(url: str) -> str:
    """The host of an absolute URL, canonical; IPv6 in brackets. Raises BadUrl."""
    url = url.strip("".join(map(chr, range(33)))).replace("\t", "").replace("\n", "").replace("\r", "")
    m = _PARTS.match(url)
    if not m:
        raise BadUrl(url)
    scheme, special = m[1].lower(), m[1].lower() in SPECIAL
    if not special:
        m = _OPAQUE.match(url)
        if not m:
            return ""
    authority = m[2].rpartition("@")[2]
    if authority.startswith("["):
        inside, closed, rest = authority[1:].partition("]")
        if not closed or rest and rest[0] != ":":
            raise BadUrl(url)
        port = rest[1:]
        try:
            host = f"[{_ipv6(inside)}]"
        except ValueError:
            raise BadUrl(url) from None
    else:
        host, _, port = authority.partition(":")
        if special:
            if not host:
                raise BadUrl(url)
            try:
                host = unquote_to_bytes(host).decode("utf-8")
            except UnicodeDecodeError:
                host = unquote_to_bytes(host).decode("utf-8", "replace")
            host = unicodedata.normalize("NFKC", host).lower().replace("\u00ad", "").replace("\u3002", ".")
            if not host.isascii():
                try:
                    host = host.encode("idna").decode("ascii")
                except UnicodeError:
                    raise BadUrl(url) from None
            if not host or _FORBIDDEN & set(host):
                raise BadUrl(url)
            host = _ipv4(host) or host
        elif _FORBIDDEN - {"%"} & set(host):
            raise BadUrl(url)
    if port and not (port.isascii() and port.isdigit() and int(port) < 65536):
        raise BadUrl(url)
    return host


def _ipv6(text: str) -> str:
    """Compressed hexadecimal form, without a dotted tail."""
    groups = f"{int(ipaddress.IPv6Address(text)):032x}"
    parts = [f"{int(groups[k : k + 4], 16):x}" for k in range(0, 32, 4)]
    best, at = 0, -1
    k = 0
    while k < 8:  # the first longest run of zeros, of two at least
        n = 0
        while k + n < 8 and parts[k + n] == "0":
            n += 1
        if n > max(best, 1):
            best, at = n, k
        k += n or 1
    return ":".join(parts) if at < 0 else ":".join(parts[:at]) + "::" + ":".join(parts[at + best :])


def normalize_host(host: str) -> str:
    """IPv4 addresses inside IPv6 ones as dotted IPv4, the unspecified one among them; the loopback address and all other hosts as they are, without brackets, in lower case."""
    bare = host.removeprefix("[").removesuffix("]").lower()
    try:
        address = ipaddress.IPv6Address(bare)
    except ValueError:
        return bare
    if address.is_loopback:
        return "::1"
    return str(ipaddress.IPv4Address(int(address) & 0xFFFFFFFF)) if int(address) >> 32 in (0, 0xFFFF) else bare


def _octets(host: str) -> list[int] | None:
    """The parts of a dotted host of four numbers."""
    parts = host.split(".")
    return [int(p) for p in parts] if len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 9 for p in parts) else None


def is_loopback(host: str) -> bool:
    return host.lower() in ("localhost", "::1") or (n := _octets(host)) is not None and (n[0] == 127 or not any(n))


def is_private(host: str) -> bool:
    return (n := _octets(host)) is not None and (n[0] == 10 or n[:2] == [192, 168] or n[0] == 172 and 16 <= n[1] <= 31)
