"""Disguised forms of personal data, made from labelled spans for training, and what a span of each kind must hold."""

from __future__ import annotations

import random
import re

AT = (" @ ", "(at)", " (at) ", " [at] ", "[at]", " at ", " {at} ", "@ ")
DOT = (".", " . ", "(dot)", " (dot) ", " [dot] ", "[dot]", " dot ", "[.]", "(.)")
GROUPED = (".", "/", "_", " / ", " . ", "  ", ":", "--", " - ")
NUMBERS = re.compile(r"[0-9]+")


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def holds(kind: str, s: str) -> bool:
    """Whether a span of this kind can be what it says: the numbers of an address, the digits of a card or telephone."""
    if kind == "email":
        return re.search(r"[A-Za-z0-9]\W*(?:@|\bat\b)\W*[A-Za-z0-9]", s) is not None and re.search(r"[A-Za-z0-9]\W*(?:\.|\bdot\b)\W*[A-Za-z0-9]+$", s) is not None
    if kind == "ip":
        parts = NUMBERS.findall(s)
        return len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts)
    n = len(digits_of(s))
    if kind == "card":
        return 13 <= n <= 19 and luhn(digits_of(s))
    return 9 <= n <= 15


def disguise(kind: str, span: str, r: random.Random) -> str | None:
    """Another way to write the span that the stated patterns don't read as the whole of it."""
    if kind == "email":
        local, _, domain = span.partition("@")
        at, dot = r.choice(AT), r.choice(DOT)
        if at == "@ " and dot == ".":
            at = " @ "
        return local + at + domain.replace(".", dot)
    if kind == "ip":
        return r.choice(DOT[1:]).join(span.split("."))
    digits = digits_of(span)
    if kind == "card":
        by = r.choice((4, 4, 4, 5))
        return r.choice(GROUPED).join(digits[k : k + by] for k in range(0, len(digits), by))
    if len(digits) < 9:
        return None
    head, rest = digits[:-10], digits[-10:]
    area, mid, last = rest[:-7], rest[-7:-4], rest[-4:]
    if r.random() < 0.5:
        sep = r.choice(("/", "_", " / ", "--", ":", "·"))
        return f"+{head}" + sep + sep.join((area, mid, last))
    return r.choice((f"({area}) {mid}-{last}", f"{head}-{area}-{mid}-{last}", f"00{head} {area} {mid} {last}", f"{area}.{mid}.{last}", f"tel. {area}-{mid}-{last}"[5:], f"({area}){mid}.{last}"))


def innocent(r: random.Random) -> str:
    """Numbers and marks that are no personal data, but look a little like it."""
    n = lambda a, b: str(r.randint(a, b))
    return r.choice(
        (
            lambda: f"{n(1990, 2030)}-{n(10, 12)}-{n(10, 28)}", lambda: f"{n(1, 28)}.{n(1, 12)}.{n(1990, 2030)}", lambda: f"{n(10, 23)}:{n(10, 59)}:{n(10, 59)}", lambda: f"version {n(1, 9)}.{n(0, 20)}.{n(0, 9)}",
            lambda: f"{n(1, 999)},{n(100, 999)}.{n(10, 99)}", lambda: f"{n(1, 99)} at {n(1, 99)}", lambda: f"{n(300, 999)}.{n(300, 999)}.{n(1, 9)}.{n(1, 9)}", lambda: f"[{n(1, 99)}]", lambda: f"({n(1, 9)}) {n(10, 99)}-{n(10, 99)}",
            lambda: f"@name{n(1, 99)}", lambda: f"{n(10**15, 10**16)}", lambda: f"{n(1000, 9999)}/{n(10, 99)}", lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)), lambda: f"{n(1, 9)} dot {n(1, 9)}", lambda: f"+{n(1, 99)} %",
        )
    )()
