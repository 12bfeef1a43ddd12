"""Plain helpers of these tests."""

from __future__ import annotations

import re

import numpy as np

from folioscope.llm import pii

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def prose(rng, n, alphabet="aeinorst"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))) for _ in range(n))


# --- the field over spans, one candidate at a time

F = {f: k for k, f in enumerate(pii.FEATURES)}
TOKEN = re.compile(r"[0-9]+|[^\W0-9_]+|\s+|.", re.S)


def span_features(zone: str, a: int, b: int, n_tokens: int) -> np.ndarray | None:
    """What a whole candidate span looks like; none if it can't be an entity."""
    s = zone[a:b]
    digits = ''.join(c for c in s if '0' <= c <= '9')
    n = len(digits)
    at = s.count("@")
    if (n < 4 and not at) or at > 1:
        return None
    x = np.zeros(len(pii.FEATURES))
    x[F["bias"]] = 1
    letters = any(c.isalpha() for c in s)
    signs = {c for c in s if not c.isalnum() and not c.isspace()}
    spaced = any(c.isspace() for c in s)
    x[F["digits"]], x[F["plain_digits"]], x[F["letters"]], x[F["spaces"]] = n > 0, n == len(s), letters, spaced
    x[F["tokens"]] = n_tokens / pii.SPAN_TOKENS
    x[F["at"]] = at
    if at:
        local, _, domain = (p.strip() for p in s.partition("@"))
        x[F["at_spaced"]] = spaced
        x[F["domain"]] = bool(pii._DOMAIN.fullmatch(domain))
        x[F["local"]] = bool(local) and all(c in pii._LOCAL for c in local)
        x[F["email_form"]] = x[F["domain"]] and x[F["local"]]
    parts = s.replace(" ", "").split(".")
    four = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
    small = four and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    x[F["dots_3"]], x[F["octets"]], x[F["octets_bad"]], x[F["ip_form"]] = s.count(".") == 3, small, four and not small, small and n >= 4
    card = 14 <= n <= 19 and not letters and not at
    good = card and pii.luhn(digits)
    x[F["length_card"]], x[F["luhn"]], x[F["luhn_bad"]] = card, good, card and not good
    x[F["card_signs"]] = not letters and signs <= {"-"}
    groups = re.findall("[0-9]+", s)
    x[F["card_even"]] = card and len(groups) > 1 and all(len(g) == 4 for g in groups[:-1])
    x[F["card_luhn"]] = good and len(groups) <= 5 and signs <= {"-", ".", "/"} and (len(groups) == 1 or all(len(g) >= 3 for g in groups))
    x[F["length_phone"]] = 10 <= n <= 15 and not letters and not at
    x[F["plus"]], x[F["parens"]] = s[0] == "+" or s.startswith("00"), "(" in s and ")" in s
    x[F["split"]] = len(groups) in (3, 4, 5) and not letters
    x[F["phone_signs"]] = not letters and signs <= set("+().-/")
    x[F["phone_split"]] = x[F["length_phone"]] * x[F["split"]] * (x[F["plus"]] or x[F["parens"]]) * x[F["phone_signs"]]
    x[F["other_signs"]] = bool(signs - set("+().-@_%"))
    before, after = zone[a - 1 : a], zone[b : b + 1]
    x[F["glued_before"]], x[F["glued_after"]] = before.isalnum(), after.isalnum()
    x[F["sign_before"]], x[F["sign_after"]] = before in set("+@.-_=%"), after in set("@-_=%") or zone[b : b + 2][1:].isalnum() and after == "."
    return x


def span_tokens(zone: str) -> tuple[list, str]:
    """(token boundaries, a character for each token: s space, d digits, w letters, the sign itself, ? for a sign that no entity holds)."""
    cuts, kinds = [0], []
    for m in TOKEN.finditer(zone):
        cuts.append(m.end())
        c = m[0][0]
        kinds.append("s" if c.isspace() else "d" if "0" <= c <= "9" else "w" if c.isalnum() else c if c in "@._%+-()/" else "?")
    return cuts, "".join(kinds)


def spans_from(zone: str, cuts: list, kinds: str, i: int):
    """The candidates that begin at a token: with an at sign, or with three dots and digits of an address, or with the digits of a phone or card."""
    n = len(kinds)
    first = kinds[i]
    if first not in "dw+(._%-" or first in "._%-" and (i + 1 >= n or kinds[i + 1] not in "dw"):
        return
    at = digits = dots = 0
    j = i
    while j < n and j - i < pii.SPAN_TOKENS:
        kind = kinds[j]
        at += kind == "@"
        dots += kind == "."
        if at > 1 or kind == "?" or kind == "s" and (cuts[j + 1] - cuts[j] > 2 or "\n" in zone[cuts[j] : cuts[j + 1]]):
            return
        if kind == "s" and j > i and kinds[j - 1] == "w" and not at and (j + 1 >= n or kinds[j + 1] != "@"):
            return  # words in a row are no entity
        if kind == "d":
            digits += cuts[j + 1] - cuts[j]
            if digits > 19 and not at and "@" not in kinds[j + 1 : i + pii.SPAN_TOKENS]:
                return
        j += 1
        if kind in "dw" and (at or 10 <= digits <= 19 or dots == 3 and 4 <= digits):
            x = span_features(zone, cuts[i], cuts[j], j - i)
            if x is not None:
                yield i, j, x
