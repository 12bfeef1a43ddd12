"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

The model scores whole candidate spans, not single tokens: a span's features see its digits, separators, checksum and
edges at once. Dynamic programming over the token boundaries of a zone picks the best division into spans of one token
(outside) and entities of at most SPAN_TOKENS tokens, so boundaries and kinds are chosen together in linear time.
Zones are the surroundings of digits and at signs, from white space to white space; text without either can hold no
candidate and isn't tokenised. The candidates of some thousand starts, over many zones, are made and scored at a time as
arrays, so that a zone as long as its text, as a table of numbers is one, costs a few bytes a character and never all its
candidates at once.

There are no hand-made labels: the model is fitted on a bounded sample of zones that the patterns label, on variants of
these that keep a span's kind while leaving the patterns' form, and on spoilt ones that must not be found.
"""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm import _text

KINDS = ("email", "ip", "card", "phone")
#: Tokens of an entity, at most.
SPAN_TOKENS = 16
#: Zones that the model is fitted on, at most.
FIT_ZONES = 1_500
#: Longer zones aren't drawn for the fit.
FIT_ZONE_CHARS = 4_000
#: Characters of all zones that the model is fitted on, at most.
FIT_CHARS = 250_000
#: Characters around a trigger that belong to its zone.
AROUND = 40
#: What an added span must be better by than the best division without it, in log odds.
MARGIN = 1.0
#: Divisions whose scores differ by less are ties; the one whose last entity ends first is taken, then the longest.
TIE = 1e-9
#: Tokens whose candidates are made and scored at a time.
LOT = 4_096
#: Characters of zones that are tokenised at a time, about; a longer zone goes alone.
LOT_CHARS = 1 << 18

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")  # possessive: nothing follows that a shorter match could help
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from the at signs; linear in the text."""
    out, begin, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > begin and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((s, m.end()))
            begin = m.end()
            at = text.find("@", begin)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and kind."""
    out = [(a, b, "email") for a, b in _emails(text)]
    out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 37 and 14 <= len(d := _only_digits(m[0])) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    if "+" in text:
        out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(map(m[0].count, "0123456789")) <= 15]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


# --- the model


@dataclass(frozen=True)
class Zone:
    text: str
    start: int


def zones(text: str) -> list[Zone]:
    """The surroundings of triggers, widened to white space, so that no token is cut; such as overlap are one."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b, last = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND), out[-1][1] if out else 0
        if out and b <= last:
            continue
        while b < len(text) and not text[b].isspace():
            b += 1
        while a > last and not text[a - 1].isspace():
            a -= 1
        if out and a <= last:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [Zone(text[a:b], a) for a, b in out]


FEATURES = (
    "bias", "digits", "plain_digits", "at", "at_spaced", "domain", "local", "dots_3", "octets", "octets_bad", "length_card", "luhn", "luhn_bad", "length_phone", "plus", "parens", "split",
    "phone_signs", "card_signs", "letters", "spaces", "glued_before", "glued_after", "sign_before", "sign_after", "tokens", "other_signs", "card_even", "phone_split", "card_luhn", "ip_form", "email_form",
)
_F = {f: k for k, f in enumerate(FEATURES)}


#: What a character is to a token: s space, d digit, w letter or the like, the sign itself, ? a sign that no entity holds; 0 parts zones.
_PART, _SPACE, _DIGIT, _WORD, _NONE = 0, ord("s"), ord("d"), ord("w"), ord("?")
_SIGNS = "@._%+-()/"


def _kind(c: str) -> int:
    return _SPACE if c.isspace() else _DIGIT if "0" <= c <= "9" else _WORD if c.isalnum() else ord(c) if c in _SIGNS else _NONE


_ASCII = np.array([_kind(chr(c)) for c in range(128)], dtype=np.uint8)
#: Signs that glue a span to what stands before it, and after it.
_SIGN_BEFORE, _SIGN_AFTER = (np.array([chr(c) in signs for c in range(128)]) for signs in ("+@.-_=%", "@-_=%"))


class _Scan:
    """Tokens of many zones on one axis, and their candidate spans with features, a lot of starts at a time.

    Zones are joined by a separator that no span crosses. Counts over a span are differences of running sums over the
    tokens of a lot, so a candidate costs the same whatever its length.
    """

    def __init__(self, zones: list[str]):
        self.codes = np.frombuffer("".join(z + "\n" for z in zones).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        kinds = _ASCII[np.minimum(self.codes, 127)]
        self.alpha = kinds == _WORD
        far = np.flatnonzero(self.codes > 127)
        if len(far):
            own, number = np.unique(self.codes[far], return_inverse=True)
            kinds[far] = np.array([_kind(chr(c)) for c in own.tolist()], dtype=np.uint8)[number]
            self.alpha[far] = np.array([chr(c).isalpha() for c in own.tolist()])[number]
        self.ends = np.cumsum([len(z) + 1 for z in zones]) - 1
        kinds[self.ends] = _PART
        begins = np.ones(len(kinds), dtype=bool)
        begins[1:] = (kinds[1:] != kinds[:-1]) | ~np.isin(kinds[1:], (_SPACE, _DIGIT, _WORD))
        self.cuts = np.append(np.flatnonzero(begins), len(kinds))
        self.char_kinds, self.kinds = kinds, kinds[self.cuts[:-1]]

    def lot(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first token, token behind the last, features x candidates) of the spans that begin at tokens lo to hi, by begin and end."""
        stop = min(len(self.kinds), hi + SPAN_TOKENS + 1)
        begin, end = self._spans(lo, hi, stop)
        return begin + lo, end + lo, self._features(lo, stop, begin, end)

    def _spans(self, lo: int, hi: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Candidates: with an at sign, or with three dots and digits of an address, or with the digits of a phone or card."""
        k, cuts = self.kinds[lo:stop], self.cuts[lo : stop + 1]
        n, size = len(k), np.diff(cuts)
        after = np.append(k[1:], self.kinds[stop] if stop < len(self.kinds) else _PART)
        word, space = k == _WORD, k == _SPACE
        ends_all = (k == _NONE) | (k == _PART) | space & ((size > 2) | (self.codes[cuts[:-1]] == 10) | (self.codes[cuts[1:] - 1] == 10))
        words_in_a_row = space & np.append(False, word[:-1]) & (after != ord("@"))  # no entity without an at sign
        behind = lambda flag: np.append(np.minimum.accumulate(np.where(flag, np.arange(n), n)[::-1])[::-1], n)
        next_at, zone_end = behind(k == ord("@")), behind(k == _PART)
        first = word | (k == _DIGIT) | np.isin(k, np.frombuffer(b"+(", np.uint8)) | np.isin(k, np.frombuffer(b"._%-", np.uint8)) & ((after == _DIGIT) | (after == _WORD))
        i = np.flatnonzero(first[: hi - lo])
        at = digits = dots = np.zeros(len(i), dtype=np.int64)
        begins, ends = [], []
        for step in range(SPAN_TOKENS):
            if not len(i):
                break
            j = i + step
            kind = k[j]
            digit = kind == _DIGIT
            at, dots, digits = at + (kind == ord("@")), dots + (kind == ord(".")), digits + np.where(digit, size[j], 0)
            on = ~ends_all[j] & (at <= 1)
            if step:
                on &= ~(words_in_a_row[j] & (at == 0))
            on &= ~(digit & (digits > 19) & (at == 0) & (next_at[j + 1] >= np.minimum(i + SPAN_TOKENS, zone_end[i])))
            i, at, dots, digits, edge = i[on], at[on], dots[on], digits[on], (digit | (kind == _WORD))[on]
            some = edge & ((at > 0) | (digits >= 10) & (digits <= 19) | (dots == 3) & (digits >= 4))
            begins.append(i[some])
            ends.append(i[some] + step + 1)
        begin, end = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (begins, ends))
        order = np.argsort(begin * (SPAN_TOKENS + 1) + end - begin)
        return begin[order], end[order]

    def _features(self, lo: int, stop: int, b: np.ndarray, e: np.ndarray) -> np.ndarray:
        """What whole candidate spans look like."""
        x = np.zeros((len(FEATURES), len(b)))
        if not len(b):
            return x
        k, cuts = self.kinds[lo:stop], self.cuts[lo : stop + 1]
        size, codes = np.diff(cuts), self.codes[cuts[0] : cuts[-1]]
        at_char = cuts[:-1] - cuts[0]

        def running(values: np.ndarray) -> np.ndarray:
            out = np.zeros(len(values) + 1, dtype=np.int64)
            np.cumsum(values, out=out[1:])
            return out

        def within(values: np.ndarray) -> np.ndarray:
            sums = running(values)
            return sums[e] - sums[b]

        def put(name: str, values) -> None:
            x[_F[name]] = values

        digit, dot, space, word = k == _DIGIT, k == ord("."), k == _SPACE, k == _WORD
        ascii_word = word & (np.maximum.reduceat(codes, at_char) < 128)
        digits_to = running(np.where(digit, size, 0))
        figures = codes[(codes >= 48) & (codes <= 57)].astype(np.int64) - 48
        d0, d1 = digits_to[b], digits_to[e]
        n = d1 - d0
        # a span's counts of each sign, of spaces and of letters are at most SPAN_TOKENS, so five bits of one sum hold each
        shift = {c: 5 * t for t, c in enumerate(_SIGNS)}
        packed = (space.astype(np.int64) << 45) + (np.logical_or.reduceat(self.alpha[cuts[0] : cuts[-1]], at_char).astype(np.int64) << 50)
        for c, bits in shift.items():
            packed += (k == ord(c)).astype(np.int64) << bits
        packed = within(packed)
        holds = lambda signs: packed & sum(31 << shift[c] for c in signs) != 0
        plain = packed & (31 << 50) == 0
        letters, spaced, three_dots = ~plain, packed & (31 << 45) != 0, (packed >> shift["."]) & 31 == 3
        at = holds("@")
        put("bias", 1)
        put("digits", n > 0)
        put("plain_digits", n == cuts[e] - cuts[b])
        put("letters", letters)
        put("spaces", spaced)
        put("tokens", (e - b) / SPAN_TOKENS)
        put("at", at)
        rows = np.flatnonzero(at)
        if len(rows):
            ats = np.flatnonzero(k == ord("@"))
            p = ats[np.searchsorted(ats, b[rows])]
            behind, ahead = p + 1 + space[p + 1], p - space[p - 1]
            in_domain, in_local = running(digit | ascii_word | dot | (k == ord("-"))), running(digit | ascii_word | np.isin(k, np.frombuffer(b"._%+-", np.uint8)))
            dots, pairs = running(dot), running(np.append(False, dot[1:] & dot[:-1]))
            end = e[rows]
            domain = (in_domain[end] - in_domain[behind] == end - behind) & (dots[end] > dots[behind]) & ~dot[behind] & (pairs[end] == pairs[behind + 1])
            local = in_local[ahead] - in_local[b[rows]] == ahead - b[rows]
            x[_F["at_spaced"], rows], x[_F["domain"], rows], x[_F["local"], rows], x[_F["email_form"], rows] = spaced[rows], domain, local, domain & local
        put("dots_3", three_dots)
        blank = space & (codes[at_char] == 32) & (codes[cuts[1:] - 1 - cuts[0]] == 32)
        rows = np.flatnonzero(three_dots & plain & ~holds("@_%+-()/"))
        in_ip = running(digit | dot | blank)
        rows = rows[in_ip[e[rows]] - in_ip[b[rows]] == (e - b)[rows]]
        if len(rows):
            places = np.flatnonzero(dot)
            nth = np.searchsorted(places, b[rows])
            borders = [b[rows], *(places[nth + t] for t in range(3)), e[rows]]
            four = small = np.ones(len(rows), dtype=bool)
            for left, right in zip(borders, borders[1:]):
                u, v = digits_to[left], digits_to[right]
                value = sum(10**t * np.where(v - u > t, figures[np.maximum(v - 1 - t, 0)], 0) for t in range(3))
                four, small = four & (v > u), small & (v - u <= 3) & (value <= 255)
            x[_F["octets"], rows], x[_F["octets_bad"], rows], x[_F["ip_form"], rows] = four & small, four & ~small, four & small & (n[rows] >= 4)
        card = (n >= 14) & (n <= 19) & plain & ~at
        rows = np.flatnonzero(card)
        u, v = d0[rows], d1[rows]
        doubled = figures * 2 - 9 * (figures > 4)
        even = np.arange(len(figures)) % 2 == 0
        sums = running(np.where(even, figures, doubled)), running(np.where(even, doubled, figures))
        good = np.zeros(len(b), dtype=bool)
        good[rows] = np.where(v % 2 == 1, sums[0][v] - sums[0][u], sums[1][v] - sums[1][u]) % 10 == 0
        put("length_card", card)
        put("luhn", good)
        put("luhn_bad", card & ~good)
        put("card_signs", plain & ~holds("@._%+()/"))
        group_to = running(digit)
        g0, g1 = group_to[b], group_to[e]
        groups, lengths = g1 - g0, size[digit]
        fours, threes = running(lengths == 4), running(lengths >= 3)
        put("card_even", card & (groups > 1) & (fours[np.maximum(g1 - 1, g0)] - fours[g0] == groups - 1))
        put("card_luhn", good & (groups <= 5) & ~holds("@_%+()") & ((groups == 1) | (threes[g1] - threes[g0] == groups)))
        phone = (n >= 10) & (n <= 15) & plain & ~at
        left, right = cuts[b], cuts[e]
        zeros = digit & (size > 1) & (codes[at_char] == 48) & (codes[np.minimum(at_char + 1, len(codes) - 1)] == 48)
        plus, parens = (k[b] == ord("+")) | zeros[b], holds("(") & holds(")")
        split, phone_signs = (groups >= 3) & (groups <= 5) & plain, plain & ~holds("@_%")
        put("length_phone", phone)
        put("plus", plus)
        put("parens", parens)
        put("split", split)
        put("phone_signs", phone_signs)
        put("phone_split", phone & split & (plus | parens) & phone_signs)
        put("other_signs", holds("/"))
        last = len(self.codes) - 1
        ahead, behind, second = np.maximum(left - 1, 0), right, np.minimum(right + 1, last)
        some = left > 0
        alnum = lambda at_: (self.char_kinds[at_] == _DIGIT) | (self.char_kinds[at_] == _WORD)
        near = lambda signs, at_: signs[np.minimum(self.codes[at_], 127)]
        put("glued_before", some & alnum(ahead))
        put("glued_after", alnum(behind))
        put("sign_before", some & near(_SIGN_BEFORE, ahead))
        put("sign_after", near(_SIGN_AFTER, behind) | (self.codes[behind] == ord(".")) & alnum(second))
        return x


def candidates(zone: str) -> tuple[list[int], list[tuple[int, int, np.ndarray]]]:
    """(token boundaries, candidate spans as token numbers with features). A span begins and ends with no space, nor ends with a sign."""
    scan = _Scan([zone])
    begin, end, x = scan.lot(0, len(scan.kinds))
    return scan.cuts[:-1].tolist(), list(zip(begin.tolist(), end.tolist(), np.ascontiguousarray(x.T)))


@dataclass
class Model:
    """weights: kinds x features; an outside token scores 0."""

    weights: np.ndarray

    def divide(self, zone: str) -> list[tuple[int, int, str]]:
        """The best division's entities as (start, end, kind) in the zone."""
        return self.divide_all([zone])[0]

    def divide_all(self, zones: list[str]) -> list[list[tuple[int, int, str]]]:
        """The best division of each zone. Spans that score nothing above outside tokens can't be in it, so only the others are joined up."""
        out: list[list[tuple[int, int, str]]] = [[] for _ in zones]
        if not zones:
            return out
        scan, parts = _Scan(zones), []
        for lo in range(0, len(scan.kinds), LOT):
            begin, end, x = scan.lot(lo, min(lo + LOT, len(scan.kinds)))
            if len(begin):
                scores = self.weights @ x - MARGIN
                value = scores.max(axis=0)
                good = value > 0
                parts.append((begin[good], end[good], scores[:, good].argmax(axis=0), value[good]))
        if not any(len(p[0]) for p in parts):
            return out
        begin, end, label, value = (np.concatenate(c) for c in zip(*parts))
        places, number = np.unique(np.concatenate([begin, end]), return_inverse=True)
        m = len(begin)
        best, back = [0.0] * len(places), [-1] * len(places)
        done = 0  # candidates come by their begin
        starts, stops, gains = number[:m].tolist(), number[m:].tolist(), value.tolist()
        for s in range(len(places)):
            if s and best[s - 1] >= best[s] - TIE:  # the best division up to here ends outside an entity
                best[s], back[s] = best[s - 1], -1
            while done < m and starts[done] == s:
                e = stops[done]
                if best[s] + gains[done] > best[e] + TIE:
                    best[e], back[e] = best[s] + gains[done], done
                done += 1
        j = len(places) - 1
        while j >= 0:
            at = back[j]
            if at < 0:
                j -= 1
            else:
                a, b = int(scan.cuts[begin[at]]), int(scan.cuts[end[at]])
                z = int(np.searchsorted(scan.ends, a))
                first = int(scan.ends[z - 1]) + 1 if z else 0
                out[z].append((a - first, b - first, KINDS[label[at]]))
                j = starts[at]
        return [o[::-1] for o in out]


def _variants(zone: str, gold: list[tuple[int, int, str]], rng: random.Random) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The zone with other forms of its entities (still to be found), and with spoilt ones (not to be found)."""

    def digits(k: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(k))

    def other(s: str, kind: str) -> str:
        if kind == "email":
            return s.replace("@", rng.choice((" @ ", "@ ", " @")), 1)
        if kind == "ip":
            return s.replace(".", rng.choice((" . ", ". ")))
        if kind == "card":
            d = _only_digits(s)
            return rng.choice((".", "/", " - ")).join(d[k : k + 4] for k in range(0, len(d), 4))
        d = _only_digits(s)[-10:]
        return rng.choice((f"({d[:3]}) {d[3:6]}-{d[6:]}", f"({d[:3]}) {d[3:6]} {d[6:]}", f"001 {d[:3]} {d[3:6]} {d[6:]}", f"+1/{d[:3]}/{d[3:6]}/{d[6:]}"))

    def spoilt(s: str, kind: str) -> str:
        if kind == "email":
            return rng.choice((s.replace("@", " "), s.partition("@")[0] + "@", "@" + digits(4)))
        if kind == "ip":
            return rng.choice((f"{rng.randint(256, 999)}.{rng.randint(256, 999)}.{digits(2)}.{digits(3)}", f"{digits(1)}.{digits(1)}.{digits(2)}", f"{digits(2)}.{digits(2)}.{digits(4)}"))
        if kind == "card":
            d = _only_digits(s)
            return rng.choice((d[:-1] + str((int(d[-1]) + 1) % 10), digits(8), digits(9), f"{digits(4)}-{digits(2)}-{digits(2)} {digits(2)}:{digits(2)}"))
        return rng.choice((digits(10), digits(7), f"{digits(4)}-{digits(4)}", f"{digits(3)}, {digits(3)}, {digits(4)}", f"{digits(4)} {digits(4)} {digits(4)}", f"({digits(4)})", f"{digits(1)},{digits(3)},{digits(3)}.{digits(2)}"))

    out = []
    for change, keeps in ((other, True), (spoilt, False)) * 2:
        text, spans, last = "", [], 0
        for a, b, kind in gold:
            if a < last:
                continue
            new = change(zone[a:b], kind)
            text += zone[last:a]
            if keeps:
                spans.append((len(text), len(text) + len(new), kind))
            text, last = text + new, b
        out.append((text + zone[last:], spans))
    return out


def _log_sum(one: float, others: list[float]) -> float:
    """log of the sum of exp; a few numbers each, so plain floats are faster than arrays."""
    if not others:
        return one
    top = max(one, max(others))
    return top + math.log(math.exp(one - top) + sum([math.exp(v - top) for v in others]))


def fit_zones(texts: list[str], epochs: int = 8, rate: float = 0.3, l2: float = 1e-3, seed: int = 7) -> Model:
    """A model by stochastic gradient of the conditional likelihood, on zones that the patterns label and variants of them.

    Without a zone it knows the built-in examples only, one for each kind.
    """
    rng = random.Random(seed)
    built_in = ["write to ann.lee@mail.example.org today", "host 10.20.30.40 is up", "card 4111 1111 1111 1111 was used", "call +1 (202) 555-0143 now"]
    cases = []
    for z in [*sorted(texts), *built_in * 5]:
        gold, last = [], 0
        for a, b, kind in base_spans(z):
            if a >= last:
                gold.append((a, b, kind))
                last = b
        cases.append((z, gold))
        if gold:
            cases += _variants(z, gold, rng)
    ready = []
    for z, gold in cases:
        cuts, spans = candidates(z)
        if not spans:
            continue
        place = {c: k for k, c in enumerate(cuts)}
        number = {(i, j): k for k, (i, j, _) in enumerate(spans)}
        truth = [(number.get((place.get(a), place.get(b))), KINDS.index(kind)) for a, b, kind in gold]
        if all(k is not None for k, _ in truth):
            starts: list[list[int]] = [[] for _ in cuts]
            ends: list[list[int]] = [[] for _ in cuts]
            for k, (i, j, _) in enumerate(spans):
                starts[i].append(k)
                ends[j].append(k)
            ready.append((np.array([s[0] for s in spans]), np.array([s[1] for s in spans]), np.stack([s[2] for s in spans]), starts, ends, truth))
    w = np.zeros((len(KINDS), len(FEATURES)))
    w[:, 0] = -3
    square = np.full_like(w, 1e-6)
    for _ in range(epochs):
        rng.shuffle(ready)
        for begin, end, x, starts, ends, truth in ready:
            score = x @ w.T
            whole = np.logaddexp.reduce(score, axis=1).tolist()  # a span as any kind
            n, first, last = len(starts), begin.tolist(), end.tolist()
            ahead, behind = [0.0] * n, [0.0] * n
            for j in range(1, n):
                ahead[j] = _log_sum(ahead[j - 1], [ahead[first[k]] + whole[k] for k in ends[j]])
            for i in range(n - 2, -1, -1):
                behind[i] = _log_sum(behind[i + 1], [behind[last[k]] + whole[k] for k in starts[i]])
            ahead, behind = np.array(ahead), np.array(behind)
            p = np.exp(np.minimum(ahead[begin][:, None] + score + behind[end][:, None] - ahead[-1], 0))
            g = -(p.T @ x)
            for k, kind in truth:
                g[kind] += x[k]
            g -= l2 * w
            square += g * g
            w += rate * g / np.sqrt(square)
    return Model(w)


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", fit_zones_most: int = FIT_ZONES) -> Model:
    """A model fitted on about `fit_zones_most` zones and FIT_CHARS characters at most, drawn by hash; empty and null texts teach nothing."""
    rows = docs.select(F.col(text).cast("string").alias("text"), F.xxhash64(key, text).alias("h")).where(F.col("text").rlike("[0-9@]"))
    n = docs.count()
    drawn = rows.where(F.pmod("h", F.lit(1_000_000)) < min(1.0, 4 * fit_zones_most / max(n, 1)) * 1_000_000)

    def cut(batches):
        for batch in batches:
            got = [(z.text, hash_of(z.text)) for t in batch.column(0) for z in zones(t.as_py()) if len(z.text) <= FIT_ZONE_CHARS]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64())], ["zone", "h"])

    def hash_of(s: str) -> int:
        import xxhash

        return xxhash.xxh64_intdigest(s) >> 1

    found = drawn.select("text").mapInArrow(cut, "zone string, h long").orderBy("h", "zone").limit(fit_zones_most)
    taken, left = [], FIT_CHARS
    for r in found.collect():
        left -= len(r["zone"])
        if left < 0:
            break
        taken.append(r["zone"])
    return fit_zones(taken)


def evaluate(model: Model, texts: list[str], seed: int) -> dict[str, tuple[float, float, int]]:
    """(precision, recall, cases) of each kind, and of all, on variants of the patterns' finds in texts that the model wasn't fitted on.

    An entity counts as found if one span of its kind has its very borders. Other spans that the model says are wrong,
    those in spoilt variants among them.
    """
    rng = random.Random(seed)
    hit, said, gold = ({k: 0 for k in KINDS} for _ in range(3))
    for text in texts:
        base = []
        for a, b, kind in base_spans(text):
            if not base or a >= base[-1][1]:
                base.append((a, b, kind))
        for a, b, kind in base:
            left, right = max(0, a - 60), b + 60
            while left > 0 and not text[left - 1].isspace():
                left -= 1
            around = text[left:right]
            for changed, wanted in _variants(around, [(a - left, b - left, kind)], rng)[:2]:
                found = [(x, y, k) for x, y, k, _ in all_spans(changed, model)]
                for w in wanted:
                    gold[w[2]] += 1
                    hit[w[2]] += w in found
                # neighbours that the text holds anyway aren't judged
                own = (a - left, a - left + max(len(changed) - len(around) + b - a, 0))
                for x, y, k in found:
                    if x < own[1] and y > own[0]:
                        said[k] += 1
    rate = lambda n, of: n / of if of else 1.0
    out = {k: (rate(hit[k], said[k]), rate(hit[k], gold[k]), gold[k]) for k in KINDS}
    return out | {"all": (rate(sum(hit.values()), sum(said.values())), rate(sum(hit.values()), sum(gold.values())), sum(gold.values()))}


def all_spans(text: str, model: Model) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, base) of a whole text: all of the patterns' spans and those of the model's that touch none of them."""
    return spans_of([text], model)[0]


def spans_of(texts: list[str], model: Model) -> list[list[tuple[int, int, str, bool]]]:
    """all_spans of each text; the zones of several texts are worked together, in lots of about LOT_CHARS characters."""
    base = [base_spans(t) for t in texts]
    out = [[(*s, True) for s in own] for own in base]
    lot: list[tuple[int, Zone]] = []

    def added() -> None:
        for (d, zone), found in zip(lot, model.divide_all([z.text for _, z in lot])):
            for a, b, kind in found:
                a, b = a + zone.start, b + zone.start
                if not any(a < y and x < b for x, y, _ in _near(base[d], a, b)):
                    out[d].append((a, b, kind, False))
        lot.clear()

    held = 0
    for d, text in enumerate(texts):
        for zone in zones(text):
            lot.append((d, zone))
            held += len(zone.text)
            if held >= LOT_CHARS:
                added()
                held = 0
    added()
    return [sorted(own, key=lambda x: (x[0], KINDS.index(x[2]), x[1])) for own in out]


def _near(base: list[tuple[int, int, str]], a: int, b: int) -> list[tuple[int, int, str]]:
    """The spans that begin before b, from the last few that could reach a."""
    from bisect import bisect_left

    k = bisect_left(base, b, key=lambda s: s[0])
    out = []
    while k > 0:
        k -= 1
        out.append(base[k])
        if base[k][1] <= a and len(out) > 8:
            break
    return out


def find(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and spans array<struct<kind, start, end, base>> of every whole text, in code points, end exclusive.

    By start, then kind. A text that is null, empty or without finds has an empty array. Rows are judged one by one.
    """
    names = [f"k{i}" for i in range(len(keep))]
    kinds = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
    hot = np.zeros(256, dtype=bool)
    hot[[*range(0x30, 0x3A), 0x40]] = True

    def run(batches):
        for batch in batches:
            data, offsets = _text.flat(batch.column(len(names)))
            for i, j in _text.pieces(offsets):
                places = np.flatnonzero(hot[data[offsets[i] : offsets[j]]]) + offsets[i]
                some = np.diff(np.searchsorted(places, offsets[i : j + 1])) > 0
                texts = [bytes(data[offsets[d] : offsets[d + 1]]).decode("utf-8", "replace") if holds else "" for d, holds in zip(range(i, j), some.tolist())]
                out = [[{"kind": k, "start": a, "end": b, "base": own} for a, b, k, own in found] for found in spans_of(texts, sent.value)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[i:j] for c in range(len(names))), pa.array(out, struct)], [*names, "spans"])
        _text.released()

    out = docs.select(*(F.col(c).alias(n) for n, c in zip(names, keep)), F.col(text).cast("string").alias("text")).mapInArrow(run, f"{kinds}, spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, keep)), "spans")


def masked(text, spans):
    """The text with each span replaced by its kind in angle brackets; spans that overlap one before are swallowed by it.

    An expression over a text column and the spans of find().
    """
    done = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("to")),
        lambda s, x: F.when(x["end"] <= s["to"], s).otherwise(
            F.struct(
                F.when(x["start"] < s["to"], s["out"]).otherwise(F.concat(s["out"], F.substring(text, (s["to"] + 1).cast("int"), (x["start"] - s["to"]).cast("int")), F.lit("<"), F.upper(x["kind"]), F.lit(">"))).alias("out"),
                x["end"].alias("to"),
            )
        ),
    )
    return F.when(F.size(spans) > 0, F.concat(done["out"], F.substring(text, (done["to"] + 1).cast("int"), F.length(text)))).otherwise(text)


def joined(spans):
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
