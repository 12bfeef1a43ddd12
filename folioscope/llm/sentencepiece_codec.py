"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

All distinct words of a batch lie in one flat numpy array of symbols. A round finds the places whose pair is sure to be
the next thing that happens to its two symbols, merges them all at once, closes the gaps and ranks only the pairs next
to a merged place anew; words without a mergeable pair leave the array. Rounds go on until no word is left.

The result equals the library's, which merges one pair at a time, best score first and leftmost on ties. A pair is
sure if no pair that could still form over its left or right border is ranked before it: those ranks depend on the
neighbour only through its text, so they are tables by (neighbour, symbol). Where equal pairs follow one another every
second one is sure if the one before is. Merging a sure pair early changes nothing, as long as no pair of the new
piece is ranked before it, which the same tables tell. A word without a sure place merges the first of its best
(the segmented minimum of its ranks); a long word that comes to that goes on with a queue of its pairs instead, so
work stays n log n for texts without a space.

Words are the maximal parts that no piece of the vocabulary crosses, so a word's pieces don't depend on its neighbours.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from folioscope.llm import _text

SPACE = "▁"

#: Distinct words that a Python worker remembers with their pieces, and how long a remembered word is at most; bounds of memory, not of the result.
CACHE_WORDS, CACHE_CHARS = 300_000, 64
#: Symbols from which a word without a sure place is finished by a queue.
LONG_WORD = 256
#: Characters of a text that are digested at a time.
PART_CHARS = 1 << 20


class Codec:
    """Encoder and decoder of one BPE model with byte fallback, identity normalisation and a leading space."""

    def __init__(self, model_file: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = len(lib)
        pieces = [lib.id_to_piece(i) for i in range(n)]
        self.n_vocab, self.eos, self.unk = n, lib.eos_id(), lib.unk_id()
        special = {i for i in range(n) if lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i)}
        byte_id = {int(pieces[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        self.byte_ids = np.array([byte_id[b] for b in range(256)], dtype=np.int64)
        self.normal = {p: i for i, p in enumerate(pieces) if i not in special}
        score = {p: lib.get_score(i) for p, i in self.normal.items()}

        # symbols: the pieces, then characters that stand in pieces without being one
        symbol = dict(self.normal)
        for p in self.normal:
            for ch in p:
                symbol.setdefault(ch, n + len(symbol))
        self.n_symbols = max(symbol.values()) + 1
        self.char_symbol = np.full(0x110000, -1, dtype=np.int32)
        for s, k in symbol.items():
            if len(s) == 1:
                self.char_symbol[ord(s)] = k
        rank_of = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.worst = len(rank_of) + 1
        pairs = []
        for p, k in self.normal.items():
            for cut in range(1, len(p)):
                a, b = symbol.get(p[:cut]), symbol.get(p[cut:])
                if a is not None and b is not None:
                    pairs.append((a * self.n_symbols + b, rank_of[score[p]], k))
        pairs.sort()
        table = np.array(pairs, dtype=np.int64).reshape(-1, 3)
        self.pairs = _Lookup(table[:, 0], table[:, 1], self.worst)
        self.pair_piece = np.ascontiguousarray(table[:, 2])
        # the best rank of a pair (x, b) whose x ends with a symbol, and of a pair (a, y) whose y begins with one
        left, right = table[:, 0] // self.n_symbols, table[:, 0] % self.n_symbols
        ends = _expanded({k: [symbol[p[j:]] for j in range(len(p)) if p[j:] in symbol] for p, k in symbol.items()}, self.n_symbols)
        begins = _expanded({k: [symbol[p[:j]] for j in range(1, len(p) + 1) if p[:j] in symbol] for p, k in symbol.items()}, self.n_symbols)
        row, part = _spread(left, ends)
        self.before = _Lookup(part * self.n_symbols + right[row], table[row, 1], self.worst)
        row, part = _spread(right, begins)
        self.after = _Lookup(left[row] * self.n_symbols + part, table[row, 1], self.worst)

        inner = {p for p in self.normal if SPACE in p.lstrip(SPACE)}
        if inner:
            raise ValueError("the model has pieces across words, so words can't be encoded on their own")
        alone = "".join(c for c in "\n\t" if not any(c in p and len(p) > 1 for p in self.normal))
        stop = re.escape(alone)
        self.word = re.compile(f"{SPACE}*[^{SPACE}{stop}]+|{SPACE}+" + (f"|[{stop}]" if alone else ""))

        self.piece_bytes: list[bytes | int | None] = []  # a byte piece's value as an int, none for control pieces
        for i, p in enumerate(pieces):
            if lib.is_byte(i):
                self.piece_bytes.append(int(p[3:5], 16))
            elif lib.is_control(i):
                self.piece_bytes.append(None)
            elif lib.is_unknown(i):
                self.piece_bytes.append(" ⁇ ".encode())
            else:
                self.piece_bytes.append(p.replace(SPACE, " ").encode())
        self.id_text = [p.decode() if isinstance(p, bytes) else "" for p in self.piece_bytes]
        self.is_byte = np.array([isinstance(p, int) for p in self.piece_bytes])
        self.shown = _Strings([bytes([p]) if isinstance(p, int) else p or b"" for p in self.piece_bytes])
        self.spaced = np.array([t.startswith(" ") and k != self.unk for k, t in enumerate(self.id_text)])
        self.named = _Strings([f"{i} ".encode() for i in range(n)])
        self._forget()

    def _forget(self) -> None:
        """Empties the store of known words: a word's number, and the numbers' ids in one array."""
        self.known: dict[str, int] = {}
        self.known_ids, self.known_at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair of symbols, the worst where they don't merge, and its place in the table of pairs."""
        return self.pairs.find(left * self.n_symbols + right, (left >= 0) & (right >= 0))

    def _border(self, table: _Lookup, left: np.ndarray, right: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """The best rank of what could form over a border; the worst where there's no border inside a word."""
        return table.find(left * self.n_symbols + right, inside & (left >= 0) & (right >= 0))[0]

    def _sure(self, sym: np.ndarray, word: np.ndarray, rank: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of the places (one in each, ascending) are sure to merge, taking every second one of a run of equal neighbours."""
        n = len(sym)
        place = rank[at]
        # runs of neighbouring places of one rank, and a place's number in its run
        joins = np.zeros(len(at), dtype=bool)
        joins[1:] = (at[1:] == at[:-1] + 1) & (place[1:] == place[:-1]) & (word[at[1:]] == word[at[:-1]])
        head = np.flatnonzero(~joins)
        run = np.cumsum(~joins) - 1
        number = np.arange(len(at)) - head[run]
        even = number % 2 == 0
        at, run, number, place = at[even], run[even], number[even], place[even]
        merged = self.pair_piece[self._ranks(sym[at], sym[at + 1])[1]]
        chained = number > 0  # the place two before is in the same run; its piece stands on the left
        before = np.where(at > 0, at - 1, 0)
        left_in = (at > 0) & (word[before] == word[at])
        left = np.where(chained, np.append(0, merged[:-1]), sym[before])
        behind = np.minimum(at + 2, n - 1)
        right_in = (at + 2 < n) & (word[behind] == word[at])
        right = sym[behind]
        ok = self._border(self.before, left, sym[at], left_in) > place
        ok &= self._border(self.after, sym[at + 1], right, right_in) >= place
        ok &= self._border(self.before, left, merged, left_in) > place
        ok &= self._border(self.after, merged, right, right_in) > place
        # a place in a run is sure only if all before it are
        bad = np.cumsum(~ok)
        first = np.append(True, run[1:] != run[:-1]) if len(run) else np.zeros(0, bool)
        start = np.maximum.accumulate(np.where(first, np.arange(len(run)), 0)) if len(run) else run
        return at[ok & (bad == bad[start] - (~ok)[start])] if len(run) else at

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of words that already have their space marks; every word has a character at least."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        sym = self.char_symbol[chars].astype(np.int64)
        sym = np.where(sym < 0, -2 - chars, sym)  # an unknown character, kept as itself for the byte pieces
        word = np.repeat(np.arange(len(words)), lengths)
        done_sym, done_word = [], []
        rank = np.full(len(sym), self.worst, dtype=np.int64)  # of each symbol with the next
        fresh = np.arange(max(len(sym) - 1, 0))
        while len(sym):
            fresh = fresh[word[fresh] == word[fresh + 1]]
            rank[fresh] = self._ranks(sym[fresh], sym[fresh + 1])[0]
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(begin, len(sym)))
            best = np.minimum.reduceat(rank, begin)
            over = best == self.worst
            # a sure place is ranked before its left neighbour, or goes on a run, and no worse than its right one
            low = rank < self.worst
            low[1:] &= rank[1:] <= np.where(word[1:] == word[:-1], rank[:-1], self.worst)
            low[:-1] &= rank[:-1] <= rank[1:]
            at = self._sure(sym, word, rank, np.flatnonzero(low)) if low.any() else np.zeros(0, np.int64)
            moved = np.zeros(len(begin), dtype=bool)
            number = np.cumsum(np.append(True, word[1:] != word[:-1])) - 1
            moved[number[at]] = True
            stuck = np.flatnonzero(~moved & ~over)
            keep = np.ones(len(sym), dtype=bool)
            if len(stuck):
                single = [int(begin[w] + rank[begin[w] : begin[w] + size[w]].argmin()) for w in stuck if size[w] < LONG_WORD]
                at = np.concatenate([at, np.array(single, dtype=np.int64)])
                for w in stuck[size[stuck] >= LONG_WORD]:
                    own = slice(begin[w], begin[w] + size[w])
                    rest = self._queued(sym[own].tolist())
                    done_sym.append(np.array(rest, dtype=np.int64))
                    done_word.append(np.full(len(rest), word[begin[w]]))
                    keep[own] = False
            sym[at] = self.pair_piece[self._ranks(sym[at], sym[at + 1])[1]]
            gone = at + 1
            rank[at] = self.worst
            new = np.zeros(len(sym) + 1, dtype=bool)
            new[at] = new[np.maximum(at - 1, 0)] = True
            rank[np.flatnonzero(new[:-1])] = self.worst
            keep[gone] = False
            if over.any():
                end = np.repeat(over, size)
                done_sym.append(sym[end])
                done_word.append(word[end])
                keep &= ~end
            sym, word, rank = sym[keep], word[keep], rank[keep]
            fresh = np.flatnonzero(new[:-1][keep])
            fresh = fresh[fresh + 1 < len(sym)]
        sym = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int64)
        word = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        return self._fallback(sym[order], word[order], len(words))

    def _queued(self, sym: list[int]) -> list[int]:
        """The symbols of one word merged to the end, one pair at a time from a queue of pairs."""
        import heapq

        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def looked(left: list[int], right: list[int]) -> tuple[list[int], list[int]]:
            rank, place = self._ranks(np.array(left, dtype=np.int64), np.array(right, dtype=np.int64))
            return rank.tolist(), place.tolist()

        known: dict[tuple[int, int], tuple[int, int]] = {}

        def one(a: int, b: int) -> tuple[int, int]:
            if (a, b) not in known:
                known[a, b] = tuple(x[0] for x in looked([a], [b]))
            return known[a, b]

        rank, _ = looked(sym[:-1], sym[1:])
        queue = [(r, i, sym[i], sym[i + 1]) for i, r in enumerate(rank) if r < self.worst]
        heapq.heapify(queue)
        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i] = int(self.pair_piece[one(a, b)[1]])
            sym[j] = None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (got := one(sym[x], sym[y]))[0] < self.worst:
                    heapq.heappush(queue, (got[0], x, sym[x], sym[y]))
        return [s for s in sym if s is not None]

    def _fallback(self, sym: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols to ids: characters that are no piece become their UTF-8 bytes."""
        odd = np.flatnonzero((sym < 0) | (sym >= self.n_vocab))
        if len(odd):
            outside = {int(k): chr(c) for c, k in enumerate(self.char_symbol.tolist()) if k >= self.n_vocab} if (sym >= self.n_vocab).any() else {}
            raw = [(chr(-2 - int(s)) if s < 0 else outside[int(s)]).encode("utf-8", "surrogatepass") for s in sym[odd]]
            count = np.ones(len(sym), dtype=np.int64)
            count[odd] = [len(r) for r in raw]
            at = np.cumsum(count) - count
            ids, word = np.repeat(sym, count), np.repeat(word, count)
            where = np.concatenate([np.arange(a, a + len(r)) for a, r in zip(at[odd], raw)])
            ids[where] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        else:
            ids = sym
        return ids, np.searchsorted(word, np.arange(n + 1))

    def split(self, text: str, opens: bool = True) -> list[str]:
        """The words of a text, or of a part that doesn't open its text."""
        return self.word.findall(SPACE * opens + text.replace(" ", SPACE)) if text else []

    def parts(self, text: str, most: int) -> Iterator[str]:
        """A long text in parts of about `most` characters, cut where a word ends and a space follows."""
        a = 0
        while a < len(text):
            b = text.find(" ", a + most)
            while b > 0 and text[b - 1] in (" ", SPACE):
                b = text.find(" ", b + 1)
            b = len(text) if b < 0 else b
            yield text[a:b]
            a = b

    def _numbered(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a list of words in which many repeat. Short words are remembered from one call to the next."""
        got = list(map(self.known.get, words))
        missing = [k for k, n in enumerate(got) if n is None]
        fresh = list({words[k] for k in missing})
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self._forget()
            missing, fresh = range(len(words)), list(set(words))
        ids, at, known = self.known_ids, self.known_at, self.known
        if fresh:
            long = [w for w in fresh if len(w) > CACHE_CHARS]
            if long:  # they come last, so that they can be dropped again
                fresh = [*(w for w in fresh if len(w) <= CACHE_CHARS), *long]
            new, cut = self.encode_words(fresh)
            known.update(zip(fresh, range(len(at) - 1, len(at) - 1 + len(fresh))))
            ids, at = np.concatenate([ids, new.astype(np.int32)]), np.concatenate([at, at[-1] + cut[1:]])
            for k in missing:
                got[k] = known[words[k]]
            for w in long:
                del known[w]
            self.known_at = at[: len(at) - len(long)]
            self.known_ids = ids[: self.known_at[-1]]
        number = np.array(got, dtype=np.int64)
        return _taken(ids, at, number)

    def encode_flat(self, texts: list[str], add_eos: bool = True, opens: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts' ids in a row."""
        parts = [self.split(t, opens) for t in texts]
        ids, at = self._numbered([w for p in parts for w in p])
        offsets = at[np.cumsum([0, *map(len, parts)])]
        if not add_eos:
            return ids, offsets
        return np.insert(ids, offsets[1:], self.eos), offsets + np.arange(len(offsets))

    def encode(self, texts: list[str], add_eos: bool = True) -> list[np.ndarray]:
        """The ids of each text."""
        ids, at = self.encode_flat(texts, add_eos)
        return [ids[a:b] for a, b in zip(at[:-1], at[1:])]

    def _plain(self, ids: list[int]) -> str:
        """The text of some ids in a row, the leading space kept. Bytes that are no UTF-8 give U+FFFD, one each."""
        out, run = [], bytearray()
        for i in ids:
            p = self.piece_bytes[i]
            if isinstance(p, int):
                run.append(p)
                continue
            if run:
                out.append(_lenient(bytes(run)))
                run.clear()
            if p is not None:
                out.append(self.id_text[i])
        if run:
            out.append(_lenient(bytes(run)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids): control pieces say nothing, and the space that encoding put in front goes."""
        text = self._plain(ids)
        first = next((i for i in ids if self.piece_bytes[i] is not None), self.unk)
        return text[1:] if first != self.unk and self.id_text[first].startswith(" ") else text

    def decode_flat(self, ids: np.ndarray, offsets: np.ndarray, opens: bool = True) -> list[bytes]:
        """decode() of each range of ids, as UTF-8. Byte pieces are joined as they stand; only a text that isn't UTF-8 then is gone through piece by piece."""
        data, at = self.shown.joined(ids)
        raw, cut = data.tobytes(), at[offsets].tolist()
        odd = np.append(0, np.cumsum(self.is_byte[ids]))[offsets]
        first = np.where(np.diff(offsets) > 0, offsets[:-1], 0)
        spaced = self.spaced[ids[first]] & (np.diff(offsets) > 0) if len(ids) else np.zeros(len(offsets) - 1, bool)
        out = []
        for k, (a, b, has, space) in enumerate(zip(cut, cut[1:], (np.diff(odd) > 0).tolist(), spaced.tolist())):
            own = raw[a:b]
            if has:
                try:
                    own.decode()
                except UnicodeDecodeError:
                    out.append(self.decode(ids[offsets[k] : offsets[k + 1]].tolist()).encode())
                    continue
            out.append(own[1:] if space and opens else own)
        return out

    def shown_bytes(self, texts: list[str], opens: bool = True, ends: bool = True) -> tuple[list[int], list[bytes], list[bytes]]:
        """(number of ids, ids as decimals with a space after each but the last, the text that these ids decode to) of each text.

        A part of a text that doesn't end it has no end id, and a space after its last id too.
        """
        ids, offsets = self.encode_flat(texts, ends, opens)
        data, at = self.named.joined(ids)
        raw, cut = data.tobytes(), at[offsets].tolist()
        return np.diff(offsets).tolist(), [raw[a : b - ends] for a, b in zip(cut, cut[1:])], self.decode_flat(ids, offsets, opens)

    def digests(self, texts: list[str]) -> tuple[list[int], list[str], list[str]]:
        """(number of ids with the end id, ids joined by spaces, the text that they decode to) of each text."""
        count, *both = self.shown_bytes(texts)
        return count, *([x.decode() for x in column] for column in both)

    def hashed(self, text: str) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids and of the decoded text) of a long text, part by part."""
        import hashlib

        count, both, opens = 0, (hashlib.sha256(), hashlib.sha256()), True
        for part in self.parts(text, PART_CHARS):
            n, *said = self.shown_bytes([part], opens, False)
            count, opens = count + n[0], False
            for h, x in zip(both, said):
                h.update(x[0])
        both[0].update(str(self.eos).encode())
        return count + 1, both[0].hexdigest(), both[1].hexdigest()


class _Lookup:
    """The least value of each key; `find` gives it, and the key's place, for many keys at once. Keys that share a slot are searched for."""

    def __init__(self, key: np.ndarray, value: np.ndarray, worst: int):
        order = np.lexsort((value, key))
        key, value = key[order], value[order]
        first = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
        self.key, self.value, self.worst = np.append(key[first], -1), np.append(value[first], worst), worst
        self.bits = max(20, len(self.key).bit_length() + 3)
        self.place = np.full(1 << self.bits, -1, dtype=np.int32)
        slot = self._slot(self.key[:-1])
        self.place[slot] = np.arange(len(slot))
        self.crowded = np.flatnonzero(self.place[slot] != np.arange(len(slot)))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = self.place[self._slot(key)].astype(np.int64)
        other = (place >= 0) & (self.key[place] != key)
        if other.any():
            at = np.flatnonzero(other)
            if len(self.crowded):
                found = np.minimum(np.searchsorted(self.key[self.crowded], key[at]), len(self.crowded) - 1)
                found = self.crowded[found]
                place[at] = np.where(self.key[found] == key[at], found, -1)
            else:
                place[at] = -1
        place[~valid] = -1
        return self.value[place], place


class _Strings:
    """A table of byte strings, joined by their numbers."""

    def __init__(self, rows: list[bytes]):
        self.data = np.frombuffer(b"".join(rows), np.uint8)
        self.at = np.cumsum([0, *map(len, rows)])

    def joined(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _taken(self.data, self.at, number)


def _taken(data: np.ndarray, at: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of the ranges with these numbers in a row."""
    size = at[number + 1] - at[number] if len(number) else np.zeros(0, np.int64)
    out = np.append(0, np.cumsum(size))
    return data[np.repeat(at[number] - out[:-1], size) + np.arange(out[-1])] if len(number) else data[:0], out


def _expanded(lists: dict[int, list[int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of lists by number."""
    return np.array([x for k in range(n) for x in lists.get(k, ())], dtype=np.int64), np.cumsum([0, *(len(lists.get(k, ())) for k in range(n))])


def _spread(number: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) for each value of each row's list."""
    values, at = lists
    got, _ = _taken(values, at, number)
    return np.repeat(np.arange(len(number)), np.diff(at)[number]), got


def _lenient(raw: bytes) -> str:
    """UTF-8, where each byte that belongs to no character gives U+FFFD."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for size in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + size].decode())
                except UnicodeDecodeError:
                    continue
                i += size
                break
            else:
                out.append("�")
                i += 1
        return "".join(out)


@lru_cache(maxsize=4)
def codec(model: str) -> Codec:
    """The codec of a model file: a path, or the name of a public tokenizer. Built once in each Python process."""
    import os

    if not os.path.exists(model):
        import public_tokenizers

        model = public_tokenizers.path(model)
    return Codec(model)


def encode_documents(docs, text: str = "text", key: str = "doc_id", model: str = "piece_bpe_32k.model", add_eos: bool = True):
    """(key, ids array<int>): the ids of every whole text. A null text has those of the empty text, the end id alone."""

    def run(batches):
        own = codec(model)
        for batch in batches:
            for i, j, texts in _texts(batch):
                ids, at = own.encode_flat(texts, add_eos)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))], ["key", "ids"])

    return _run(docs, text, key, run, "ids array<int>")


def decode_documents(encoded, ids: str = "ids", key: str = "doc_id", model: str = "piece_bpe_32k.model"):
    """(key, text): the text of every list of ids; null or empty lists give the empty text."""

    def run(batches):
        own = codec(model)
        for batch in batches:
            texts = [own.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    return _run(encoded, ids, key, run, "text string")


def round_trip(docs, text: str = "text", key: str = "doc_id", model: str = "piece_bpe_32k.model"):
    """(key, n_tokens, ids, decoded): the ids as decimals joined by spaces, and what they decode to.

    Ids and text are those of encode_documents and decode_documents; the text is decoded from the ids. A null text is
    the empty one; repeated rows are encoded each; no text is cut. Only the columns named are read.
    """

    def run(batches):
        own = codec(model)
        for batch in batches:
            for i, j, texts in _texts(batch):
                count, ids, plain = own.digests(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(count, pa.int64()), pa.array(ids, pa.string()), pa.array(plain, pa.string())], ["key", "n_tokens", "ids", "decoded"])

    return _run(docs, text, key, run, "n_tokens long, ids string, decoded string")


def round_trip_digests(docs, text: str = "text", key: str = "doc_id", model: str = "piece_bpe_32k.model"):
    """(key, n_tokens, ids_sha256, decoded_sha256): round_trip with its two long columns hashed where they are made; long texts part by part."""
    import hashlib

    def run(batches):
        own = codec(model)
        for batch in batches:
            for i, j, texts in _texts(batch):
                if j - i == 1 and len(texts[0]) > PART_CHARS:
                    rows = [[x] for x in own.hashed(texts[0])]
                else:
                    count, *both = own.shown_bytes(texts)
                    rows = [count, *([hashlib.sha256(x).hexdigest() for x in column] for column in both)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(rows[0], pa.int64()), *(pa.array(x, pa.string()) for x in rows[1:])], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _run(docs, text, key, run, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _texts(batch) -> Iterator[tuple[int, int, list[str]]]:
    """Ranges of a batch's rows with their texts, its second column."""
    data, offsets = _text.flat(batch.column(1))
    for i, j in _text.pieces(offsets):
        yield i, j, [bytes(data[offsets[r] : offsets[r + 1]]).decode("utf-8", "replace") for r in range(i, j)]


def _run(df, column: str, key: str, run, fields: str):
    from pyspark.sql import functions as F

    kind = df.schema[key].dataType.simpleString()
    names = [f.split()[0] for f in fields.split(", ")]
    return df.select(F.col(key).alias("key"), F.col(column).alias("value")).mapInArrow(run, f"key {kind}, {fields}").select(F.col("key").alias(key), *names)
