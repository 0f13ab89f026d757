"""Token ids for a lower-casing BPE vocabulary with word ends (a `tokenizers` JSON file), array at a time.

White space always parts tokens there, so a text's ids are its words' ids in order. Words met before
come from a table; new words are split into pre-tokens; pre-tokens that are vocabulary strings proven
to encode alone as one token are taken whole, and only the rest are merged, all of a batch together.
Words with anything but ASCII and Latin-1 letters, digits and punctuation go to the library itself.
"""

from __future__ import annotations

import json

import numpy as np

from . import textops as T

U64 = np.uint64
#: Entries after which a worker's word table is emptied, so its memory stays bounded on any corpus.
MAX_WORDS = 1_500_000
#: Longer pre-tokens go to the library.
MAX_PIECE = 48


class Table:
    """Open-addressing map from non-zero 64-bit keys to int32, with array-wide lookup and insertion."""

    def __init__(self, bits: int = 16):
        self.reset(bits)

    def reset(self, bits: int) -> None:
        self.bits, self.n = bits, 0
        self.keys, self.values = np.zeros(1 << bits, U64), np.zeros(1 << bits, np.int32)

    def _slots(self, keys):
        with np.errstate(over="ignore"):
            return ((keys * T.P1) >> U64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int32)
        slot, live, mask = self._slots(keys), np.arange(len(keys)), (1 << self.bits) - 1
        while len(live):
            held = self.keys[slot]
            hit = held == keys[live]
            out[live[hit]] = self.values[slot[hit]]
            on = ~hit & (held != 0)
            live, slot = live[on], (slot[on] + 1) & mask
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not in the table."""
        self.n += len(keys)
        if self.n * 2 > 1 << self.bits:
            old = np.flatnonzero(self.keys)
            k, v, n = self.keys[old], self.values[old], self.n
            self.reset(int(n * 3).bit_length())
            self.add(k, v)
            self.n = n
        slot, live, mask = self._slots(keys), np.arange(len(keys)), (1 << self.bits) - 1
        while len(live):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[live[free]]
            won = self.keys[slot] == keys[live]
            self.values[slot[won]] = values[live[won]]
            live, slot = live[~won], (slot[~won] + 1) & mask


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


NONE = np.int32(2**31 - 1)
# byte classes of words that need no library: 1 letters, 2 digits, 3 punctuation, 0 all else
KIND = np.zeros(256, np.int8)
KIND[33:127] = 3
KIND[ord("0") : ord("9") + 1] = 2
KIND[ord("a") : ord("z") + 1] = KIND[ord("A") : ord("Z") + 1] = 1
KIND[ord("'")] = 0


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        chars = byte_chars()
        self.mid = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + end] for c in chars], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.pair_keys, self.pair_ranks = key[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.words, self.pieces = Table(), Table()
        self.pool, self.used = np.zeros(1 << 20, np.int32), 0
        self.start, self.size, self.n = np.zeros(1 << 17, np.int64), np.zeros(1 << 17, np.int32), 0
        back = {c: b for b, c in enumerate(chars)}
        whole = [(s[: -len(end)], i) for s, i in vocab.items() if s.endswith(end) and len(s) > len(end)]
        self._prove([(bytes(back[c] for c in s), i) for s, i in whole if all(c in back for c in s)])

    def _prove(self, strings: list[tuple[bytes, int]]) -> None:
        """Keeps as whole tokens the vocabulary strings of one class whose own merges end in that one token."""
        ok = []
        for s, i in strings:
            kinds = {int(KIND[c]) for c in s.replace(b"\xc3", b"")} if s.isascii() else {0}
            if len(s) <= MAX_PIECE and len(kinds) == 1 and kinds <= {1, 2, 3} and (kinds != {2} or len(s) == 1) and s == s.lower():
                ok.append((s, i))
        buf = np.frombuffer(b"".join(s for s, _ in ok) + b"\0" * 16, np.uint8)
        size = np.array([len(s) for s, _ in ok], np.int64)
        at = np.cumsum(size) - size
        ids, per = self._merge(buf, at, size)
        first = ids[np.cumsum(per) - per]
        proven = (per == 1) & (first == np.array([i for _, i in ok]))
        h = _keys(buf, at[proven], size[proven])
        self.whole = int(proven.sum())
        self.pieces.add(h, self._hold(first[proven], np.ones(self.whole, np.int32)))

    def _hold(self, ids: np.ndarray, per: np.ndarray) -> np.ndarray:
        """Stores runs of ids; their entry numbers."""
        need = self.used + len(ids)
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(need, len(self.pool)), np.int32)])
        self.pool[self.used : need] = ids
        top = self.n + len(per)
        if top > len(self.start):
            self.start = np.concatenate([self.start, np.zeros(max(top, len(self.start)), np.int64)])
            self.size = np.concatenate([self.size, np.zeros(max(top, len(self.size)), np.int32)])
        self.start[self.n : top] = self.used + np.cumsum(per) - per
        self.size[self.n : top] = per
        out = np.arange(self.n, top, dtype=np.int32)
        self.used, self.n = need, top
        return out

    def _rank(self, a, b):
        key = (a.astype(np.int64) << 20) | b
        i = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[i] == key, self.pair_ranks[i], NONE)

    def _merge(self, buf, at, size) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their count for each piece: the lowest-ranked, leftmost pair of every piece is merged, again and again."""
        n = len(at)
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        sym = self.mid[buf[T.gather(at, size)]]
        end = np.cumsum(size) - 1
        sym[end] = self.last[buf[at + size - 1]]
        per, piece = size.astype(np.int64), np.arange(n)
        done: list[tuple] = []
        rank = np.full(len(sym), NONE, np.int32)
        rank[:-1] = self._rank(sym[:-1], sym[1:])
        rank[end] = NONE
        while True:
            first = np.cumsum(per) - per
            least = np.minimum.reduceat(rank, first)
            over = least == NONE
            if over.any():
                done.append((piece[over], sym[T.gather(first[over], per[over])], per[over]))
                on = ~over
                if not on.any():
                    break
                keep = T.gather(first[on], per[on])
                sym, rank = sym[keep], rank[keep]
                per, piece, least = per[on], piece[on], least[on]
                first = np.cumsum(per) - per
            hits = np.flatnonzero(rank == np.repeat(least, per))
            owner = np.searchsorted(first, hits, "right") - 1
            lead = np.ones(len(hits), bool)
            lead[1:] = owner[1:] != owner[:-1]
            pos = hits[lead]
            sym[pos] = self.merged[least]
            keep = np.ones(len(sym), bool)
            keep[pos + 1] = False
            sym, rank = sym[keep], rank[keep]
            pos = pos - np.arange(len(pos))  # one symbol less for each piece before
            per = per - 1
            first = np.cumsum(per) - per
            left = pos > first
            p = pos[left]
            rank[p - 1] = self._rank(sym[p - 1], sym[p])
            right = pos < first + per - 1
            rank[pos] = NONE
            p = pos[right]
            rank[p] = self._rank(sym[p], sym[p + 1])
        who = np.concatenate([d[0] for d in done])
        cnt = np.concatenate([d[2] for d in done])
        ids = np.concatenate([d[1] for d in done])
        begin = np.cumsum(cnt) - cnt
        order = np.argsort(who)
        return ids[T.gather(begin[order], cnt[order])], cnt[order]

    def _learn(self, words: T.Words, new: np.ndarray, keys: np.ndarray) -> None:
        """Adds the words with the given indices and distinct keys to the table."""
        at, size = words.at[new], words.size[new]
        src = T.gather(at, size)
        raw = T.LOWER[words.norm[src]]
        own = np.repeat(np.arange(len(new)), size)
        kind = KIND[raw]
        lead = raw == 0xC3
        trail = np.zeros(len(raw), bool)
        trail[1:] = lead[:-1]
        low = trail & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)
        raw[low] += 0x20
        kind[lead] = 1
        kind[trail & (raw >= 0x80) & (raw <= 0xBF) & (raw != 0x97) & (raw != 0xB7)] = 1
        odd = np.bincount(own[kind == 0], minlength=len(new)) > 0
        special = (raw == ord("<")) | (raw == ord("|"))
        odd |= np.bincount(own[special], minlength=len(new)) >= 2
        split = np.ones(len(raw), bool)
        split[1:] = (own[1:] != own[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        begin = np.flatnonzero(split)
        length = np.diff(np.append(begin, len(raw)))
        whose = own[begin]
        odd |= np.bincount(whose[length > MAX_PIECE], minlength=len(new)) > 0
        good = ~odd[whose]
        begin, length, whose = begin[good], length[good], whose[good]
        raw = np.concatenate([raw, np.zeros(16, np.uint8)])
        h = _keys(raw, begin, length)
        entry = self.pieces.find(h)
        miss = np.flatnonzero(entry < 0)
        if len(miss):
            uniq, first = np.unique(h[miss], return_index=True)
            ids, per = self._merge(raw, begin[miss[first]], length[miss[first]])
            self.pieces.add(uniq, self._hold(ids, per))
            entry[miss] = self.pieces.find(h[miss])
        ids = self.pool[T.gather(self.start[entry], self.size[entry].astype(np.int64))]
        count = np.bincount(whose, weights=self.size[entry], minlength=len(new)).astype(np.int64)
        plain = np.flatnonzero(~odd)
        held = self._hold(ids, count[plain])
        self.words.add(keys[plain], held)
        strange = np.flatnonzero(odd)
        if len(strange):
            texts = [bytes(words.norm[at[i] : at[i] + size[i]]).decode() for i in strange]
            got = [self.library.encode(t, add_special_tokens=False).ids for t in texts]
            flat = np.array([x for g in got for x in g], np.int32)
            self.words.add(keys[strange], self._hold(flat, np.array([len(g) for g in got], np.int64)))

    def entries(self, words: T.Words) -> np.ndarray:
        """The table entry of every word; valid until the next call."""
        if self.n > MAX_WORDS:
            self.__init__(self.path)
        key = _keys(words.norm, words.at, words.size)
        entry = self.words.find(key)
        miss = np.flatnonzero(entry < 0)
        if len(miss):
            uniq, first = np.unique(key[miss], return_index=True)
            self._learn(words, miss[first], uniq)
            entry[miss] = self.words.find(key[miss])
        return entry

    def counts(self, buf, offs) -> np.ndarray:
        words = T.Words(buf, offs)
        entry = self.entries(words)  # may replace self.size
        return T.by_doc(self.size[entry], words.per_doc)

    def ids(self, buf, offs) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, joined, and the count of each."""
        words = T.Words(buf, offs)
        entry = self.entries(words)
        size = self.size[entry].astype(np.int64)
        return self.pool[T.gather(self.start[entry], size)], T.by_doc(size, words.per_doc)


def _keys(buf, at, size):
    return np.maximum(T.xxh64(buf, at, size, 7), U64(1))


_HELD: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """One table of words for each Python worker and vocabulary file."""
    if path not in _HELD:
        _HELD[path] = WordBpe(path)
        _HELD[path].path = path
    return _HELD[path]
