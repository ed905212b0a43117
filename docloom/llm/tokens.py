"""Token ids of a public word-BPE vocabulary, many times faster than encoding text by text.

The vocabulary (a tokenizers JSON file with end-of-word symbols) drops white space, so a text's ids
are those of its words in turn. All texts of a batch are cut into words by array operations; the
tokenizers library encodes each distinct word once, and its ids are remembered with its bytes. Words
are found again by a 64-bit hash and compared byte by byte; should two words ever share a hash, the
library encodes the batch's whole texts. Chunks with anything but plain Latin letters, digits and
signs (other scripts, controls, apostrophes, special tokens, very long runs) are words of their own.
"""

from __future__ import annotations

import json
import os


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Texts to ids. limit: words remembered; only speed depends on it."""

    LONGEST = 48
    SPACE, LETTER, NUMBER, OTHER, ODD = range(5)
    BASE = 0x2545F4914F6CDD1D

    def __init__(self, path: str, limit: int = 2_000_000):
        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.np, self.limit = np, limit
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = [x["content"] for x in model.get("added_tokens", [])]
        vocab = model["model"]["vocab"]
        self.size = max([0, *vocab.values(), *(x["id"] for x in model.get("added_tokens", []))]) + 1
        suffix = model["model"].get("end_of_word_suffix") or ""
        self.final = np.zeros(self.size, dtype=bool)
        self.final[[i for x, i in vocab.items() if suffix and x.endswith(suffix)]] = True
        self._tables()

    def _tables(self) -> None:
        """For code points below U+0250: the kind of character, and its lower case if that is as long in UTF-8."""
        import unicodedata

        np = self.np
        kind, low = np.full(0x250, self.ODD, dtype=np.uint8), np.arange(0x250, dtype=np.int64)
        for c in [*range(0x21, 0x7F), *range(0xA1, 0x250)]:
            lower = chr(c).lower()
            if c == ord("'") or len(lower) != 1 or len(lower.encode()) != len(chr(c).encode()):
                continue
            kind[c], low[c] = {"L": self.LETTER, "N": self.NUMBER}.get(unicodedata.category(chr(c))[0], self.OTHER), ord(lower)
        kind[[0x20, 0x0A]] = self.SPACE
        self.kind, self.low = kind, low
        self._forget()
        base = np.uint64(self.BASE)
        self.power, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)
        self.bases = (base, np.uint64(pow(self.BASE, -1, 1 << 64)))

    def _forget(self) -> None:
        """Nothing is known. Of a word: its hash, where its ids and bytes lie in the pools, and how many they are."""
        np = self.np
        self.known_hash, self.known = np.zeros(0, np.uint64), np.zeros((0, 4), np.int64)
        self.pool, self.bytes = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.uint8)

    def _powers(self, n: int) -> None:
        np = self.np
        if len(self.power) < n:
            with np.errstate(over="ignore"):
                self.power, self.inverse = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, b)]) for b in self.bases)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes. A null text is an empty one."""
        flat, counts = self.encode_flat(texts)
        raw, ends = flat.astype("<u4").tobytes(), self.np.cumsum(counts) * 4
        return [raw[s:e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def encode_flat(self, texts: list[str | None], size: int = 1 << 20):
        """(ids of all texts in turn, ids of each)."""
        np = self.np
        flats, counts, held, n = [np.zeros(0, dtype=np.uint32)], [np.zeros(0, dtype=np.int64)], [], 0
        for text in texts:
            held.append((text or "").encode())
            n += len(held[-1]) + 1
            if n >= size:
                done = self._batch(held)
                flats.append(done[0])
                counts.append(done[1])
                held, n = [], 0
        if held:
            done = self._batch(held)
            flats.append(done[0])
            counts.append(done[1])
        return np.concatenate(flats), np.concatenate(counts)

    def _batch(self, raws: list[bytes]):
        np = self.np
        raw = b"\n".join(raws) + b"\n"
        b = np.frombuffer(raw, dtype=np.uint8)
        n = len(b)
        # Code points of one and two bytes; a second byte has its first one's kind, longer ones are odd.
        kind = self.kind[np.where(b < 0x80, b, 0)]
        low = b.copy()
        ascii_capital = (b >= 65) & (b <= 90)
        low[ascii_capital] += 32
        high = np.flatnonzero(b >= 0x80)
        if len(high):
            kind[high] = self.ODD
            lead = high[(b[high] >= 0xC2) & (b[high] <= 0xC9)]
            code = (b[lead].astype(np.int64) & 0x1F) << 6 | b[lead + 1] & 0x3F
            lead, code = lead[code < 0x250], code[code < 0x250]
            kind[lead] = kind[lead + 1] = self.kind[code]
            small = self.low[code]
            low[lead], low[lead + 1] = 0xC0 | small >> 6, 0x80 | small & 0x3F
        first = (b & 0xC0) != 0x80  # not the second byte of a character
        new = np.empty(n, dtype=bool)
        new[0] = True
        np.not_equal(kind[1:], kind[:-1], out=new[1:])
        new |= (kind == self.NUMBER) & first
        space = kind == self.SPACE
        # A chunk with an odd character is one word, left to the library; so is one with a very long word.
        starts = np.flatnonzero(new)
        ends = np.r_[starts[1:], n]
        odd_at = np.flatnonzero(kind == self.ODD)
        too_long = starts[(ends - starts > self.LONGEST) & ~space[starts]]
        special = [i for x in self.special for i in self._finds(raw, x.encode())]
        odd_at = np.unique(np.concatenate([odd_at, too_long, np.array(special, dtype=np.int64)]))
        if len(odd_at):
            gaps = np.flatnonzero(space)
            to = np.unique(np.searchsorted(gaps, odd_at))
            begin, stop = np.where(to > 0, gaps[to - 1] + 1, 0), gaps[to]
            inside = np.zeros(n + 1, dtype=np.int8)
            inside[begin] += 1
            inside[stop] -= 1
            inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
            low[inside] = b[inside]
            new &= ~inside
            new[begin] = new[stop] = True
            starts = np.flatnonzero(new)
            ends = np.r_[starts[1:], n]
        word = ~space[starts]
        starts, ends = starts[word], ends[word]
        self._powers(n + 1)
        with np.errstate(over="ignore"):
            s = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((low.astype(np.uint64) + np.uint64(1)) * self.power[:n], out=s[1:])
            h = (s[ends] - s[starts]) * self.inverse[starts]
            h = (h ^ h >> np.uint64(31)) * np.uint64(0x9FB21C651E98DF25)
        if not len(h):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(raws), dtype=np.int64)
        distinct, one, which = np.unique(h, return_index=True, return_inverse=True)
        lens = ends - starts
        if not self._same(low, starts, lens, low, starts[one][which], lens[one][which]):
            return self._plain(raws)
        place = self._place(distinct)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            text = low.tobytes()
            odd = inside[starts[one[missing]]] if len(odd_at) else np.zeros(len(missing), dtype=bool)
            for kind in (odd, ~odd):
                at = one[missing[kind]]
                self._remember(distinct[missing[kind]], [text[x:y].decode() for x, y in zip(starts[at].tolist(), ends[at].tolist())], kind is odd)
            place = self._place(distinct)
        at, m, text_at, text_n = self.known[place].T
        if not self._same(low, starts[one], lens[one], self.bytes, text_at, text_n):
            return self._plain(raws)
        m_all = m[which]
        total = int(m_all.sum())
        before = np.cumsum(m_all) - m_all
        flat = self.pool[np.repeat(at[which] - before, m_all) + np.arange(total)]
        sizes = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws)) + 1
        edge = np.searchsorted(starts, np.cumsum(sizes))
        upto = np.r_[0, np.cumsum(m_all)][edge]
        if len(self.known_hash) > self.limit:
            self._forget()
        return flat, np.diff(np.r_[0, upto])

    def _same(self, x, x_at, x_n, y, y_at, y_n) -> bool:
        """Are the words of x and y in turn the same bytes?"""
        np = self.np
        if (x_n != y_n).any():
            return False
        inner = np.arange(int(x_n.sum())) - np.repeat(np.cumsum(x_n) - x_n, x_n)
        return bool((x[np.repeat(x_at, x_n) + inner] == y[np.repeat(y_at, x_n) + inner]).all())

    def _plain(self, raws: list[bytes]):
        """Whole texts through the library."""
        np = self.np
        ids = [x.ids for x in self.library.encode_batch([r.decode() for r in raws], add_special_tokens=False)]
        return np.array([i for x in ids for i in x], dtype=np.uint32), np.array([len(x) for x in ids], dtype=np.int64)

    @staticmethod
    def _finds(raw: bytes, what: bytes):
        at = raw.find(what)
        while at >= 0:
            yield at
            at = raw.find(what, at + 1)

    def _place(self, h):
        np = self.np
        if not len(self.known_hash):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.known_hash, h), len(self.known_hash) - 1)
        return np.where(self.known_hash[at] == h, at, -1)

    def _ids(self, words: list[str], single: bool) -> tuple:
        """(ids of all words in turn, ids of each). Words that aren't single (one that the library may part) go in one text: each ends with an id of a word's end."""
        np = self.np
        if not single:
            flat = [np.array(self.library.encode(" ".join(words[k : k + 500]), add_special_tokens=False).ids, dtype=np.uint32) for k in range(0, len(words), 500)]
            flat = np.concatenate([np.zeros(0, dtype=np.uint32), *flat])
            last = np.flatnonzero(self.final[flat])
            if len(last) == len(words):
                return flat, np.diff(np.r_[-1, last])
        ids = [x.ids for x in self.library.encode_batch(words, add_special_tokens=False)]
        return np.array([i for x in ids for i in x], dtype=np.uint32), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))

    def _remember(self, h, words: list[str], single: bool) -> None:
        """The library's ids of new words, whose hashes are h."""
        if not words:
            return
        np = self.np
        ids, n = self._ids(words, single)
        words = [w.encode() for w in words]
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        new = np.stack([len(self.pool) + np.cumsum(n) - n, n, len(self.bytes) + np.cumsum(size) - size, size], axis=1)
        self.pool = np.concatenate([self.pool, ids])
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(words), dtype=np.uint8)])
        every = np.concatenate([self.known_hash, h])
        order = np.argsort(every, kind="stable")
        self.known_hash, self.known = every[order], np.concatenate([self.known, new])[order]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One a Python worker, for all the tasks it runs."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
