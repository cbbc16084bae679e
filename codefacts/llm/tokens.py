"""Exact BPE by speculation: greedy longest match, vectorised pair checks, exact merging of the rest.

A sequence of tokens is what BPE yields for a word if every token is its own encoding and
every adjacent pair is stable: undoing the merges from the border outwards, youngest first,
never meets a pair that an older merge would have joined. Both are checked with array
operations. Words that fail are merged exactly, all failing words at once: in each the pair of
least rank, until none is left. Texts in which words part at single spaces and newlines are cut
there; texts with runs of white space, white space of other kinds or special tokens are cut by
the vocabulary's own pattern. Both ways lead through the same speculation.
"""

from __future__ import annotations

import gc
import json
import re
import unicodedata
from bisect import bisect_right
from typing import TYPE_CHECKING

import numpy as np

if TYPE_CHECKING:
    from tokenizers import Tokenizer

CACHE = 350_000  # chunks that a worker remembers; beyond it, chunks are encoded again
_LOADED: dict[str, Bpe] = {}


def _bytes_of_chars() -> dict[str, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): chr(b) for b in plain} | {chr(256 + i): chr(b) for i, b in enumerate(rest)}


def _marked(words: list[str], mark: bytes) -> bytes:
    """The bytes of words, each with the mark after it."""
    big = "\n".join(words) + "\n"
    if big.count("\n") == len(words):
        return big.encode().replace(b"\n", mark)
    return b"".join([w.encode() + mark for w in words])


class Bpe:
    """A byte-level BPE vocabulary file, with or without a word-end suffix."""

    NONE = np.int64(1 << 60)

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.lower = bool(spec.get("normalizer"))
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab: dict[str, int] = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # order of a token: the single symbols first, then the others as merged
        made: dict[str, int] = {}
        for r, (left, right) in enumerate(merges):
            made.setdefault(left + right, r)
        base = [t for t in vocab if t not in made]
        order = {t: i for i, t in enumerate(base)} | {t: len(base) + r for t, r in made.items()}
        self.n_base, size = len(base), len(base) + len(merges)
        self.left, self.right = np.arange(size), np.arange(size)
        keys, product = [], []
        for left, right in merges:
            t = order[left + right]
            keys.append(order[left] * size + order[right])
            product.append(t)
        keys_, product_ = np.array(keys, dtype=np.int64), np.array(product, dtype=np.int64)
        _, first = np.unique(product_, return_index=True)
        self.left[product_[first]], self.right[product_[first]] = keys_[first] // size, keys_[first] % size
        at = np.argsort(keys_, kind="stable")
        self.size = size
        self._index(keys_[at], product_[at])
        self.ids = np.zeros(size, dtype=np.uint32)
        for t, i in order.items():
            self.ids[i] = vocab[t]
        merged = np.arange(self.n_base, size)
        own = np.ones(size, dtype=bool)
        own[merged] = self.stable(self.left[merged], self.right[merged], merged)
        while True:  # a token is its own encoding only if its parts are
            less = own & own[self.left] & own[self.right]
            if (less == own).all():
                break
            own = less
        self.own = own

        chars = _bytes_of_chars()
        self.symbols, self.last_symbols = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
        for c, byte in chars.items():
            self.symbols[ord(byte)] = order[c]
            self.last_symbols[ord(byte)] = order[c + self.end]
        # two bytes that UTF-8 never has mark the end of a word; tokens with one can be left out
        self.stop, self.border = "\xff", "\xfe"
        self.auto = ahocorasick.Automaton()
        for t, i in order.items():
            ends = self.end and t.endswith(self.end)
            plain = "".join(chars[c] for c in (t[: -len(self.end)] if ends else t))
            if self.stop not in plain and self.border not in plain:
                self.auto.add_word(plain + self.border * bool(ends), i)
        self.auto.add_word(self.stop, -1)
        if self.end:
            self.auto.add_word(self.border, -2)
        self.auto.make_automaton()
        # bytes of each id, for decoding
        texts = {i: "".join(chars[c] for c in t.removesuffix(self.end) if c in chars).encode("latin-1") + b" " * bool(self.end and t.endswith(self.end)) for t, i in vocab.items()}
        texts |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        n = max(texts) + 1
        self.lengths = np.array([len(texts.get(i, b"")) for i in range(n)], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.flat = np.frombuffer(b"".join(texts.get(i, b"") for i in range(n)), dtype=np.uint8)
        self._regex, self.path, self.library = regex, path, None
        self.others: dict[str, bool] = {}  # at most one for each code point that Python doesn't know
        # fixed values: the two files' word patterns
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+" if self.end else r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        # special tokens are cut out of a text before anything else
        self.marks = re.compile("(" + "|".join(re.escape(t) for t in special) + ")")
        self.open = sorted({t[:2] for t in special})
        self.space = re.compile(r"[^\S \n]")
        self.cache: dict[str, bytes] = {}  # chunks between single spaces
        self.pieces: dict[str, bytes] = {}  # matches of the pattern
        self.marked = {t: i.to_bytes(4, "little") for t, i in special.items()}
        self.seen = np.zeros(1 << 23, dtype=bool)  # hashes of chunks met so far
        self.stats = {"words": 0, "merged": 0}
        self.newline = b"" if self.end else self.words(["\n"])[0]

    def _index(self, keys: np.ndarray, product: np.ndarray) -> None:
        """A hash table of the merges: pair to product, with linear probing."""
        self.slots, self.held = np.full(1 << 18, -1, dtype=np.int64), np.full(1 << 18, self.NONE)
        at, todo = self._slot(keys), np.arange(len(keys))
        while todo.size:
            free = self.slots[at[todo]] == -1
            _, first = np.unique(at[todo[free]], return_index=True)
            put = todo[free][first]
            self.slots[at[put]], self.held[at[put]] = keys[put], product[put]
            todo = np.setdiff1d(todo, put)
            at[todo] = (at[todo] + 1) & (len(self.slots) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(46)).astype(np.int64)

    def joined(self, keys: np.ndarray) -> np.ndarray:
        """What each pair of tokens merges into, or NONE."""
        at = self._slot(keys)
        got = self.slots[at]
        out = np.where(got == keys, self.held[at], self.NONE)
        todo = np.flatnonzero((got != keys) & (got != -1))
        while todo.size:
            at = (at if len(at) == len(todo) else at[todo]) + 1 & len(self.slots) - 1
            key = keys[todo]
            got = self.slots[at]
            hit = got == key
            out[todo[hit]] = self.held[at[hit]]
            go = ~hit & (got != -1)
            todo, at = todo[go], at[go]
        return out

    def merge(self, words: list[str]) -> list[bytes]:
        """Ids of words by exact merging: in each the pair of least rank, again and again, for all words at once."""
        if not words:
            return []
        flat = np.frombuffer(_marked(words, b"\xff"), dtype=np.uint8)
        n = np.diff(np.flatnonzero(flat == 255), prepend=-1) - 1
        flat = flat[flat != 255]
        s = self.symbols[flat]
        if self.end:
            s[np.cumsum(n) - 1] = self.last_symbols[flat[np.cumsum(n) - 1]]
        word = np.repeat(np.arange(len(words)), n)
        done_s, done_w = [], []
        while s.size:
            rank = np.full(len(s), self.NONE)
            inner = np.flatnonzero(word[:-1] == word[1:])
            rank[inner] = self.joined(s[inner] * self.size + s[inner + 1])
            start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.minimum.reduceat(rank, start)
            each = np.diff(start, append=len(s))
            over = np.repeat(least == self.NONE, each)
            hit = np.flatnonzero((rank == np.repeat(least, each)) & ~over)
            first = hit[np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])] if hit.size else hit
            s[first] = rank[first]
            keep = ~over
            keep[first + 1] = False
            done_s.append(s[over])
            done_w.append(word[over])
            s, word = s[keep], word[keep]
        if not done_s:
            return []
        s, word = np.concatenate(done_s), np.concatenate(done_w)
        at = np.argsort(word, kind="stable")
        ids = self.ids[s[at]].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(word, minlength=len(words))).tolist()
        return [ids[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def stable(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For pairs of token orders: would BPE leave the border between them alone?"""
        ok = np.ones(len(a), dtype=bool)
        a, b, live = a.copy(), b.copy(), np.arange(len(a))
        limit = np.full(len(a), self.NONE) if limit is None else limit.copy()
        while live.size:
            bad = self.joined(a * self.size + b) < limit
            ok[live[bad]] = False
            go = ~bad & ~((a < self.n_base) & (b < self.n_base))
            a, b, live = a[go], b[go], live[go]
            young = a > b
            limit = np.where(young, a, b + 1)
            a, b = np.where(young, self.right[a], a), np.where(young, b, self.left[b])
        return ok

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of words that the pattern leaves whole, as little-endian 32-bit bytes."""
        if not words:
            return []
        mark = (self.border * bool(self.end) + self.stop).encode("latin-1")
        big = _marked(words, mark).decode("latin-1")
        got = np.fromiter(self.auto.iter_long(big), dtype=[("end", np.int64), ("token", np.int64)])["token"]
        stops = np.flatnonzero(got == -1)
        word = np.repeat(np.arange(len(words)), np.diff(stops, prepend=-1))
        real = got >= 0
        bad = np.zeros(len(words), dtype=bool)
        bad[word[got == -2]] = True
        bad[word[real][~self.own[got[real]]]] = True
        pair = np.flatnonzero(real[:-1] & real[1:] & (word[:-1] == word[1:]))
        kinds, back = np.unique(got[pair] * self.size + got[pair + 1], return_inverse=True)
        bad[word[pair[~self.stable(kinds // self.size, kinds % self.size)[back]]]] = True
        raw = self.ids[np.maximum(got, 0)].astype("<u4").tobytes()
        starts = np.concatenate([[0], stops[:-1] + 1])
        # a border symbol of its own occurs in words that fail only
        out = [raw[4 * s : 4 * e] for s, e in zip(starts.tolist(), stops.tolist(), strict=True)]
        failed = np.flatnonzero(bad).tolist()
        for i, ids in zip(failed, self.merge([words[i] for i in failed]), strict=True):
            out[i] = ids
        self.stats["words"] += len(words)
        self.stats["merged"] += len(failed)
        return out

    def _plain(self, text: str) -> str:
        """A text as the vocabulary's normaliser leaves it: composed, each character in lower case by itself."""
        if not self.end:
            return text
        if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text)):
            return self._library().normalizer.normalize_str(text)  # letters newer than Python's tables
        return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()

    def _library(self) -> Tokenizer:
        """The file as the tokenizers library reads it, for code points that Python doesn't know."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return self.library

    def _cut(self, text: str) -> list[str]:
        """The words of a plain text by the vocabulary's pattern.

        Code points newer than Python's tables are looked at one by one, since the tables of pattern
        libraries differ on them: those that the file's own splitter calls neither letter nor digit.
        """
        if self.end and not text.isascii():
            new = [c for c in set(text) if unicodedata.category(c) == "Cn"]
            others = "".join(sorted(c for c in new if self._is_other(c)))
            if others:
                return self._regex.findall(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{others}]]+|[\p{{N}}--[{others}]]|(?:[^\s\p{{L}}\p{{N}}]|[{others}])+", text, self._regex.V1)
        return self.pattern.findall(text)

    def _is_other(self, c: str) -> bool:
        if c not in self.others:
            self.others[c] = len(self._library().pre_tokenizer.pre_tokenize_str("." + c)) == 1
        return self.others[c]

    def _remember(self, new: dict[str, bytes], cache: dict[str, bytes]) -> None:
        """Keep chunks that have come before, in another batch, while there is room."""
        if len(cache) < CACHE:
            at = np.fromiter(map(hash, new), dtype=np.int64, count=len(new)) & (len(self.seen) - 1)
            again = self.seen[at]
            self.seen[at] = True
            cache.update([x for x, known in zip(new.items(), again.tolist(), strict=True) if known])

    def _learn(self, parts: list[str]) -> dict[str, bytes | None]:
        """Encodings of chunks that are new; None for those with white space of other kinds, whose texts are cut in another way."""
        get, newline = self.cache.get, self.newline
        new: dict[str, bytes | None] = {}
        spaced = [p for p in parts if self.space.search(p)] if self.space.search(" ".join(parts)) else []
        if spaced:
            parts = list(set(parts).difference(spaced))
        if self.end:
            plain = self._plain("\n".join(parts)).replace("\n", " ").split(" ") if parts else []
            words = bodies = plain
        else:
            words = [p[1:] if p[:1] == "\n" else " " + p for p in parts]
            bodies = [p[1:] if p[:1] == "\n" else p for p in parts]
        whole = [(p, w) for p, w, body in zip(parts, words, bodies, strict=True) if body.isalpha()]
        # a chunk that is one word has just been missed under that word's key, unless it was changed
        found: dict[str, bytes | None] = {w: get(w) for _, w in whole} if self.end else dict.fromkeys([w for _, w in whole])
        split: list[tuple[str, list[str]]] = []
        cut, end = self._cut, self.end
        for p, w, body in zip(parts, words, bodies, strict=True):
            if body.isalpha():
                continue
            pieces = [w[:-1], w[-1]] if body[-1:] in (".", ",") and body[:-1].isalpha() else cut(w)
            split.append((p, pieces))
            for x in pieces:
                if x not in found:
                    found[x] = get(x if end else x[1:] if x[0] == " " else None)
        distinct = [w for w, ids in found.items() if ids is None]
        found.update(zip(distinct, self.words(distinct), strict=True))
        for p, w in whole:
            new[p] = found[w]
        for p, pieces in split:
            new[p] = b"".join([found[w] for w in pieces])
        if newline:
            new.update((p, newline + ids) for p, ids in new.items() if p[:1] == "\n")
        self._remember(new, self.cache)
        new.update(dict.fromkeys(spaced))
        return new

    def _whole(self, texts: list[str]) -> list[bytes]:
        """Ids of texts cut by the pattern, special tokens first."""
        parts: list[str] = []
        ends: list[int] = []
        for text in texts:
            for k, segment in enumerate(self.marks.split(text)):
                if k % 2:
                    parts.append(segment)
                elif segment:
                    parts += self._cut(self._plain(segment))
            ends.append(len(parts))
        held = self.pieces
        distinct = [p for p in set(parts) if p not in held and p not in self.marked]
        new = dict(zip(distinct, self.words(distinct), strict=True))
        known = held | new | self.marked if len(new) > 10_000 else None
        out, start = [], 0
        for end in ends:
            if known is not None:
                out.append(b"".join([known[p] for p in parts[start:end]]))
            else:
                out.append(b"".join([held[p] if p in held else new[p] if p in new else self.marked[p] for p in parts[start:end]]))
            start = end
        self._remember(new, held)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (null: none) as little-endian 32-bit bytes."""
        # millions of short-lived lists and no cycles: the cycle collector would only look at them again and again
        on = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if on:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        """See encode().

        Texts are cut before each single space or newline, where every word ends anyway;
        the chunks, nearly all met before, are looked up. A chunk that begins a line keeps
        its newline; the one before the first line is cut off again.
        """
        out: list[bytes] = [b""] * len(texts)
        odd: list[int] = []
        plain: list[int] = []
        flat: list[str] = []
        ends: list[int] = []
        for i, text in enumerate(texts):
            if not text:
                continue
            if any(x in text for x in self.open) or "  " in text or "\n\n" in text or "\n " in text or " \n" in text:
                odd.append(i)
                continue
            plain.append(i)
            if self.end:
                flat += text.replace("\n", " ").split(" ")
            else:
                flat += ("\n" + text.replace("\n", " \n")).split(" ")
            ends.append(len(flat))
        ids = list(map(self.cache.get, flat))
        missed, at = [], -1
        while True:
            try:
                at = ids.index(None, at + 1)
            except ValueError:
                break
            missed.append(at)
        spaced: set[int] = set()
        if missed:
            new = self._learn(list({flat[i] for i in missed}))
            for i in missed:
                ids[i] = new[flat[i]]
                if ids[i] is None:
                    spaced.add(bisect_right(ends, i))
        start, cut = 0, len(self.newline)
        for k, (i, end) in enumerate(zip(plain, ends, strict=True)):
            if k in spaced:
                odd.append(i)
            else:
                out[i] = b"".join(ids[start:end])[cut:]
            start = end
        if odd:
            for i, x in zip(odd, self._whole([texts[i] for i in odd]), strict=True):
                out[i] = x
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, with bytes that form no character replaced."""
        n = self.lengths[ids]
        if not len(n):
            return ""
        ends = np.cumsum(n)
        at = np.repeat(self.starts[ids] - ends + n, n) + np.arange(ends[-1])
        return self.flat[at].tobytes().decode("utf-8", "replace")


def forget() -> None:
    """Give up the vocabularies that this worker has loaded, with all that they remember."""
    _LOADED.clear()


def bpe(path: str) -> Bpe:
    """The vocabulary at path, loaded once in each worker and kept until an operator without one runs there."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]
