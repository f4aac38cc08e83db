"""Public tokenizers inside tasks: each distinct word of a worker's texts is encoded once, through the library.

The two .json tokenizers never merge across the places where texts are split here, so a text's ids are the ids of its
pieces put together; texts where that could differ go whole through the library."""

from __future__ import annotations

import functools
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces that one worker keeps; further ones are encoded anew in each chunk. Bounds memory, not results.
CACHE_WORDS = 600_000
_DOUBLE_SPACE = re.compile(r"\s\s")
_TAIL = ".,;:!?"


def _plain(word: str) -> bool:
    """Letters only, of the Latin blocks: one pre-token, whatever follows."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0250")


@functools.lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _specials(tok) -> list[str]:
    return [t.content for t in tok.get_added_tokens_decoder().values()]


class PieceCounts:
    """Token counts of whole texts under a byte-level tokenizer.

    Texts are cut before each space. Where every run of white space is a single character, no pre-token of the
    tokenizer spans such a cut; other texts, and those holding special strings, are encoded whole."""

    def __init__(self, path: str):
        self.tok, self.counts = load(path), {}
        self.special = _specials(self.tok)

    def _encode(self, pieces: list[str]) -> dict[str, int]:
        return dict(zip(pieces, (len(e.ids) for e in self.tok.encode_batch_fast(pieces, add_special_tokens=False)), strict=True))

    def of(self, texts: list[str]) -> list[int]:
        whole = {i for i, t in enumerate(texts) if any(s in t for s in self.special) or _DOUBLE_SPACE.search(t)}
        split = [[] if i in whole else t.split(" ") for i, t in enumerate(texts)]
        known, new = self.counts, set()
        for words in split:
            new.update(words[1:])
        new = [w for w in new if w not in known]
        # A word with closing punctuation is two pre-tokens: the word, and the punctuation.
        cut = {w: (b, w[len(b) :]) for w in new if (b := w.rstrip(_TAIL)) != w and _plain(b)}
        bases = {b for b, _ in cut.values() if b not in known}.union(w for w in new if w not in cut)
        found = {k: v for k, v in zip(bases, self._encode([" " + b for b in bases]).values(), strict=True)} if bases else {}
        tails = {t for _, t in cut.values()}
        tail = self._encode(list(tails)) if tails else {}
        for w, (b, t) in cut.items():
            found[w] = (found[b] if b in found else known[b]) + tail[t]
        if len(known) < CACHE_WORDS:
            known.update(found)
            look = known
        else:
            look = _Layers(found, known)
        get = look.__getitem__
        out = [sum(map(get, words[1:])) if words else 0 for words in split]
        firsts = [(i, w[0]) for i, w in enumerate(split) if w and w[0]]
        for rows in (firsts, [(i, texts[i]) for i in sorted(whole)]):
            for (i, _), e in zip(rows, self.tok.encode_batch_fast([t for _, t in rows], add_special_tokens=False), strict=True):
                out[i] += len(e.ids)
        return out


class _Layers(dict):
    """New pieces first, then the kept ones."""

    def __init__(self, new: dict, kept: dict):
        super().__init__(new)
        self.kept = kept

    def __missing__(self, key):
        return self.kept[key]


class _Numbers(dict):
    """Numbers keys in the order in which they are first looked up; `new` holds those since it was last emptied."""

    def __init__(self, keys=()):
        super().__init__(zip(keys, range(len(keys)), strict=True))
        self.new: list[bytes] = []

    def __missing__(self, key: bytes) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


#: Punctuation that is cut off a word's end: one pre-token, whatever it follows. No apostrophe: it may start one.
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Distinct words that one worker keeps the ids of; a bound on memory, like CACHE_WORDS.
WORDS = 300_000
#: Words joined by spaces and encoded at once.
_AT_ONCE = 2000


def _ranges(a: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges of a that have these starts and sizes, one after the other."""
    total = int(size.sum())
    kind = np.int32 if max(total, len(a)) < 1 << 31 else np.int64
    return a[np.repeat((start - (np.cumsum(size) - size)).astype(kind), size) + np.arange(total, dtype=kind)]


class WordIds:
    """Token ids of whole texts under a tokenizer that lower-cases, drops white space and marks each pre-token's last id.

    Texts are cut at ASCII white space and their distinct words are looked up, chunk by chunk. A word of letters and closing marks is two parts, and any other word
    is one; the ids of all words known to a worker lie in one array, and a text is a gather of ranges from it. Parts of
    letters are single pre-tokens, so many are encoded as one text and told apart by the marked ids; the others go
    through the library one by one."""

    def __init__(self, path: str):
        self.tok = load(path)
        suffix = json.loads(self.tok.to_str())["model"]["end_of_word_suffix"]
        self.last = np.zeros(self.tok.get_vocab_size() + 1, bool)
        self.last[[i for t, i in self.tok.get_vocab().items() if t.endswith(suffix)]] = True
        self.special = sorted({s[:2] for s in _specials(self.tok)})
        self.words = _Numbers()
        self.start, self.size, self.hits = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _forget(self, most: int) -> None:
        """Keep this many words, those that were used most."""
        keep = np.sort(np.argpartition(-self.hits, most)[:most])
        words, size = list(self.words), self.size[keep]
        self.ids = _ranges(self.ids, self.start[keep], size)
        self.start, self.size, self.hits = np.cumsum(size) - size, size, self.hits[keep] // 2
        self.words = _Numbers([words[k] for k in keep.tolist()])

    def _encode(self, parts: list[bytes]) -> tuple[list[int], np.ndarray]:
        """Ids of parts, one after the other, and how many each has."""
        texts = [p.decode() for p in parts]
        letters = [i for i, t in enumerate(texts) if _plain(t)]
        ids, ends, size = [], [], np.zeros(len(parts), np.int64)
        for a in range(0, len(letters), _AT_ONCE):
            some = letters[a : a + _AT_ONCE]
            got = self.tok.encode_batch_fast([" ".join([texts[i] for i in some])], add_special_tokens=False)[0].ids
            at = np.flatnonzero(self.last[got])
            if len(at) != len(some):  # a letter that the tokenizer takes apart: one by one
                each = [e.ids for e in self.tok.encode_batch_fast([texts[i] for i in some], add_special_tokens=False)]
                got, at = list(chain.from_iterable(each)), np.cumsum(list(map(len, each))) - 1
            size[some] = np.diff(at, prepend=-1)
            ids.append(np.array(got, np.uint32))
            ends.append(np.array(some))
        others = [i for i, n in enumerate(size.tolist()) if not n]
        for i, e in zip(others, self.tok.encode_batch_fast([texts[i] for i in others], add_special_tokens=False), strict=True):
            size[i] = len(e.ids)
            ids.append(np.array(e.ids, np.uint32))
            ends.append(np.array([i]))
        order = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        start = np.zeros(len(parts), np.int64)
        start[order] = np.cumsum(size[order]) - size[order]
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        return _ranges(flat, start, size), size

    def _append(self, ids: np.ndarray, size: np.ndarray) -> None:
        """Ids of words that were just numbered, in that order."""
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.hits = np.concatenate([self.hits, np.zeros(len(size), np.int64)])
        self.ids = np.concatenate([self.ids, ids])
        self.words.new = []

    def _close(self, id_: int) -> int:
        """Number of a word that stands for this one id; no word of a text holds a space."""
        number = self.words[b" %d" % id_]
        if self.words.new:
            self._append(np.array([id_], np.uint32), np.ones(1, np.int64))
        return number

    def _learn(self, words: list[bytes]) -> None:
        """Ids of words that were just numbered, from those of their parts: known words, or new ones of this chunk."""
        old, number, new, pair = len(self.start), self.words.get, {}, []
        for w in words:
            b = w.rstrip(_MARKS)
            for x in (b, w[len(b) :]) if len(b) < len(w) and (b.isalpha() or _plain(b.decode())) else (w, b""):
                n = number(x, old) if x else -1
                pair.append(n if n < old else old + new.setdefault(x, len(new)))
        ids, size = self._encode(list(new))
        size = np.concatenate([self.size, size, [0]])
        start = np.concatenate([self.start, len(self.ids) + np.cumsum(size[old:]) - size[old:]])
        pair = np.array(pair, np.int64)
        self._append(_ranges(np.concatenate([self.ids, ids]), start[pair], size[pair]), size[pair].reshape(-1, 2).sum(axis=1))

    def of(self, texts: pa.Array | list[str], close: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text; the id `close` is put after each text. A null text is empty."""
        if len(self.words) > (most := min(WORDS, CACHE_WORDS)):
            self._forget(most // 2)
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        lower = pc.ascii_lower(texts)
        # Special strings are matched as they are written, so texts that may hold one aren't lower-cased.
        special = [pc.match_substring(texts, s) for s in self.special]
        if special and any(pc.any(m).as_py() for m in special):
            lower = pc.if_else(functools.reduce(pc.or_, special), texts, lower)
        split = pc.ascii_split_whitespace(lower)
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        number = np.fromiter(map(self.words.__getitem__, coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)), np.int64, len(coded.dictionary))
        if self.words.new:
            self._learn(self.words.new)
        at = coded.indices.to_numpy(zero_copy_only=False)
        self.hits[number] += np.bincount(at, minlength=len(number))
        # First the ids of the chunk's distinct words, one after the other, then a range of them for each word.
        if close is not None:
            number = np.append(number, self._close(close))
            words, at = at, np.full(len(at) + len(texts), len(number) - 1, np.int32)
            at[np.arange(len(words)) + np.repeat(np.arange(len(texts)), counts)] = words
            counts = counts + 1
        size = self.size[number]
        own = _ranges(self.ids, self.start[number], size)
        start, size = (np.cumsum(size) - size)[at], size[at]
        per_word = np.concatenate([[0], np.cumsum(size)])
        return _ranges(own, start, size), np.diff(per_word[np.concatenate([[0], np.cumsum(counts)])])


#: Two white-space characters in a row, or one in front of the text's end: what cutting before spaces could change.
_SPACES = "[\\t-\\r\\x1c- \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def cuttable(texts: pa.Array, special: list[str]) -> np.ndarray:
    """Which texts are the same tokens, cut before each space or not: those without a run of white space, white space at
    an end, or a special string."""
    whole = pc.match_substring_regex(texts, f"{_SPACES}{_SPACES}|^{_SPACES}|{_SPACES}$")
    for s in special:
        whole = pc.or_(whole, pc.match_substring(texts, s))
    return ~whole.to_numpy(zero_copy_only=False)


#: Distinct pieces that one worker keeps the ids of, before the half that was used most is left.
PIECES = 600_000
#: Letters of the Latin blocks, as _plain() has them.
_LATIN = "".join(c for c in map(chr, range(0x250)) if c.isalpha())


def _cut(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Words of letters and closing marks without their marks, and these; other words whole, and nothing."""
    tail, head = pc.utf8_ltrim(words, characters=_LATIN), pc.ascii_rtrim(words, characters=_MARKS.decode())
    cut = pc.and_(pc.equal(pc.ascii_rtrim(tail, characters=_MARKS.decode()), ""), pc.less(pc.binary_length(tail), pc.binary_length(words)))
    return pc.if_else(cut, head, words), pc.if_else(cut, tail, "")


class PieceIds(WordIds):
    """Token ids of whole texts under a byte-level tokenizer.

    Texts are cut before each space and line feed, and a chunk's distinct words into letters and closing marks: letters,
    marks and a line feed by itself are pre-tokens of their own, so each word of letters is encoded once whatever marks
    follow it. Parts are looked up as WordIds looks up words: one that follows a space by its bytes alone, which start
    with the line feed if that stands before it, and any other (a text's first, marks) by its bytes after a space. Texts that
    cuttable() leaves out go whole through the library."""

    def __init__(self, path: str):
        self.tok = load(path)
        self.special = _specials(self.tok)
        self.opens = np.zeros(self.tok.get_vocab_size() + 1, bool)
        self.opens[[i for t, i in self.tok.get_vocab().items() if t[0] in "\u0120\u010a"]] = True  # a space or line feed, byte-level
        self.words = _Numbers()
        self.start, self.size, self.hits = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        each = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast([p.decode() for p in parts], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *each]), np.fromiter(map(len, each), np.int64, len(each))

    def _encode_pieces(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts with the space or line feed before them, one after the other: many make one text, in which a token
        that starts with either starts a part."""
        texts = [(b" " + b" ".join(parts[a : a + _AT_ONCE])).replace(b" \n", b"\n") for a in range(0, len(parts), _AT_ONCE)]
        ids, _ = self._encode(texts)
        return ids, np.diff(np.append(np.flatnonzero(self.opens[ids]), len(ids)))

    def _numbers(self, parts: pa.Array, spaced: bool) -> np.ndarray:
        coded = parts.dictionary_encode()
        keys = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
        number = np.fromiter(map(self.words.__getitem__, keys if spaced else [b" " + k for k in keys]), np.int64, len(keys))
        if new := self.words.new:
            self._append(*(self._encode_pieces(new) if spaced else self._encode([k[1:] for k in new])))
        return number[coded.indices.to_numpy(zero_copy_only=False)]

    def of(self, texts: pa.Array | list[str], close: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text; the id `close` is put after each text. A null text is empty."""
        if len(self.words) > PIECES:
            self._forget(PIECES // 2)
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        plain = cuttable(texts, self.special)
        split = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(plain)), "\n", " \n"), " ")
        many = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(many) - many
        # Units of all texts: distinct words after a space or line feed, distinct first words, and whole texts.
        flat = split.flatten()
        coded, opening = flat.dictionary_encode(), flat.take(pa.array(first)).dictionary_encode()
        (head, tail), (opened, closed) = _cut(coded.dictionary), _cut(opening.dictionary)
        spaced, other = self._numbers(head, True), self._numbers(pa.concat_arrays([tail, closed, opened]), False)
        n = len(head) + len(opened)
        pair = np.stack([np.append(spaced, other[n:]), other[:n]], axis=1)
        unit = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        unit[first] = len(head) + opening.indices.to_numpy(zero_copy_only=False)
        np.add.at(self.hits, pair, np.bincount(unit, minlength=len(pair))[:, None])
        each = self.size[pair]
        # First the ids of the units, one after the other, then a range of them for each place of a unit.
        ids, size = self._encode(texts.filter(pa.array(~plain)).cast(pa.binary()).to_pylist())
        own = np.concatenate([_ranges(self.ids, self.start[pair].ravel(), each.ravel()), ids])
        size = np.concatenate([each.sum(axis=1), size])
        count = np.ones(len(texts), np.int64)
        count[plain] = many
        begin = np.cumsum(count) - count
        if not plain.all():
            among, unit = unit, np.empty(int(count.sum()), np.int64)
            unit[begin[~plain]] = len(pair) + np.arange(int((~plain).sum()))
            unit[_ranges(np.arange(len(unit)), begin[plain], many)] = among
        start, size = (np.cumsum(size) - size)[unit], size[unit]
        out = _ranges(own, start, size)
        counts = np.add.reduceat(size, begin) if len(begin) else count
        if close is not None:
            out = np.insert(out, np.cumsum(counts), close)
            counts = counts + 1
        return out, counts
