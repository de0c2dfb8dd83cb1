"""Token ids of whole texts by the tokenizers library, through a cache of pre-tokens.

Byte-level BPE never merges across pre-tokens (a word with its leading space, a run
of digits, of signs, of white space).  A batch is cut into pre-tokens in numpy, each
distinct one is encoded once by the library's BPE model, and the ids of all texts are gathered
from that cache.  The character classes that decide the cuts are not assumed: they
are read off the loaded tokenizer's own pre-tokenizer, for code points below
``FAST``.  A text with any other code point or with the name of an added token
(``<|endoftext|>``), and any text under a tokenizer of another kind, is encoded by the
library as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from leafmill.llm import _text

FAST = 0x250
_LETTER, _NUMBER, _SPACE, _OTHER, _SLOW = range(5)
#: The suffixes that byte-level BPE splits off after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
_SLOTS = 20
_MARK = 0x10FFFF


def load(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _classes(tokenizer) -> np.ndarray | None:
    """Class of each code point below FAST, or None if the pre-tokenizer is not of the known kind."""
    split = tokenizer.pre_tokenizer
    if tokenizer.normalizer is not None or split is None or "ByteLevel" not in repr(split) or "add_prefix_space=False" not in repr(split) or "use_regex=True" not in repr(split):
        return None
    classes = np.full(FAST + 1, _SLOW, dtype=np.uint8)
    cuts = lambda s: [b for _, (_, b) in split.pre_tokenize_str(s)]
    for c in range(FAST):
        x = chr(c)
        if cuts(f"a{x}a") == [3]:
            classes[c] = _LETTER
        elif cuts(f"1{x}1") == [3]:
            classes[c] = _NUMBER
        elif cuts(f"!{x}!") == [3]:
            classes[c] = _OTHER
        else:
            classes[c] = _SPACE
    return classes


class Encoder:
    """Encodes Arrow string columns; one for each Python worker and tokenizer file."""

    _made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.classes = _classes(self.tokenizer)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.alphabet = {c: self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(c))[0][0] for c in range(FAST)} | {_MARK: "\n"} if self.classes is not None else {}
        self.codes = np.random.default_rng(7).integers(1, 1 << 63, FAST + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._clear()

    def _pieces(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
        """Ids of pre-tokens by the library's BPE model, which takes them in its byte alphabet."""
        sizes = ends - starts + 1
        stops = np.cumsum(sizes)
        take = np.repeat(starts - (stops - sizes), sizes) + np.arange(int(stops[-1]))
        take[stops - 1] = 0
        text = points[take]
        text[stops - 1] = _MARK
        mapped = text.tobytes().decode("utf-32-le", "surrogatepass").translate(self.alphabet)
        tokenize = self.tokenizer.model.tokenize
        return [[t.id for t in tokenize(piece)] for piece in mapped.split("\n")[:-1]]

    def _clear(self) -> None:
        self.keys = np.zeros(1 << _SLOTS, dtype=np.uint64)
        self.at = np.zeros(1 << _SLOTS, dtype=np.int64)
        self.size = np.zeros(1 << _SLOTS, dtype=np.int32)
        self.ids = np.zeros(1 << 18, dtype=np.uint32)
        self.used = 0

    def encode(self, column: pa.Array, max_chars: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, pointers of the rows in them) for consecutive groups of rows."""
        texts = [x or "" for x in column.to_pylist()]
        start = 0
        while start < len(texts):
            stop, held = start, 0
            while stop < len(texts) and (stop == start or held + len(texts[stop]) <= max_chars):
                held += len(texts[stop])
                stop += 1
            yield self._encode(texts[start:stop])
            start = stop

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter((len(x) for x in texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        slow = np.ones(len(texts), dtype=bool)
        if self.classes is not None:
            far = np.concatenate([[0], np.cumsum(points >= FAST)])
            slow = far[offsets[1:]] > far[offsets[:-1]]
            for name in self.added:
                slow |= np.fromiter((name in x for x in texts), bool, len(texts))
        if slow.all() and len(texts):
            parts = self._whole(texts)
        elif not slow.any():
            return self._fast(points, offsets)
        else:
            parts = [np.zeros(0, np.uint32)] * len(texts)
            for i, ids in zip(np.flatnonzero(slow), self._whole([texts[i] for i in np.flatnonzero(slow)])):
                parts[i] = ids
            quick = np.flatnonzero(~slow)
            joined = np.concatenate([points[offsets[i] : offsets[i + 1]] for i in quick])
            ids, pointers = self._fast(joined, np.concatenate([[0], np.cumsum(lengths[quick])]))
            for k, i in enumerate(quick):
                parts[i] = ids[pointers[k] : pointers[k + 1]]
        pointers = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), pointers

    def _cuts(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the pre-tokens."""
        n = len(points)
        kind = self.classes[points]
        first = np.zeros(n + 1, dtype=bool)
        first[offsets[:-1]] = True
        first[n] = True
        start = first[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        # white space: all but the last of a run is one pre-token; a last blank joins what follows it
        space = kind == _SPACE
        last = space.copy()
        last[:-1] &= ~space[1:] | first[1:n]
        inner = last & ~first[1 : n + 1]  # something of the same text follows
        begins = start | inner  # the last of a run stands alone or leads
        blank = inner & (points == 32)
        follows = np.flatnonzero(blank) + 1
        begins[follows] = False
        # an apostrophe alone, not led by a blank, takes a contraction with it
        quote = np.flatnonzero((points[:-1] == 39) & (kind[1:] == _LETTER) & begins[:-1] & ~first[1:n])
        for q in quote.tolist():
            tail = bytes(min(int(x), 255) for x in points[q + 1 : q + 3].tolist()).decode("latin-1")
            width = 1 if tail[:1] in CONTRACTIONS else 2 if tail in CONTRACTIONS and not first[q + 2] else 0
            if width:
                begins[q + 1] = False
                after = q + 1 + width
                if after < n:
                    begins[after] = begins[after] or kind[after] == _LETTER
        return np.flatnonzero(begins)

    def _fast(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(points):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts = self._cuts(points, offsets)
        ends = np.append(starts[1:], len(points))
        hashes = _text.span_hashes(self.codes[points], starts, ends)
        hashes[hashes == 0] = 1
        slot = (hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)
        missing = self.keys[slot] != hashes
        extra: dict[int, np.ndarray] = {}
        if missing.any():
            gone = np.flatnonzero(missing)
            fresh, where = np.unique(hashes[gone], return_index=True)
            if self.used and self.used + 4 * len(fresh) > 1 << 22:
                self._clear()
                return self._fast(points, offsets)
            at = gone[where]
            made = self._pieces(points, starts[at], ends[at])
            sizes = np.fromiter(map(len, made), np.int32, len(made))
            flat = np.fromiter((i for ids in made for i in ids), np.uint32, int(sizes.sum()))
            while self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), dtype=np.uint32)])
            self.ids[self.used : self.used + len(flat)] = flat
            begin = self.used + np.concatenate([[0], np.cumsum(sizes)[:-1]])
            self.used += len(flat)
            to = (fresh >> np.uint64(64 - _SLOTS)).astype(np.int64)
            self.keys[to], self.at[to], self.size[to] = fresh, begin, sizes
            at_of, size_of = self.at[slot], self.size[slot]
            lost = np.flatnonzero(self.keys[slot] != hashes)  # two of this batch share a slot
            if len(lost):
                place = np.searchsorted(fresh, hashes[lost])
                known = (place < len(fresh)) & (fresh[np.minimum(place, len(fresh) - 1)] == hashes[lost])
                at_of[lost[known]], size_of[lost[known]] = begin[place[known]], sizes[place[known]]
                for i in lost[~known].tolist():  # evicted just now by a new one
                    h = int(hashes[i])
                    if h not in extra:
                        extra[h] = np.array(self._pieces(points, starts[i : i + 1], ends[i : i + 1])[0], np.uint32)
                        while self.used + len(extra[h]) > len(self.ids):
                            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), dtype=np.uint32)])
                        self.ids[self.used : self.used + len(extra[h])] = extra[h]
                        extra[h] = np.array([self.used, len(extra[h])])
                        self.used += int(extra[h][1])
                    at_of[i], size_of[i] = extra[h]
        else:
            at_of, size_of = self.at[slot], self.size[slot]
        stops = np.cumsum(size_of, dtype=np.int64)
        gather = np.repeat(at_of - (stops - size_of), size_of) + np.arange(int(stops[-1]))
        row = np.searchsorted(starts, offsets)
        pointers = np.concatenate([[0], stops])[row]
        return self.ids[gather], pointers
