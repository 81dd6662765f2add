"""Byte-level BPE as a bounded-lookahead streaming transducer.

The merge list decides how far to the right of a token the text can still change it. ``lookahead``
computes a bound from the list; ``Transducer.feed`` then emits a token as soon as that many bytes
behind it are known, so that a word of any length is encoded with constant memory. Decoding is an
incremental state machine from bytes to text.

Why the bound suffices. A token t is changed only if a token on its right spine (t, its right part,
the right part of that ...) is taken by a rule of its right neighbour first. That neighbour v must
have been formed, by rules of lower rank than the rule that takes it, and must not itself have lost
its right end to a rule of still lower rank. So the reach of rule (u, v) is len(v) plus the largest
reach of a rule of lower rank whose left side lies on the right spine of v. Where a boundary of the
encoding of xy falls between x and y, both sides are encoded independently, so encoding goes on from
the last emitted token.
"""

from __future__ import annotations

import base64
import codecs
import heapq
import importlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import regex

#: Characters that the splitter sees at once, and how far it looks: at a contraction's three, and one behind a run of spaces.
CHARS, LOOKS = 1 << 16, 4
#: Bytes of a word from which on it is streamed.
LONG = 200

#: Fixed value: the published split pattern of the byte_bpe_* vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """The file of tokenizer ``name``: in ``folder``, else where the installed public_tokenizers has it."""
    if folder:
        return f"{folder}/{name}"
    return importlib.import_module("public_tokenizers").path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    """token -> rank of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_list(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes, int]]:
    """The rules (left, right, rank), by rank: each token of two or more bytes, cut where its last merge was."""
    rules = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1:
            parts = _merge(token, ranks, rank)
            if len(parts) == 2:
                rules.append((parts[0], parts[1], rank))
    return rules


def _merge(piece: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """BPE of a short piece with the rules of rank less than ``below``."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = below, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1], below)
            if r < best:
                best, at = r, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def lookahead(rules: list[tuple[bytes, bytes, int]]) -> int:
    """Bytes behind a token that suffice to know that it stays; see the module's text."""
    right = {u + v: v for u, v, _ in rules}
    reach: dict[bytes, int] = {}
    most = 0
    for u, v, _ in rules:
        s: bytes | None = v
        far = 0
        while s is not None:
            far = max(far, reach.get(s, 0))
            s = right.get(s)
        far += len(v)
        reach[u] = max(reach.get(u, 0), far)
        most = max(most, far)
    return most


class Transducer:
    """Encoder and decoder for one byte-level BPE vocabulary. Not shared between threads."""

    #: Distinct words whose ids are kept; then the store is emptied. It bounds memory, not results.
    KEEP = 300_000

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.split = regex.compile(pattern)
        self._lookahead: int | None = None
        self.longest = max(map(len, ranks))
        self._known = _Known(self)

    @property
    def lookahead(self) -> int:
        if self._lookahead is None:
            self._lookahead = lookahead(merge_list(self.ranks))
        return self._lookahead

    # encode

    def window(self, piece: bytes) -> list[bytes]:
        """BPE of one window: merges by (rank, position) from a heap over a linked list of parts."""
        if piece in self.ranks:
            return [piece]
        n = len(piece)
        if n < 40:
            return _merge(piece, self.ranks, 1 << 30)
        end = list(range(1, n + 1))  # end of the part that begins here, 0 when merged away
        before = list(range(-1, n - 1))
        ranks, heap = self.ranks, []
        for i in range(n - 1):
            if (r := ranks.get(piece[i : i + 2])) is not None:
                heap.append((r, i, i + 1, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if end[i] != j or j >= n or end[j] != k:
                continue
            end[i], end[j] = k, 0
            if k < n:
                before[k] = i
                if (r := ranks.get(piece[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, k, end[k]))
            if (p := before[i]) >= 0 and (r := ranks.get(piece[p:k])) is not None:
                heapq.heappush(heap, (r, p, i, k))
        out, i = [], 0
        while i < n:
            out.append(piece[i : end[i]])
            i = end[i]
        return out

    def feed(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Ids of one word that arrives in chunks, each as soon as it is stable."""
        held, far = b"", self.lookahead
        step = 4 * (far + self.longest)
        for c in chunks:
            for at in range(0, len(c), step):
                held += c[at : at + step]
                if len(held) < step:
                    continue
                done = 0
                for t in self.window(held):
                    if done + len(t) + far > len(held):
                        break
                    done += len(t)
                    yield self.ranks[t]
                held = held[done:]
        for t in self.window(held) if held else ():
            yield self.ranks[t]

    def word(self, word: str) -> tuple[int, ...]:
        b = word.encode("utf-8", "replace")
        if len(b) <= LONG:
            return tuple(self.ranks[t] for t in self.window(b))
        return tuple(self.feed([b]))

    def words(self, text: str) -> Iterator[list[str] | tuple[int, int]]:
        """The words of a text in order: lists of short ones, and (start, end) of a word that no window holds.

        The splitter sees a window of CHARS characters at a time. It looks at most LOOKS characters past a word's beginning or end,
        so words that end at least so far before the window's end are as in the whole text; the rest is seen again.
        """
        at, n, split = 0, len(text), self.split
        if n <= CHARS:
            yield split.findall(text)
            return
        while at < n:
            part = text[at : at + CHARS]
            found = split.findall(part)
            if at + CHARS < n:
                left = len(part)
                while found and len(part) - left < LOOKS:
                    left -= len(found.pop())
                if not found:  # one word fills the window
                    end = split.match(text, at).end()
                    yield at, end
                    at = end
                    continue
                at += left
            else:
                at = n
            yield found

    def encode_stream(self, text: str | None) -> Iterator[tuple[int, ...]]:
        """Ids in groups, as they become stable. Memory beside the text is bounded whatever the length of the text and of its words."""
        known = self._known
        for found in self.words(text) if text else ():
            if isinstance(found, list):
                yield from map(known.__getitem__, found)
            else:
                lo, hi = found
                chunks = (text[i : min(i + CHARS, hi)].encode("utf-8", "replace") for i in range(lo, hi, CHARS))
                yield from ((i,) for i in self.feed(chunks))

    def encode(self, text: str | None) -> array:
        """Ids without special tokens, four bytes each; null and empty text give none."""
        return array("i", chain.from_iterable(self.encode_stream(text)))

    def count(self, text: str | None) -> int:
        return sum(map(len, self.encode_stream(text)))

    # decode

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of ids, one piece for each id; bytes of an unfinished character wait in the decoder's state."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        tokens = self.tokens
        for i in ids:
            if s := state.decode(tokens[i]):
                yield s
        if s := state.decode(b"", final=True):
            yield s

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decode_stream(ids))


class _Known(dict):
    """word -> ids; words of up to 200 characters are kept."""

    def __init__(self, of: Transducer) -> None:
        super().__init__()
        self.of = of

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.of.word(word)
        if len(word) <= 200:
            if len(self) >= Transducer.KEEP:
                self.clear()
            self[word] = ids
        return ids


_MADE: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The transducer of a vocabulary file, made once in each Python worker."""
    if path not in _MADE:
        _MADE[path] = Transducer(read_ranks(path))
    return _MADE[path]
