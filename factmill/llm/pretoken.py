"""Byte-level BPE by distinct pre-token: the split pattern vectorised over code points, and each distinct piece encoded once.

A chunk of documents becomes one array of code points with a separator between documents. Pre-tokens are runs of one
character class, with one leading space, as the byte-level pattern of these vocabularies cuts them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

from factmill.llm.kernels import U, keyed, mix, powers

SPACE, LETTER, NUMBER, OTHER, BREAK = 0, 1, 2, 3, 4
_CLASSES: np.ndarray | None = None
#: Code points that are expanded into arrays at once.
CHUNK_BYTES = 300_000
#: Entries that a worker keeps before it starts afresh.
CACHE_ENTRIES = 250_000


def classes() -> np.ndarray:
    """Character class of every code point."""
    global _CLASSES
    if _CLASSES is None:
        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
            found = "".join(regex.findall(pattern, every))
            table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
        # regex counts the four information separators as white space; the tokenizer's pattern does not
        table[0x1C:0x20] = OTHER
        _CLASSES = table
    return _CLASSES


def cut(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(joined text, first and end code point, document, hash) of every pre-token of the texts."""
    joined = "\n".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    n = len(points)
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    seps = np.cumsum(sizes + 1)[:-1] - 1
    if not n or not sizes.any():
        none = np.zeros(0, np.int64)
        return joined, none, none, none, np.zeros(0, U)
    kind = classes()[points]
    kind[seps] = BREAK
    head = np.ones(n, bool)
    head[1:] = kind[1:] != kind[:-1]
    runs = np.flatnonzero(head)
    ends = np.append(runs[1:], n)
    of = kind[runs]
    following = np.append(of[1:], BREAK)
    blank = (of == SPACE) & (following != BREAK)
    last = ends[blank] - 1
    head[last] = True
    spaced = last[points[last] == 0x20] + 1
    head[spaced] = False
    quotes = runs[(of == OTHER) & (ends - runs == 1) & (following == LETTER)]
    quotes = quotes[(points[quotes] == 0x27) & head[quotes]]
    if len(quotes):
        padded = np.append(points, [0, 0])
        one, two = padded[quotes + 1], padded[quotes + 2]
        single = np.isin(one, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
        double = np.zeros(len(quotes), bool)
        for a, b in ("re", "ve", "ll"):
            double |= (one == ord(a)) & (two == ord(b))
        double &= ~single
        for hit, width in ((quotes[single], 1), (quotes[double], 2)):
            head[hit + 1] = False
            rest = hit + 1 + width
            rest = rest[rest < n]
            head[rest[kind[rest] == LETTER]] = True
    starts = np.flatnonzero(head)
    stops = np.append(starts[1:], n)
    spans = stops - starts
    pos = np.arange(n) - np.repeat(starts, spans)
    hashes = mix(np.add.reduceat((points.astype(U) + U(1)) * powers(int(spans.max()))[pos], starts) + spans.astype(U) * keyed(1, 5)[0])
    keep = kind[starts] != BREAK
    starts, stops, hashes = starts[keep], stops[keep], hashes[keep]
    return joined, starts, stops, np.searchsorted(seps, starts, "right"), hashes


def pieces(text: str, limit: int = CHUNK_BYTES) -> list[str]:
    """A very long text in parts of about limit characters, cut only before a space between a letter and a letter: no pre-token is cut."""
    out, at = [], 0
    while len(text) - at > limit:
        m = regex.compile(r"(?<=\p{L})(?= \p{L})").search(text, at + limit)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def ranked(tokenizer: Tokenizer) -> tiktoken.Encoding | None:
    """The same merges as byte ranks, which encode a single piece several times faster; None if ids don't follow the merges' order."""
    model = json.loads(tokenizer.to_str())["model"]
    if model["type"] != "BPE" or model["dropout"] or model["unk_token"] or model["ignore_merges"] or model["continuing_subword_prefix"] or model["end_of_word_suffix"]:
        return None
    vocab = model["vocab"]
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in merged or any(a >= b for a, b in zip(merged, merged[1:])):
        return None
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {}
    for token, i in vocab.items():
        if all(c in byte for c in token):
            ranks[bytes(byte[c] for c in token)] = i
    if len(ranks) < len(merged) + 256 or max(ranks[bytes([b])] for b in range(256)) >= min(merged):
        return None
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    ranks = {k: v for k, v in ranks.items() if k.decode("utf-8", "ignore") not in special}
    return tiktoken.Encoding("ranked", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


class Pieces:
    """Ids of each distinct pre-token, encoded once and kept by hash."""

    def __init__(self, file: str):
        self.tokenizer = Tokenizer.from_file(file)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        kind = self.tokenizer.pre_tokenizer
        self.fast = ranked(self.tokenizer)
        self.by_piece = "ByteLevel" in repr(kind) and "use_regex=True" in repr(kind) and "add_prefix_space=False" in repr(kind) and self.tokenizer.normalizer is None
        self.forget()

    def forget(self) -> None:
        self.at: dict[int, int] = {}
        self.flat, self.ends = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        self.size = 0

    def whole(self, text: str) -> bool:
        """Whether the library must see the whole text: it has a special token's string, or the vocabulary is of another kind."""
        return not self.by_piece or any(s in text for s in self.special)

    def lengths(self, strings: list[str]) -> list[int]:
        """How many tokens each pre-token gives; nothing is kept."""
        if self.fast is not None:
            return [len(self.fast.encode_ordinary(x)) for x in strings]
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def lookup(self, joined: str, starts: np.ndarray, stops: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry of each pre-token); new pre-tokens are encoded."""
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.at) + len(distinct) > CACHE_ENTRIES:
            self.forget()
        at, keys = self.at, distinct.tolist()
        entry = [at.get(k, -1) for k in keys]
        new = [i for i, e in enumerate(entry) if e < 0]
        if new:
            strings = [joined[starts[j] : stops[j]] for j in first[new].tolist()]
            if self.fast is not None:
                coded = [self.fast.encode_ordinary(x) for x in strings]
            else:
                coded = [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
            sizes = np.fromiter(map(len, coded), np.int64, len(coded))
            self.flat.append(np.fromiter((x for ids in coded for x in ids), np.uint32, int(sizes.sum())))
            self.ends.append(self.size + np.cumsum(sizes))
            self.size += int(sizes.sum())
            base = len(at)
            for k, i in enumerate(new):
                entry[i] = base + k
                at[keys[i]] = base + k
        return np.asarray(entry, np.int64)[inverse]

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ends of the entries)."""
        if len(self.flat) > 1:
            self.flat, self.ends = [np.concatenate(self.flat)], [np.concatenate(self.ends)]
        return self.flat[0], self.ends[0]

    def encode(self, texts: list[str], want_ids: bool) -> Iterator[np.ndarray | int]:
        """Ids, or only their number, of each text in order."""
        parts, owner = [], []
        direct = {}
        for i, t in enumerate(texts):
            if self.whole(t):
                ids = self.tokenizer.encode(t, add_special_tokens=False).ids
                direct[i] = np.asarray(ids, np.uint32) if want_ids else len(ids)
            else:
                for p in pieces(t):
                    parts.append(p)
                    owner.append(i)
        got: dict[int, list] = {}
        lo = 0
        while lo < len(parts):
            hi, size = lo, 0
            while hi < len(parts) and (hi == lo or size + len(parts[hi]) <= CHUNK_BYTES):
                size += len(parts[hi])
                hi += 1
            joined, starts, stops, docs, hashes = cut(parts[lo:hi])
            if len(starts):
                entry = self.lookup(joined, starts, stops, hashes)
                flat, ends = self.table()
                sizes = ends[entry + 1] - ends[entry]
                total = np.bincount(docs, sizes, hi - lo).astype(np.int64)
            else:
                total = np.zeros(hi - lo, np.int64)
            if want_ids:
                ids = np.zeros(0, np.uint32)
                if len(starts):
                    run = np.cumsum(sizes)
                    ids = flat[np.repeat(ends[entry] - (run - sizes), sizes) + np.arange(run[-1])]
                for k, x in enumerate(np.split(ids, np.cumsum(total)[:-1])):
                    got.setdefault(owner[lo + k], []).append(x)
            else:
                for k, x in enumerate(total.tolist()):
                    got.setdefault(owner[lo + k], []).append(x)
            lo = hi
        for i in range(len(texts)):
            if i in direct:
                yield direct[i]
            elif want_ids:
                x = got[i]
                yield x[0] if len(x) == 1 else np.concatenate(x)
            else:
                yield sum(got[i])


_OPEN: dict[str, Pieces] = {}


def open_pieces(file: str) -> Pieces:
    """The worker's vocabulary, opened once."""
    if file not in _OPEN:
        _OPEN[file] = Pieces(file)
    return _OPEN[file]
