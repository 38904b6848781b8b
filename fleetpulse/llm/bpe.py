"""BPE encoding by speculation: greedy longest matches first, a check of every adjacent pair, exact merging for the rest.

A sequence of vocabulary tokens is the BPE encoding of a word if every token encodes to itself and no merge across a
border of two neighbours would have come before the merges inside them. Both conditions are checked for many words at
once in numpy; only words that fail go through the merge loop. The vocabulary file is a parameter, never a copy.

Null texts count as empty and give no token; an empty table gives an empty table; repeated rows are encoded alike.
Very long texts are cut into words, so only the result of a text is as long as the text. Input columns other than the
text pass through unless an output column has their name, which then replaces them.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import free_name, importable

NEVER = np.int64(1) << 40
NO_RANK = 1 << 40
#: Words of up to so many letters are merged by looking at all pairs each time.
SHORT = 40
#: Words a worker remembers before it starts anew.
REMEMBERED_WORDS = 400_000
ROWS_AT_ONCE = 128


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordBpe:
    """One vocabulary whose words end in a suffix, with tables for the pair check."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.vocab | self.special).items()}
        size = max(self.names) + 1
        self.longest = max(map(len, self.vocab))
        self.reach: dict[str, int] = {}  # length of the longest token that begins with three letters
        for t in self.vocab:
            if len(t) > 2:
                self.reach[t[:3]] = max(len(t), self.reach.get(t[:3], 0))
        pairs = [(m.split(" ", 1) if isinstance(m, str) else m) for m in model["merges"]]
        self.merge = {(self.vocab[a], self.vocab[b]): (r, self.vocab[a + b]) for r, (a, b) in enumerate(pairs)}
        self.made = np.full(size, -1, np.int64)  # rank of the merge that makes a token; -1: a letter
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        for (a, b), (r, t) in self.merge.items():
            if self.made[t] < 0 or r < self.made[t]:
                self.made[t], self.left[t], self.right[t] = r, a, b
        keys = np.array([a * size + b for a, b in self.merge], np.int64)
        order = np.argsort(keys)
        self.size, self.keys = size, keys[order]
        self.ranks = np.array([r for r, _ in self.merge.values()], np.int64)[order]
        self.letters = {b: c for b, c in byte_letters().items() if chr(b) != c}
        letters = "|".join(regex.escape(t) for t in self.special)
        self.cut = regex.compile(f"({letters})") if letters else None
        space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        self.word = regex.compile(rf"\p{{L}}+|\p{{N}}|'s|'t|'re|'ve|'m|'ll|'d|[^{space}\p{{L}}\p{{N}}]+")
        self.whole = self._reproducible()
        self.known: dict[str, str] = {}  # ids of a piece
        self.spelt: dict[str, str] = {}  # its tokens

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge joins the end of ``a`` with the start of ``b`` before either is consumed.

        Walks back in time: of the two tokens at the border, the one made later is replaced by its part at the border.
        Merges of equal rank go from left to right, so at equal rank the right token was made later.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        good = np.ones(len(a), bool)
        gone_a = np.full(len(a), NEVER) if before is None else before.astype(np.int64)
        gone_b = gone_a - (before is not None)
        at = np.arange(len(a))
        while len(at):
            rank = self._rank(a, b)
            joined = (rank < gone_a) & (rank <= gone_b)
            good[at[joined]] = False
            made_a, made_b = self.made[a], self.made[b]
            on = ~joined & ((made_a >= 0) | (made_b >= 0))
            first = made_a > made_b
            gone_a, gone_b = np.where(first, made_a, gone_a)[on], np.where(first, gone_b, made_b)[on]
            a, b, at = np.where(first, self.right[a], a)[on], np.where(first, b, self.left[b])[on], at[on]
        return good

    def _reproducible(self) -> np.ndarray:
        """Tokens that come out whole when their own letters are merged."""
        made = np.flatnonzero(self.made >= 0)
        made = made[np.argsort(self.made[made])]
        fits = self.compatible(self.left[made], self.right[made], self.made[made])
        good = np.ones(self.size, bool)
        for t, ok in zip(made.tolist(), fits.tolist()):
            good[t] = ok and good[self.left[t]] and good[self.right[t]]
        return good

    def speculate(self, word: str) -> list[int] | None:
        """Greedy longest matches from the left; None if a letter is unknown."""
        vocab, reach, n, out, i = self.vocab, self.reach, len(word), [], 0
        while i < n:
            whole = vocab.get(word[i:] + self.suffix) if n - i <= self.longest else None
            if whole is not None:
                out.append(whole)
                return out
            for j in range(min(n - 1, i + reach.get(word[i : i + 3], 2)), i, -1):
                token = vocab.get(word[i:j])
                if token is not None:
                    out.append(token)
                    i = j
                    break
            else:
                return None
        return out

    def merge_exactly(self, word: str) -> list[int]:
        """Merges by rank, then from the left; letters missing in the vocabulary are left out."""
        parts = [self.vocab.get(c) for c in word[:-1]] + [self.vocab.get(word[-1] + self.suffix)]
        ids = [p for p in parts if p is not None]
        return self.merge_short(ids) if len(ids) <= SHORT else self.merge_long(ids)

    def merge_short(self, ids: list[int]) -> list[int]:
        """Looks for the least rank among all pairs after each merge."""
        merge, never = self.merge, (NO_RANK, -1)
        found = [merge.get(p, never) for p in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best[0] == NO_RANK:
                break
            k = found.index(best)
            ids[k : k + 2] = [best[1]]
            del found[k]
            if k:
                found[k - 1] = merge.get((ids[k - 1], ids[k]), never)
            if k < len(found):
                found[k] = merge.get((ids[k], ids[k + 1]), never)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """Keeps the pairs in a heap, and the word as a linked list."""
        following, leading = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r, k, t, a, b) for k, (a, b) in enumerate(zip(ids, ids[1:])) for r, t in [self.merge.get((a, b), (NO_RANK, -1))] if t >= 0]
        heapq.heapify(heap)
        while heap:
            _, k, token, a, b = heapq.heappop(heap)
            j = following[k]
            if ids[k] != a or j >= len(ids) or ids[j] != b:
                continue
            ids[k], ids[j] = token, -1
            following[k] = following[j]
            if following[k] < len(ids):
                leading[following[k]] = k
            for x, y in ((leading[k], k), (k, following[k])):
                if x >= 0 and y < len(ids) and (found := self.merge.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (found[0], x, found[1], ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word (in the vocabulary's letters)."""
        guesses = [self.speculate(w) for w in words]
        flat = np.fromiter((t for g in guesses if g for t in g), np.int64)
        owner = np.repeat(np.arange(len(words)), [len(g) if g else 0 for g in guesses])
        bad = np.zeros(len(words), bool)
        bad[[k for k, g in enumerate(guesses) if g is None]] = True
        bad[owner[~self.whole[flat]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        key, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        fits = self.compatible(key // self.size, key % self.size)
        bad[owner[inner[~fits[back]]]] = True
        for k in np.flatnonzero(bad).tolist():
            guesses[k] = self.merge_exactly(words[k])
        return guesses

    def pieces(self, text: str) -> list[str]:
        """Words of a text after composition and lower-casing of single letters."""
        text = unicodedata.normalize("NFC", text)
        return self.word.findall(text.replace("Σ", "σ").lower())

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > REMEMBERED_WORDS:
            self.known.clear()
            self.spelt.clear()
            new = list(pieces)
        written = [p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(self.letters) for p in new]
        for piece, ids in zip(new, self.encode_words(written)):
            self.known[piece] = " ".join(map(str, ids))
            self.spelt[piece] = " ".join(map(self.names.__getitem__, ids))

    def encode(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """Number of tokens, ids and tokens (both joined by one space) of each text."""
        cuts = []
        for text in texts:
            parts = self.cut.split(text or "") if self.cut else [text or ""]
            cuts.append([[p] if k % 2 else self.pieces(p) for k, p in enumerate(parts)])
        self.learn(set().union(*(p for parts in cuts for p in parts[::2])))
        out = []
        for parts in cuts:
            ids = [self.known[w] if k % 2 == 0 else str(self.special[w]) for k, p in enumerate(parts) for w in p] if len(parts) > 1 else map(self.known.__getitem__, parts[0])
            tokens = [self.spelt[w] if k % 2 == 0 else w for k, p in enumerate(parts) for w in p] if len(parts) > 1 else map(self.spelt.__getitem__, parts[0])
            joined = " ".join(ids)
            out.append((joined.count(" ") + bool(joined), joined, " ".join(tokens)))
        return out


_LOADED: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def bpe_encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Each row with ``n_tokens`` (long), ``ids_text`` (decimal ids, one space between) and ``decoded`` instead of the text.

    ``decoded`` is what a vocabulary without a decoder gives back: its tokens, one space between.
    """
    added = ("n_tokens", "ids_text", "decoded")
    keep = [c for c in docs.columns if c != text and c not in added]
    hidden = free_name(keep, "__text")
    lean = importable(docs).select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(hidden))
    schema = lean.drop(hidden).selectExpr("*", "0L AS n_tokens", "'' AS ids_text", "'' AS decoded").schema

    def run(batches):
        bpe = load(path)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                rows = bpe.encode(part.column(len(keep)).to_pylist())
                own = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *own], names=[*keep, *added])

    return lean.mapInArrow(run, schema)
