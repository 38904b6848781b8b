"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. A letter trigram is the product (binding) of its
letters' vectors, permuted by two, one and no places; a text is the sum (bundle) of its trigrams' vectors; a language is
the sum of its training texts' unit vectors. A text gets the language whose profile has the largest cosine with it.

Trigrams are taken from lower-cased words padded by a blank, so a text with one letter has a vector. A text that is null or has
no letter is ``und`` with score 0; negative cosines score 0; ties go to the first language in order. Rows whose text or
label is null teach nothing; without any labelled text everything is ``und``. Repeated rows count as often as they occur.
Texts are read whole. What is learned and sent to the tasks is one vector per language value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import free_name, importable

UNKNOWN = "und"
BLANK = 32
#: Unit vectors are summed as whole numbers, so that the sum doesn't depend on the order of the rows.
SCALE = 1 << 24
ROWS_AT_ONCE = 32
#: Trigram vectors a worker keeps.
KEPT_VECTORS = 1 << 15


class Letters:
    """Lower-cased letters, everything else a blank; and their vectors."""

    def __init__(self, dims: int, seed: int):
        self.dims, self.seed = dims, seed
        self.table = np.zeros(0x110000, np.int32)
        self.seen = np.zeros(0x110000, bool)
        self.letter: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.vectors = np.empty((1024, dims), np.float32)

    def fold(self, codes: np.ndarray) -> np.ndarray:
        for c in np.unique(codes[~self.seen[codes]]).tolist():
            self.table[c] = ord(chr(c).lower()[0]) if chr(c).isalpha() else BLANK
            self.seen[c] = True
        return self.table[codes]

    def vector(self, code: int) -> np.ndarray:
        if code not in self.letter:
            if len(self.letter) >= KEPT_VECTORS:
                self.letter.clear()
            draw = np.random.Generator(np.random.Philox(key=[self.seed, code]))
            self.letter[code] = (draw.integers(0, 2, self.dims, dtype=np.int8) * 2 - 1).astype(np.float32)
        return self.letter[code]

    def trigrams(self, keys: np.ndarray) -> np.ndarray:
        """Rows of the vectors of packed trigrams."""
        new = [k for k in keys.tolist() if k not in self.rows]
        if len(self.rows) + len(new) > KEPT_VECTORS:
            self.rows.clear()
            new = keys.tolist()
        need = len(self.rows) + len(new)
        if need > len(self.vectors):
            grown = np.empty((max(need, 2 * len(self.vectors)), self.dims), np.float32)
            grown[: len(self.vectors)] = self.vectors
            self.vectors = grown
        for k in new:
            a, b, c = (self.vector(x) for x in (k >> 42, k >> 21 & 0x1FFFFF, k & 0x1FFFFF))
            self.vectors[len(self.rows)] = np.roll(a, 2) * np.roll(b, 1) * c
            self.rows[k] = len(self.rows)
        return np.fromiter(map(self.rows.__getitem__, keys.tolist()), np.int64, len(keys))

    def bundles(self, texts: list[str | None]) -> np.ndarray:
        """Unit vectors of texts; zero where a text has no letter."""
        out = np.zeros((len(texts), self.dims), np.float32)
        parts, owner = [], []
        for k, text in enumerate(texts):
            if text:
                codes = self.fold(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32))
                codes = np.concatenate(([BLANK], codes, [BLANK]))
                codes = codes[~((codes == BLANK) & np.concatenate(([False], codes[:-1] == BLANK)))].astype(np.int64)
                if len(codes) > 2:
                    keys = codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:]
                    keys, counts = np.unique(keys[codes[1:-1] != BLANK], return_counts=True)
                    parts.append((keys, counts))
                    owner.append(k)
        if not parts:
            return out
        every, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        rows, counts, start = self.trigrams(every), np.zeros((len(parts), len(every)), np.float32), 0
        for k, (keys, n) in enumerate(parts):
            counts[k, at[start : start + len(keys)]] = n
            start += len(keys)
        sums = counts @ self.vectors[rows]
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        out[owner] = np.divide(sums, norms, out=np.zeros_like(sums), where=norms > 0)
        return out


_LETTERS: dict[tuple[int, int], Letters] = {}


def letters(dims: int, seed: int) -> Letters:
    if (dims, seed) not in _LETTERS:
        _LETTERS[dims, seed] = Letters(dims, seed)
    return _LETTERS[dims, seed]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(start, ROWS_AT_ONCE)


class LanguageProfiles:
    def __init__(self, langs: list[str], profiles: np.ndarray, dims: int, seed: int):
        self.langs, self.profiles, self.dims, self.seed = langs, profiles, dims, seed

    @classmethod
    def fit(cls, docs: DataFrame, text: str = "text", label: str = "lang", dims: int = 1024, seed: int = 7) -> LanguageProfiles:
        """Sums the unit vectors of each label's texts in every partition, then over partitions by (label, place)."""
        labelled = importable(docs).select(F.col(f"`{text}`").alias("text"), F.col(f"`{label}`").cast("string").alias("lang")).dropna()

        def run(batches):
            space, sums = letters(dims, seed), {}
            for part in chunks(batches):
                units = np.rint(space.bundles(part.column(0).to_pylist()) * SCALE).astype(np.int64)
                langs = np.array(part.column(1).to_pylist(), object)
                for lang in set(langs.tolist()):
                    sums[lang] = sums.get(lang, 0) + units[langs == lang].sum(axis=0)
            if sums:
                names = sorted(sums)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sums[n] for n in names], pa.list_(pa.int64()))], names=["lang", "sums"])

        partial = labelled.mapInArrow(run, "lang string, sums array<bigint>")
        total = partial.select("lang", F.posexplode("sums").alias("place", "value")).groupBy("lang", "place").agg(F.sum("value").alias("value"))
        found: dict[str, np.ndarray] = {}
        for row in total.collect():
            found.setdefault(row.lang, np.zeros(dims))[row.place] = row.value
        langs = sorted(found)
        profiles = np.array([found[x] / max(np.linalg.norm(found[x]), 1.0) for x in langs], np.float32).reshape(len(langs), dims)
        return cls(langs, profiles, dims, seed)

    def predict(self, docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
        """Each row with ``lang_pred`` and ``score``; the text goes unless ``keep_text``."""
        langs, profiles, dims, seed = self.langs, self.profiles, self.dims, self.seed
        added = ("lang_pred", "score")
        keep = [c for c in docs.columns if c not in added and (keep_text or c != text)]
        at = keep.index(text) if keep_text else len(keep)
        hidden = free_name(keep, "__text")
        lean = importable(docs).select(*[F.col(f"`{c}`") for c in keep], *([] if keep_text else [F.col(f"`{text}`").alias(hidden)]))
        schema = lean.drop(hidden).selectExpr("*", "'' AS lang_pred", "0D AS score").schema

        def run(batches):
            space = letters(dims, seed)
            for part in chunks(batches):
                units = space.bundles(part.column(at).to_pylist())
                found, scores = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows)
                if langs:
                    cosines, some = units.astype(np.float64) @ profiles.T.astype(np.float64), units.any(axis=1)
                    found[some] = np.array(langs, object)[cosines.argmax(axis=1)][some]
                    scores[some] = np.clip(cosines.max(axis=1)[some], 0, 1)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(found, pa.string()), pa.array(scores)], names=[*keep, *added])

        return lean.mapInArrow(run, schema)
