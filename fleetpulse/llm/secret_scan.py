"""Secret spans: fixed credential patterns, and values in a credential context that would take many guesses.

The guesses of a value are the least product over all its segmentations into dictionary words, dates, repeats, keyboard
walks and brute-force spans (a dynamic program over the value). A value behind a credential word that needs at least
``10**min_guesses`` guesses is a secret of kind ``guess``; placeholders such as ``password = changeme2024`` are not. As a value
may be prose ("the secret is understanding"), the words of the tokenizer's vocabulary are in the dictionary too, by rank.

Null texts count as empty and have no span; repeated rows get the same spans; an empty table stays empty. Texts are
scanned whole, whatever their length. Input columns pass through, but for those named like an output column.
"""

from __future__ import annotations

import json
import math
import re
from pathlib import Path

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import free_name, importable

# Kinds in the order in which spans of equal start are listed, and the patterns of the first three.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
# What announces a credential, and parts of it that a text must hold for the pattern to match at all.
CONTEXT = (
    r"""(?i:pass(?:word|wd|wort|phrase|code)?|pwd|contrase(?:n|\xf1)a|mot\x20de\x20passe|secret|token|bearer|credentials?"""
    r"""|(?:api|access|private|secret|client|auth)[\x20_-]?key|client[\x20_-]?secret|auth(?:orization)?)"""
    r"""["']?\s{0,8}(?:[:=]|=>|is\b|ist\b|est\b|es\b)\s{0,8}["']?([^\s"'`,;<>]+)"""
)
SIGNS = ("pass", "pwd", "contrase", "secret", "token", "bearer", "credential", "key", "auth")
# Words that guessers try first, in that order.
FIRST_WORDS = (
    "password 123456 qwerty admin letmein welcome changeme secret default monkey dragon master login abc test guest root user "
    "token access private public demo sample example placeholder dummy none null true false your my the hello shadow sunshine "
    "princess football baseball superman batman trustno iloveyou summer winter spring autumn january february march april may "
    "june july august september october november december monday friday sunday company server system data base cloud prod dev "
    "stage local host client service account pass word key api app web site mail home work love money star blue red green black"
).split()
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "~!@#$%^&*()_+", "1qaz2wsx3edc4rfv5tgb6yhn7ujm8ik,9ol.0p;/")
LEET = str.maketrans("4301$5@7", "aeolssat")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)?\d\d")
#: Vocabulary file whose words of four letters and more price prose.
VOCABULARY = "word_bpe_49k.json"


def prose_words() -> tuple[str, ...]:
    """The first words, then the vocabulary's by rank."""
    ranks = json.loads(Path(public_tokenizers.path(VOCABULARY)).read_text(encoding="utf-8"))["model"]["vocab"]
    words = (w.removesuffix("</w>") for w in sorted(ranks, key=ranks.get) if w.endswith("</w>"))
    return tuple(dict.fromkeys([*FIRST_WORDS, *(w for w in words if len(w) > 3 and w.isascii() and w.isalpha())]))


def _next_keys() -> set[str]:
    pairs = {r[k : k + 2] for r in ROWS for k in range(len(r) - 1)}
    return pairs | {p[::-1] for p in pairs}


class GuessCost:
    """Least log10 of the guesses of a string over its segmentations."""

    def __init__(self, words: tuple[str, ...] = tuple(FIRST_WORDS)):
        self.cost = {w: math.log10(k + 2) for k, w in reversed(list(enumerate(words))) if len(w) > 1}
        self.longest = max(map(len, self.cost), default=0)
        self.beside = _next_keys()

    @staticmethod
    def brute(c: str) -> float:
        """log10 of the letters of the class of one character."""
        return 1.0 if c.isdigit() else math.log10(26) if c.isascii() and c.isalpha() else math.log10(33) if c.isascii() else 2.0

    def spans(self, s: str) -> list[tuple[int, int, float]]:
        """Words, dates, repeats and walks found in a string, as (start, end, log10 of guesses)."""
        n, low = len(s), s.lower()
        if len(low) != n:
            low = s
        plain, out = low.translate(LEET), []
        for i in range(n):
            for j in range(i + 2, min(n, i + self.longest) + 1):
                for form, more in ((low, 0.0), (plain, 0.3)):
                    if (c := self.cost.get(form[i:j])) is not None:
                        case = 0.0 if s[i:j] == low[i:j] else 0.3 if s[i:j].istitle() or s[i:j].isupper() else 1.0
                        out.append((i, j, c + more + case))
        i = 0
        while i < n:  # one character again and again
            j = i + 1
            while j < n and s[j] == s[i]:
                j += 1
            if j - i > 2:
                out += [(i, k, self.brute(s[i]) + math.log10(k - i)) for k in range(i + 3, j + 1)]
            i = j
        for size in range(2, 9):  # a longer block again and again
            i = 0
            while i + 2 * size <= n:
                j = i + size
                while j < n and s[j] == s[j - size]:
                    j += 1
                times = (j - i) // size
                if times > 1:
                    out.append((i, i + times * size, sum(map(self.brute, s[i : i + size])) + math.log10(times)))
                    i += (times - 1) * size
                i += 1
        i = 0
        while i < n - 1:  # neighbours on the keyboard, or in the alphabet
            j, step = i + 1, ord(low[i + 1]) - ord(low[i])
            while j < n and low[j - 1 : j + 1] in self.beside:
                j += 1
            k = i + 1
            while abs(step) == 1 and k < n and ord(low[k]) - ord(low[k - 1]) == step:
                k += 1
            for end in {j, k}:
                if end - i > 2:
                    out.append((i, end, math.log10(94) + math.log10(2 * (end - i))))
            i = max(i + 1, max(j, k) - 1 if max(j, k) - i > 2 else i + 1)
        out += [(m.start(), m.end(), math.log10(365 * 120) if len(m[0]) > 4 else 2.1) for m in DATE.finditer(s)]
        return out

    def log_guesses(self, s: str) -> float:
        """Each segment after the first doubles the guesses, for the orders in which segments may be tried."""
        ending: list[list[tuple[int, float]]] = [[] for _ in range(len(s) + 1)]
        for i, j, c in self.spans(s):
            ending[j].append((i, c))
        joint = math.log10(2)
        best, brute = [0.0], [math.inf]  # least cost of the first k characters; the same if a brute-force span is open
        for k in range(1, len(s) + 1):
            opened = min(brute[k - 1], best[k - 1] + (joint if k > 1 else 0.0)) + self.brute(s[k - 1])
            brute.append(opened)
            best.append(min([opened, *(best[i] + c + (joint if i else 0.0) for i, c in ending[k])]))
        return best[-1]


class SecretScanner:
    def __init__(self, min_guesses: float = 12.0, min_length: int = 8, words: tuple[str, ...] | None = None):
        self.assign, self.access = re.compile(ASSIGN, re.ASCII), re.compile(ACCESS)
        self.hex = re.compile(HEX.replace("+", f"{{{LEAST['hex']},}}"))  # runs are maximal, so shorter ones can be passed over
        self.context = re.compile(CONTEXT, re.ASCII)
        self.min_guesses, self.min_length, self.guesses = min_guesses, min_length, GuessCost(prose_words() if words is None else words)

    def base(self, text: str) -> list[tuple[int, int, str]]:
        out = [(m.start(), m.end(), "hex") for m in self.hex.finditer(text)]
        if "AKIA" in text:
            out += [(m.start(), m.end(), "access") for m in self.access.finditer(text) if len(m[0]) >= LEAST["access"]]
        if ":" in text or "=" in text:
            low = text.lower()
            if any(s in low for s in ("pass", "secret", "token", "key")):
                out += [(m.start(), m.end(), "assign") for m in self.assign.finditer(text) if len(m[1]) >= LEAST["assign"]]
        return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))

    def guess(self, text: str) -> list[tuple[int, int, str]]:
        low = text.lower()
        if not any(s in low for s in SIGNS):
            return []
        out = []
        for m in self.context.finditer(text):
            value = m[1].rstrip(".:!?)]}")
            if len(value) >= self.min_length and self.guesses.log_guesses(value) >= self.min_guesses:
                out.append((m.start(1), m.start(1) + len(value), "guess"))
        return out

    def scan(self, text: str | None) -> tuple[list, list]:
        """Base spans, and all spans; each sorted by start, then kind."""
        base = self.base(text or "")
        return base, sorted(base + self.guess(text or ""), key=lambda x: (x[0], KINDS.index(x[2])))


def scan_secrets(docs: DataFrame, text: str = "text", min_guesses: float = 12.0, min_length: int = 8) -> DataFrame:
    """Each row with ``secrets``: its spans (kind, start, end in code points, end exclusive) instead of the text."""
    keep = [c for c in docs.columns if c not in (text, "secrets")]
    hidden = free_name(keep, "__text")
    lean = importable(docs).select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(hidden))
    kind = "array<struct<kind:string,start:int,end:int>>"
    schema = lean.drop(hidden).withColumn("secrets", F.lit(None).cast(kind)).schema
    words = prose_words()
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        scanner = SecretScanner(min_guesses, min_length, words)
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for s, e, k in scanner.scan(t)[1]] for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, arrow)], names=[*keep, "secrets"])

    return lean.mapInArrow(run, schema)

