"""Toxicity by a weighted lexicon that an Aho-Corasick automaton matches in folded text.

Folding lower-cases, maps homoglyphs of other scripts to Latin letters, and maps digits and marks that stand for
letters to them; i, l, 1, ! and | become one symbol, in the text and in the lexicon alike. Entries are whole words or
word beginnings, learned from labelled rows by their log-odds; further entries may be given. A hit counts only from a
word's beginning, and not inside an exception phrase. The weighted hits, the same in proportion to the text's length,
and the number of different entries go into a logistic function.

Learning takes a bounded sample of labelled rows (limit, 6,000 by default, and 64 MB), whole texts; that bounds the
lexicon, as an entry must mark LEAST_DOCS rows and explain three of them anew. Scoring covers every row and whole text where the row is read, without a shuffle.

Defined cases: null and empty text have no hits and the lowest score; without labelled rows of both kinds the lexicon
is what was given; repeated rows score alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, texts, worker_cache
from .samples import labelled_sample

SAMPLE, LEAST_DOCS = 6000, 5
#: Harmless phrases that hold words of abuse.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "class clown", "clown fish", "sore loser", "pond scum", "scum line", "idiot proof", "killer whale")
#: Look-alikes of Latin letters in Cyrillic and Greek, and signs and digits used for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k",
    "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e",
    "η": "n", "ι": "i", "κ": "k", "μ": "u", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "i", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
    "0": "o", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "1": "i", "l": "i", "@": "a",
}
_FOLD = {ord(k): v for k, v in LOOKALIKES.items()} | {0xFF01 + i: chr(0x21 + i).lower() for i in range(94)}
_FOLD |= {0xFF10 + int(d): LOOKALIKES.get(d, d) for d in "0123456789"} | {0xFF2C: "i", 0xFF4C: "i"}
_FOLD |= {c: None for c in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD)}
_SIGN = re.compile(r"(?<=[^\W\d_])[!|$](?=[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str) -> str:
    """Lower case with look-alikes mapped; a sign counts as a letter only between letters."""
    text = text.lower().translate(_FOLD)
    if "$" in text or "!" in text or "|" in text:
        text = _SIGN.sub(lambda m: "s" if m[0] == "$" else "i", text)
    return text


class Lexicon:
    """Entries: folded pattern -> (weight, whole word). coef: bias, hits, hits by length, different entries."""

    def __init__(self, entries: dict[str, tuple[float, bool]], coef: tuple[float, ...], exceptions: tuple[str, ...] = EXCEPTIONS) -> None:
        self.entries, self.coef, self.exceptions = entries, coef, tuple(fold(x) for x in exceptions)

    def automaton(self):
        import ahocorasick

        both: dict[str, list] = {}
        for pattern, (weight, whole) in self.entries.items():
            both[pattern] = [weight, whole, False]
        for phrase in self.exceptions:
            both.setdefault(phrase, [0.0, False, True])[2] = True
        found = ahocorasick.Automaton()
        for pattern, (weight, whole, exception) in both.items():
            found.add_word(pattern, (len(pattern), pattern, weight, whole, exception))
        if both:
            found.make_automaton()
        return found if both else None

    def features(self, folded: str, automaton) -> tuple[float, float, float]:
        if automaton is None or not folded:
            return 0.0, 0.0, 0.0
        hits, spared, n = [], [], len(folded)
        for end, (length, pattern, weight, whole, exception) in automaton.iter(folded):
            start = end + 1 - length
            if start and folded[start - 1].isalpha():
                continue
            if exception and not (end + 1 < n and folded[end + 1].isalpha()):
                spared.append((start, end))
            if weight and not (whole and end + 1 < n and folded[end + 1].isalpha()):
                hits.append((start, end, pattern, weight))
        if not hits:
            return 0.0, 0.0, 0.0
        best: dict[int, tuple[float, str]] = {}  # one hit for each word
        for start, end, pattern, weight in hits:
            if not any(a <= start and end <= b for a, b in spared):
                best[start] = max(best.get(start, (0.0, "")), (weight, pattern))
        total = sum(w for w, _ in best.values())
        words = len(_WORD.findall(folded)) or 1
        return math.log1p(total), math.log1p(100.0 * total / words), math.log1p(len({p for _, p in best.values()}))

    def score(self, x: tuple[float, float, float]) -> float:
        z = self.coef[0] + sum(a * b for a, b in zip(self.coef[1:], x, strict=True))
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, z))))


def patterns(text: str) -> set[str]:
    """The words of a text and, with a star, their beginnings of 4 to 8 letters."""
    words = set(_WORD.findall(fold(text)))
    return {w[:k] + "*" for w in words for k in range(4, min(len(w), 8) + 1)} | words


def learn_entries(rows: list[tuple[str, int]]) -> dict[str, tuple[float, bool]]:
    """Words and word beginnings that mark label 1: what adds most evidence first, each explaining rows anew."""
    sides = {y: [t for t, v in rows if v == y] for y in (0, 1)}
    n1, n0 = len(sides[1]), len(sides[0])
    # Rows with a hash bucket bound the rows with any pattern in it; only patterns above the least are then counted.
    buckets = np.zeros(1 << 22, dtype=np.int32)
    for text in sides[1]:
        buckets[list({zlib.crc32(p.encode()) & (1 << 22) - 1 for p in patterns(text)})] += 1
    pos = Counter(p for text in sides[1] for p in patterns(text) if buckets[zlib.crc32(p.encode()) & (1 << 22) - 1] >= LEAST_DOCS)
    pos = Counter({p: n for p, n in pos.items() if n >= LEAST_DOCS})
    neg = Counter(p for text in sides[0] for p in patterns(text) if p in pos)

    def weight(p: str) -> float:
        return math.log((pos[p] + 0.5) / (n1 + 1)) - math.log((neg[p] + 0.5) / (n0 + 1))

    def gain(a: int, b: int) -> float:
        """Evidence that a rows of label 1 and b of label 0 give: the likelihood ratio against equal shares."""
        out, both = 0.0, (a + b) / (n1 + n0)
        for k, n in ((a, n1), (b, n0)):
            for x, m, q in ((k, n, both), (n - k, n, 1 - both)):
                if x and q:
                    out += x * math.log(x / m / q)
        return 2 * out

    # A word or beginning may be common to some language that labels favour by chance: it must be strongly marked.
    names = [p for p in pos if pos[p] >= LEAST_DOCS and weight(p) >= 1.2 and gain(pos[p], neg[p]) >= 20.0]
    names.sort(key=lambda p: (-gain(pos[p], neg[p]), not p.endswith("*"), -len(p), p))
    wanted = set(names)
    having: dict[str, list[int]] = {p: [] for p in names}
    for i, text in enumerate(sides[1]):
        for p in patterns(text) & wanted:
            having[p].append(i)
    out: dict[str, tuple[float, bool]] = {}
    covered, taken = [0] * n1, {}
    for p in names:
        fresh = having[p]
        new = sum(covered[i] < 3 for i in fresh)
        bare = p.rstrip("*")
        if new < 3 or any(bare.startswith(q) and not whole for q, (_, whole) in out.items()):
            continue
        if any(q.startswith(bare) and 10 * n >= 9 * pos[p] for q, n in taken.items()):  # a shorter form of an entry
            continue
        taken[bare] = pos[p]
        for i in fresh:
            covered[i] += 1
        whole = not p.endswith("*")
        if bare not in out:
            out[bare] = (weight(p), whole)
    return out


def train(rows: list[tuple[str, int]], given: dict[str, float] | None = None, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    entries = {fold(w): (x, True) for w, x in (given or {}).items()}
    ones = sum(y for _, y in rows)
    if not 0 < ones < len(rows):
        return Lexicon(entries, (-3.0, 1.0, 0.5, 1.0), exceptions)
    # Weights are learned on one half of the rows and the logistic function on the other, then weights on all.
    split = [[r for v in (0, 1) for r in [r for r in rows if r[1] == v][k::2]] for k in (0, 1)]
    half = Lexicon(entries | learn_entries(split[0]), (0.0, 0.0, 0.0, 0.0), exceptions)
    automaton = half.automaton()
    x = np.array([half.features(fold(t), automaton) for t, _ in split[1]])
    y = np.array([v for _, v in split[1]], dtype=float)
    if not 0 < y.sum() < len(y):
        return Lexicon(entries | learn_entries(rows), (-3.0, 1.0, 0.5, 1.0), exceptions)
    a = np.hstack([np.ones((len(x), 1)), x])
    coef = np.zeros(a.shape[1])
    for _ in range(50):  # Newton's method with a ridge
        p = 1 / (1 + np.exp(-a @ coef))
        ridge = np.diag([1e-6, 0.05, 0.05, 0.05])
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ coef)
        coef += step
        if np.abs(step).max() < 1e-8:
            break
    return Lexicon(entries | learn_entries(rows), tuple(float(c) for c in coef), exceptions)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, limit: int = SAMPLE, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    return train(labelled_sample(docs, labels, label, learn, limit, id_col, text_col))


def score(df: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, score in [0, 1] and weight (of its hits, summed). The lexicon has a bounded size."""
    shared, key = df.sparkSession.sparkContext.broadcast(lexicon), uuid.uuid4().hex

    def of(batch: pa.RecordBatch) -> dict:
        lex = shared.value
        automaton = worker_cache(key, lex.automaton)
        found = [lex.features(fold(t), automaton) for t in texts(batch.column(1))]
        return {"id": batch.column(0), "score": [lex.score(x) for x in found], "weight": [math.expm1(x[0]) for x in found]}

    kind = df.schema[id_col].dataType.simpleString()
    read = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(read, of, f"id {kind}, score double, weight double", keeps=True).withColumnRenamed("id", id_col)
