"""Token counts under a unigram model by dynamic programming over a trie of pre-tokens.

A pre-token is a run of other than white space with a word mark before it. Distinct pre-tokens go into a trie. A node
stands for a prefix, and its forward score is the best total log-probability of pieces that spell that prefix: the best
over the pieces that end there of an ancestor's score plus the piece's own. It depends on the prefix alone, so each
shared prefix is scored once. The count of pieces on the best path is kept at the node where a pre-token ends.

Pieces and their order come from a public vocabulary file; the n-th piece has a probability in proportion to
1 / (n + 2.7), a Zipf law. A character without a piece costs one piece for each of its UTF-8 bytes. Of equal scores the
longer last piece wins. Every row's pre-tokens are counted where the row is read: nothing is shuffled, and a worker's
trie starts anew beyond a bound, which changes no result.

Defined cases: null and empty text have 0 tokens; pre-tokens longer than a bound are scored outside the trie; equal
rows are all counted; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, texts, worker_cache

MARK = "▁"
MAX_NODES, MAX_WORDS, LONG_WORD = 1_000_000, 500_000, 200
_WHITE = re.compile(r"[ \t-\r]+")


def piece_scores(path: str) -> dict[str, float]:
    """Log-probabilities of the pieces of a sentencepiece model, control and byte pieces left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    weights = [1.0 / (n + 2.7) for n in range(len(pieces))]
    total = sum(weights)
    return {p: math.log(w / total) for p, w in zip(pieces, weights, strict=True)}


class Trie:
    """Forward scores and counts by prefix. Node 0 is the empty prefix."""

    def __init__(self, scores: dict[str, float]) -> None:
        import ahocorasick

        self.longest = max(map(len, scores), default=1)
        self.byte_score = min(scores.values(), default=0.0) - 10.0
        self.chars = {p for p in scores if len(p) == 1}
        self.ends = ahocorasick.Automaton()  # the pieces that end at a place, longest first
        for piece, score in scores.items():
            self.ends.add_word(piece, (len(piece), score))
        self.ends.make_automaton()
        self.forget()

    def forget(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.count = [0.0], [0]

    def forward(self, word: str, known: int, best: list[float], count: list[int]) -> None:
        """Fill in best and count of the prefixes of word beyond the first known characters."""
        for char in word[known:]:
            best.append(-math.inf)
            count.append(0)
        missing = [e for e in range(known + 1, len(word) + 1) if word[e - 1] not in self.chars]
        at = 0
        found = self.ends.iter(word, max(0, known + 1 - self.longest)) if len(self.ends) else ()
        for end, (size, score) in found:
            end += 1
            if end <= known:
                continue
            while at < len(missing) and missing[at] < end:
                self.spell(word, missing[at], best, count)
                at += 1
            if (total := best[end - size] + score) > best[end]:
                best[end], count[end] = total, count[end - size] + 1
        for end in missing[at:]:
            self.spell(word, end, best, count)

    def spell(self, word: str, end: int, best: list[float], count: list[int]) -> None:
        """The last character by its bytes."""
        n = len(word[end - 1].encode("utf-8", "surrogatepass"))
        if (total := best[end - 1] + n * self.byte_score) > best[end]:
            best[end], count[end] = total, count[end - 1] + n

    def insert(self, pretoken: str) -> int:
        """Tokens of a pre-token, scored along the trie; what a shared prefix has is used again."""
        best, count = [0.0], [0]
        if len(pretoken) > LONG_WORD:
            self.forward(pretoken, 0, best, count)
            return count[-1]
        if len(self.best) > MAX_NODES:
            self.forget()
        node, known, child = 0, 0, self.child
        for char in pretoken:
            nxt = child.get(node << 21 | ord(char))
            if nxt is None:
                break
            node, known = nxt, known + 1
            best.append(self.best[node])
            count.append(self.count[node])
        if known < len(pretoken):
            self.forward(pretoken, known, best, count)
            for end in range(known, len(pretoken)):
                child[node << 21 | ord(pretoken[end])] = node = len(self.best)
                self.best.append(best[end + 1])
                self.count.append(count[end + 1])
        return count[-1]


class _Terminals(dict):
    """Counts of the pre-tokens that end in the trie."""

    def __init__(self, trie: Trie) -> None:
        self.trie = trie

    def __missing__(self, word: str) -> int:
        if len(self) > MAX_WORDS:
            self.clear()
        n = self[word] = self.trie.insert(MARK + word)
        return n


def token_counts(df: DataFrame, scores: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, n_pretokens, n_tokens. scores: bounded by the vocabulary, so it travels with the function."""
    shared, key = df.sparkSession.sparkContext.broadcast(scores), uuid.uuid4().hex

    def of(batch: pa.RecordBatch) -> dict:
        known = worker_cache(key, lambda: _Terminals(Trie(shared.value)))
        n_pre, n_tok = [], []
        for text in texts(batch.column(1)):
            words = [w for w in _WHITE.split(text) if w]
            n_pre.append(len(words))
            n_tok.append(sum(map(known.__getitem__, words)))
        return {"id": batch.column(0), "n_pretokens": n_pre, "n_tokens": n_tok}

    kind = df.schema[id_col].dataType.simpleString()
    read = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(read, of, f"id {kind}, n_pretokens bigint, n_tokens bigint", keeps=True).withColumnRenamed("id", id_col)
