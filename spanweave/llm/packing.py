"""Best-fit packing of token pieces into sequences as a vector bin packing.

Each piece demands tokens, one place among a sequence's documents, and an attention cost (its length squared); each
open sequence has a residual capacity for each of the three. Pieces are taken longest first. Among the sequences that
can hold a piece under every constraint, either the weighted dot product of residual and demand or the weighted norm
of the residual that would be left is least (both relative to the capacities); ties go to the oldest sequence.

With as many places and as much attention as a full sequence of single tokens would take (the limits that Capacity has
by default, and those of the query), neither binds: tokens alone decide, and the choice is that of plain best fit.

Pieces are dealt by a hash of their identity into groups of bounded expected size, and groups are packed on their own,
so no task ever holds all pieces; a group loses at most its last, partly filled sequences. Full pieces need no search.

Defined cases: null text counts as empty and is one piece holding the end token; texts longer than a sequence can hold are
cut into full pieces and a rest; equal pieces are all packed; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import array
import math
import os
import unicodedata
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, numbered, texts, worker_cache

#: Rows that a packing group holds on average at most.
GROUP_ROWS = 8192
#: Distinct words whose ids a worker remembers before it starts anew.
REMEMBERED = 600_000
_TAIL = ".,!?;:$%&*#"


@dataclass(frozen=True)
class Capacity:
    """Limits of one sequence and the weights of the three dimensions in the choice."""

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)
    rule: str = "norm"  # or "dot"

    @property
    def piece(self) -> int:
        """The longest piece that a sequence can hold alone."""
        return max(1, min(self.tokens, math.isqrt(self.attention)))


class WordIds(dict):
    """Bytes of the ids of a text between spaces; what is unknown is tokenized when asked for.

    Pre-tokens of this vocabulary never cross white space, and a run of letters and the ASCII marks after it are
    pre-tokens of their own, so the ids of parts joined are the ids of the whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.cores: dict[str, bytes] = {}
        # The letters that stand for the UTF-8 bytes of letters below U+0250, where the file has the usual normal form
        # (NFC, lower case) and byte-level pre-tokens; the model alone is then asked, which spares two passes a word.
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.sign = {b: level.pre_tokenize_str(chr(b))[0][0] for b in range(97, 123)}
        for high in range(0xC3, 0xCA):
            for low in range(0x80, 0xC0):
                self.sign[high], self.sign[low] = level.pre_tokenize_str(bytes([high, low]).decode())[0][0]
        self.plain = all(self.word(w) == self.ids(w) for w in ("word", "déjà", "größe", "niño", "ðžŧ"))

    def ids(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def word(self, low: str) -> bytes:
        """As ids(), for lower-case letters in normal form."""
        text = low if low.isascii() else low.encode().decode("latin-1").translate(self.sign)
        return array.array("I", [t.id for t in self.tokenizer.model.tokenize(text)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(_TAIL)
        # Letters whose normal form is letters again; elsewhere it may run on into the marks that follow.
        if core.isalpha() and max(core) < "\u0250" and "\u0130" not in core and unicodedata.is_normalized("NFC", core):
            low = core.lower()
            if (out := self.cores.get(low)) is None:
                out = self.cores[low] = self.word(low) if self.plain else self.ids(low)
            if len(core) < len(word):
                out += self[word[len(core) :]]
        else:
            out = self.ids(word)
        if len(self) + len(self.cores) > REMEMBERED:
            self.clear()
            self.cores.clear()
        self[word] = out
        return out

    def of_text(self, text: str) -> bytes:
        if "<|" in text:  # special tokens are found in the whole text
            return self.ids(text)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def pieces(df: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each row: piece, start, length, ids_crc32."""

    def of(batch: pa.RecordBatch) -> dict:
        words = worker_cache(vocabulary, lambda: WordIds(vocabulary))
        end, step = array.array("I", [end_id]).tobytes(), 4 * capacity
        rows, piece, start, length, crc = [], [], [], [], []
        for at, text in enumerate(texts(batch.column(1))):
            data = words.of_text(text) + end
            for k in range(0, len(data), step):
                part = data[k : k + step]
                rows.append(at)
                piece.append(k // step)
                start.append(k // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        return {"id": batch.column(0).take(pa.array(rows, pa.int64())), "piece": piece, "start": start, "length": length, "ids_crc32": crc}

    kind = df.schema[id_col].dataType.simpleString()
    read = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_arrow(read, of, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint", keeps=True)


def best_fit(lengths: np.ndarray, limit: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece; lengths must not grow."""
    n = len(lengths)
    cap = np.array([limit.tokens, limit.documents, limit.attention], dtype=np.float64)
    scale = np.array(limit.weights) / cap**2
    left = np.empty((max(64, n // 4 + 1), 3))
    number = np.empty(len(left), dtype=np.int64)  # of open bins, by age
    bins, places = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    least = float(lengths[-1]) if n else 0.0
    opened = used = 0
    for k in range(n):
        size = float(lengths[k])
        demand = np.array([size, 1.0, size * size])
        room = left[:used]
        fits = np.flatnonzero((room[:, 0] >= size) & (room[:, 1] >= 1.0) & (room[:, 2] >= demand[2]))
        if len(fits):
            rest = room[fits]
            score = (rest - demand) ** 2 @ scale if limit.rule == "norm" else rest @ (demand * scale)
            at = fits[int(np.argmin(score))]
        else:
            if used == len(left):
                left, number = np.concatenate([left, np.empty_like(left)]), np.concatenate([number, np.empty_like(number)])
            at, used = used, used + 1
            left[at], number[at] = cap, opened
            opened += 1
        bins[k], places[k] = number[at], limit.tokens - left[at, 0]
        left[at] -= demand
        if left[at, 0] < least or left[at, 1] < 1.0:  # nothing that follows fits
            left[at : used - 1], number[at : used - 1] = left[at + 1 : used].copy(), number[at + 1 : used].copy()
            used -= 1
    return bins, places


def pack(df: DataFrame, vocabulary: str, limit: Capacity = Capacity(), end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each piece with the sequence that holds it and its offset there."""
    # Rows are dealt by unique numbers, so equal ones, however many, do not meet in one group.
    rows, row = numbered(df.select(id_col, text_col), id_col)
    if row != id_col:
        packed = pack(rows.select(row, text_col), vocabulary, limit, end_id, row, text_col)
        return packed.join(rows.select(row, id_col), row).select(id_col, *[c for c in packed.columns if c != row])
    bound = df.agg(F.sum(1 + F.floor(F.coalesce(F.octet_length(text_col), F.lit(0)) / limit.piece))).first()[0] or 0
    groups = max(1, -(-bound // GROUP_ROWS))
    kind = df.schema[id_col].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, places = best_fit(pdf["length"].to_numpy(), limit)
        return pdf.assign(sequence_id=key[0] * (1 << 32) + bins, offset=places)[["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    dealt = pieces(df, vocabulary, limit.piece, end_id, id_col, text_col).withColumn("deal", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(groups)))
    packed = dealt.repartition(int(groups), "deal").groupBy("deal").applyInPandas(
        run, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )
    return packed.withColumnRenamed("id", id_col)
