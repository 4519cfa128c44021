"""Problem 6: oversized items cut at natural boundaries, by range-maximum queries over boundary strengths."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.kernels import map_slices

LIMIT, OVERLAP, FULL = 3000, 250, 0.5

# Where a text pauses, weakest first; the cut is behind the match.
PAUSES = (
    (1, re.compile(r"\s(?=\S)")),
    (2, re.compile(r"[,、，·](?:\s|(?<=[、，]))")),
    (3, re.compile(r"[;:；：–—](?:\s|(?<=[；：]))")),
    (4, re.compile(r"[.!?…][\"'”’»)\]]*\s|[。！？][」』”’)]*")),
    (5, re.compile(r"\n")),
    (6, re.compile(r"\n[^\S\n]*\n\s*")),
)


class StrongestCut:
    """Sparse table over the places where a text pauses: strongest place in a range of characters in constant time.

    Only places that pause are held, and only the levels that a range of `widest` characters can need.
    """

    def __init__(self, text: str, widest: int):
        strength = np.zeros(len(text) + 1, np.int64)
        for value, pattern in PAUSES:
            ends = [m.end() for m in pattern.finditer(text)]
            strength[ends] = np.maximum(strength[ends], value)
        strength[[0, -1]] = 0
        self.at = np.flatnonzero(strength)
        self.right = self._table((strength[self.at] << 40) + self.at, widest)
        self.left = self._table((strength[self.at] << 40) + len(text) - self.at, widest)
        self.n = len(text)

    @staticmethod
    def _table(values: np.ndarray, widest: int) -> list[np.ndarray]:
        levels = [values]
        while (half := 1 << (len(levels) - 1)) < min(widest, len(values)) and len(levels[-1]) > half:
            levels.append(np.maximum(levels[-1][:-half], levels[-1][half:]))
        return levels

    def query(self, first: int, last: int, rightmost: bool = True) -> int | None:
        """The strongest place in [first, last]; of equally strong ones the rightmost, or the leftmost. None if it never pauses."""
        a, b = np.searchsorted(self.at, (first, last + 1))
        if a >= b:
            return None
        levels = self.right if rightmost else self.left
        k = int(b - a).bit_length() - 1
        best = int(max(levels[k][a], levels[k][b - (1 << k)])) & ((1 << 40) - 1)
        return best if rightmost else self.n - best


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP, full: float = FULL) -> list[tuple[int, int]]:
    """(start, end) of consecutive pieces of at most limit characters that cover the text.

    Each end is the strongest pause of the later part of the permissible window (from `full` of the limit on), else of
    the earlier part, else the limit itself. The next piece starts at the strongest pause of the last `overlap` characters,
    the leftmost of equals, or exactly `overlap` characters back where they never pause.
    """
    if len(text) <= limit:
        return [(0, len(text))]
    cuts = StrongestCut(text, limit)
    out, start = [], 0
    while len(text) - start > limit:
        end = cuts.query(start + max(int(limit * full), overlap + 1), start + limit) or cuts.query(start + overlap + 1, start + limit) or start + limit
        out.append((start, end))
        back = cuts.query(end - overlap, end - 1, rightmost=False) if overlap else end
        start = back or end - overlap
    out.append((start, len(text)))
    return out


def pieces(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """item_kind, item_id, piece_no, n_pieces, start, content - from item_kind, item_id, content.

    Items within the limit are one piece and never leave the JVM. Null content has no piece, empty content one empty
    piece. An item is cut inside one task, whose memory grows with the number of its pauses only.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    items = items.select("item_kind", "item_id", "content").where("content is not null")
    small = items.where(F.length("content") <= limit).select("item_kind", "item_id", F.lit(1).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start"), "content")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for kind, item, text in zip(*(c.to_pylist() for c in batch.columns)):
            spans = cut(text, limit, overlap)
            rows += [(kind, item, i, len(spans), a, text[a:b]) for i, (a, b) in enumerate(spans, 1)]
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["item_kind", "item_id", "piece_no", "n_pieces", "start", "content"])

    large = map_slices(items.where(F.length("content") > limit), run, "item_kind string, item_id string, piece_no int, n_pieces int, start int, content string")
    return small.unionByName(large)


def project_items(chunks: DataFrame, papers: DataFrame) -> DataFrame:
    chunk = chunks.select(F.lit("chunk").alias("item_kind"), F.col("id").alias("item_id"), "content")
    return chunk.unionByName(papers.select(F.lit("paper").alias("item_kind"), F.col("id").alias("item_id"), F.col("body").alias("content")))
