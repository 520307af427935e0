"""Long texts as overlapping windows of tokens, and back."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = r"[^\x20\x09-\x0D]+"
MAX_LENGTH, STRIDE = 384, 64


class Cutter:
    """Tokens of a text with their offsets in windows of at most ``max_length``, each beginning with the last ``stride`` of the one before."""

    _known: dict = {}

    def _offsets(self, text: str, tokens: str, file: str | None) -> list[tuple[int, int]]:
        if file:
            if file not in self._known:
                from tokenizers import Tokenizer

                self._known[file] = Tokenizer.from_file(file)
            return self._known[file].encode(text, add_special_tokens=False).offsets
        if tokens not in self._known:
            self._known[tokens] = re.compile(tokens)
        return [m.span() for m in self._known[tokens].finditer(text)]

    def eval(self, text: str, max_length: int, stride: int, tokens: str, file: str) -> Iterator[tuple]:
        offsets, step = self._offsets(text or "", tokens, file), max_length - stride
        n = max(1, -(-(len(offsets) - stride) // step))
        for k in range(n):
            yield k, k * step, [{"start": a, "end": b} for a, b in offsets[k * step : k * step + max_length]]


_cutter = F.udtf(Cutter, returnType="window int, first int, tokens array<struct<start:int,end:int>>", useArrow=True)


def cut(texts: DataFrame, column: str = "text", max_length: int = MAX_LENGTH, stride: int = STRIDE, tokens: str = WORDS, file: str | None = None) -> DataFrame:
    """A row for each window of each text: the row's columns, window (from 0), first (the number of its first token) and tokens.

    ``tokens`` is a pattern, or ``file`` a tokenizer's file that all workers can read. Every token is in a window; a text
    without tokens (null, too) has one empty window; the text itself is left out.
    """
    if not 0 <= stride < max_length:
        raise ValueError("the stride is less than a window")
    made = _cutter(F.col(column).outer(), F.lit(max_length), F.lit(stride), F.lit(tokens), F.lit(file))
    return texts.lateralJoin(made).drop(column)


def token_rows(windows: DataFrame) -> DataFrame:
    """A row for each token of each window, with the token's own number in its text."""
    each = windows.select("*", F.posexplode("tokens").alias("at", "token"))
    return each.select(*[c for c in windows.columns if c != "tokens"], (F.col("first") + F.col("at")).alias("number"), "token.start", "token.end")


def merged(rows: DataFrame, *by: str, value: str = "label") -> DataFrame:
    """Tokens of overlapping windows once: each from the window in which it is farthest from an edge (of equal ones the earlier)."""
    inside = F.least(F.col("number") - F.col("first"), F.col("last") - F.col("number"))
    sized = rows.join(rows.groupBy(*by, "window").agg(F.max("number").alias("last")), [*by, "window"])
    best = F.struct(inside.alias("inside"), (-F.col("window")).alias("w"))
    return sized.groupBy(*by, "number", "start", "end").agg(F.max_by(value, best).alias(value))
