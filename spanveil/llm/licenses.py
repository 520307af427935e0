"""License scan by diagonal voting.

All rolling word 2-gram hashes of all texts meet the template positions in a
Spark join (the templates are the fixed list below: a bounded broadcast). Each
hit votes for the diagonal (text position minus template position) of its
template; a span is verified when every word pair (phrases) or a set share of
them (templates) is found in order: a chain of hits that rise in the text and in
the template and move by at most ``DRIFT`` diagonals at a step. The fixed phrases give the base labels and places; the longer
templates add labels and the score.

Edge cases: a null or empty text has no words, no labels and score 0; equal rows
are told apart by a row key, so repeated ids keep their own rows; a text full of
phrases costs rows in proportion to its own length; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanveil.cluster import checkpoint
from spanveil.llm import vec

#: Fixed phrases and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Longer wordings, for labels of the method's own.
TEMPLATES = (
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
)
COVER = 0.8
#: Diagonals by which a span of one template may move from one word pair to the next.
DRIFT = 3


def _tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = vec.LOWER[data]
    s, e, row = vec.runs(vec.ALNUM[low], offs)
    return vec.hash_runs(low, s, e), row


def _positions() -> list[tuple[int, int, int]]:
    """(hash, template, position) of every word pair of every phrase and template."""
    out = []
    for t, (text, _) in enumerate((*PHRASES, *TEMPLATES)):
        data, offs = vec.utf8(pa.array([text]))
        g, at = vec.grams(*_tokens(data, offs), 2)
        out += [(int(h), t, int(p)) for h, p in zip(g.view(np.int64), at, strict=True)]
    return out


def _rolling(batches: Iterator[pa.RecordBatch], with_grams: bool = True) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, data, offs in vec.chunks(b.column(0)):
            h, row = _tokens(data, offs)
            cols = {
                "doc_id": b.column(1).slice(i, j - i),
                "key": pa.array(vec.hash_runs(data, offs[:-1], offs[1:]).view(np.int64)),
                "n_words": pa.array(np.bincount(row, minlength=j - i).astype(np.int64)),
            }
            if with_grams:
                g, at = vec.grams(h, row, 2)
                cut = np.zeros(j - i + 1, np.int32)
                np.cumsum(np.bincount(row[at], minlength=j - i), out=cut[1:])
                cols["gram"] = pa.ListArray.from_arrays(pa.array(cut), pa.array(g.view(np.int64)))
            yield vec.columns(b, cols)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _rolling(batches, False)


def chain(pos: list[int], tpos: list[int], size: int) -> int:
    """The most hits (by text position, then template position) that rise in both and move by at most DRIFT diagonals at a step."""
    best, lo = [1] * len(pos), 0
    for i, (p, t) in enumerate(zip(pos, tpos, strict=True)):
        while pos[lo] < p - size - DRIFT:
            lo += 1
        for j in range(lo, i):
            if pos[j] < p and tpos[j] < t and abs((p - t) - (pos[j] - tpos[j])) <= DRIFT and best[j] >= best[i]:
                best[i] = best[j] + 1
    return max(best, default=0)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        share = [chain([h["pos"] for h in hits], [h["tpos"] for h in hits], n) / n for hits, n in zip(b.column(4).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(share, pa.float64())], names=["doc_id", "key", "tpl", "share"])


def rolling(docs: DataFrame, with_grams: bool = True) -> DataFrame:
    """doc_id, a hash of the text, n_words, and all rolling word pair hashes of each text."""
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, n_words long"
    rows = docs.select("text", "doc_id")
    return rows.mapInArrow(_rolling, f"{kind}, gram array<long>") if with_grams else rows.mapInArrow(_counted, kind)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, places (of phrases: template, first word), hits (template, share), and what they say."""
    spark = docs.sparkSession
    words = [len(t.split()) for t, _ in (*PHRASES, *TEMPLATES)]
    places = F.broadcast(spark.createDataFrame(_positions(), "gram long, tpl int, tpos int"))
    sizes = F.array(*[F.lit(n - 1) for n in words])
    hit = checkpoint(  # few rows beside the texts; both kinds of votes read them
        rolling(docs)
        .select("doc_id", "key", F.posexplode("gram").alias("pos", "gram"))
        .join(places, "gram")
        .select("doc_id", "key", "tpl", "tpos", "pos", (F.col("pos") - F.col("tpos")).alias("diag"))
    )
    # One vote for each template position and diagonal. Repeated ids with equal texts vote alike; distinct votes count once.
    line = hit.groupBy("doc_id", "key", "tpl", "diag").agg(F.count_distinct("tpos").alias("votes"))
    phrase = line.where((F.col("tpl") < len(PHRASES)) & (F.col("votes") == F.element_at(sizes, F.col("tpl") + 1)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    long = (
        hit.where(F.col("tpl") >= len(PHRASES))
        .groupBy("doc_id", "key", "tpl")
        .agg(F.count_distinct("tpos").alias("met"), F.collect_set(F.struct("pos", "tpos")).alias("hits"), F.element_at(sizes, F.first("tpl") + 1).alias("size"))
        .where(F.col("met") >= COVER * F.col("size"))
        .select("doc_id", "key", "tpl", "size", F.array_sort("hits").alias("hits"))
        .mapInArrow(_chained, f"doc_id {kind}, key long, tpl int, share double")
        .where(F.col("share") >= COVER)
    )
    found = (
        phrase.select("doc_id", "key", "tpl", F.col("diag").cast("long").alias("at"), F.lit(1.0).alias("share"))
        .unionByName(long.select("doc_id", "key", "tpl", F.lit(None).cast("long").alias("at"), "share"))
        .groupBy("doc_id", "key")
        .agg(
            F.count("at").alias("n_base"),
            F.min("at").alias("first_word"),
            F.max("at").alias("last_word"),
            F.collect_set(F.when(F.col("tpl") < len(PHRASES), F.col("tpl"))).alias("base_tpl"),
            F.collect_set("tpl").alias("all_tpl"),
            F.max("share").alias("score"),
        )
    )
    names = F.array(*[F.lit(label) for _, label in (*PHRASES, *TEMPLATES)])
    said = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(F.coalesce(c, F.array().cast("array<int>")), lambda t: F.element_at(names, t + 1)))), ",")
    return (
        rolling(docs, with_grams=False)
        .join(found.withColumnRenamed("doc_id", "found_id").withColumnRenamed("key", "found_key"), F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("key") == F.col("found_key")), "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
            "first_word",
            "last_word",
            said(F.col("base_tpl")).alias("base_labels"),
            said(F.col("all_tpl")).alias("labels"),
            F.coalesce("score", F.lit(0.0)).alias("score"),
        )
    )
