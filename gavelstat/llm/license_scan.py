"""Licences in texts by diagonal voting, with DataFrame functions alone.

1. Every run of k words of a text is hashed; runs whose hash occurs in no template end there, the others are joined
   with the template positions of the same words.  Templates are a fixed, small table, so the join is a broadcast
   and texts are never shuffled.
2. A hit at word p of a text and t of a template votes for the diagonal p - t.  All votes of a diagonal are one
   aggregation to a bit mask of template positions.
3. Neighbouring diagonals, which an inserted or missing word sets apart, merge.
4. A merged span is verified: words are compared on the join, enough different positions must have voted, and the span
   must not be longer than the template allows.

Phrases are templates of two-word runs that need all their votes on one diagonal, so their places are exact.

Defined results: a null text is empty; texts without words give zeros, nulls and empty labels.  Texts are read whole,
however long.  Rows with equal doc_id and text (told apart by a 64-bit hash of it) count once and are repeated in the
result.  An empty table gives no rows.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a run in a notice, and in a phrase.
RUN, PHRASE_RUN = 5, 2
#: Diagonals at most this far apart merge; share of a notice's runs that must vote; longest span against the notice.
DRIFT, SHARE, STRETCH = 8, 0.8, 1.25
#: Runs of a template: one bit each.  A longer text is given as several templates.
MOST_RUNS = 63
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# ---- fixed values: phrases and the opening sentences of well-known licences ----
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
NOTICES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the "
                         "GNU General Public License as published by the Free Software Foundation, either version 3 of "
                         "the License, or (at your option) any later version"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
]


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    run: int
    phrase: bool

    @property
    def runs(self) -> int:
        return len(self.words) - self.run + 1

    @property
    def needed(self) -> int:
        return self.runs if self.phrase else -(-self.runs * round(100 * SHARE) // 100)


def words_of(text: str) -> tuple[str, ...]:
    return tuple(re.findall(WORD, text.translate(str.maketrans(_UPPER, _LOWER))))


def templates(phrases: dict[str, str] = PHRASES, notices: Sequence[tuple[str, str]] = tuple(NOTICES)) -> list[Template]:
    out = [Template(label, words_of(p), PHRASE_RUN, True) for p, label in phrases.items()]
    out += [Template(label, words_of(text), RUN, False) for label, text in notices]
    for t in out:
        if not 1 <= t.runs <= MOST_RUNS:
            raise ValueError(f"{t.label}: a template has {t.run} to {MOST_RUNS + t.run - 1} words, not {len(t.words)}")
    return out


def run_hash(words: Sequence[str]) -> int:
    """The value of xxhash64 over several string columns, signed."""
    value = 42
    for word in words:
        value = xxhash.xxh64_intdigest(word.encode(), value)
    return value - (1 << 64) if value >= 1 << 63 else value


def _hits(words: Column, run: int, known: Sequence[Template]) -> Column:
    """Place and words of every run of ``run`` words that hashes like one of the templates."""
    hashes = sorted({run_hash(t.words[i : i + run]) for t in known if t.run == run for i in range(t.runs)})
    places = F.when(F.size(words) >= run, F.sequence(F.lit(0), F.size(words) - run)).otherwise(F.array().cast("array<int>"))
    found = F.filter(places, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(run)]).isin(hashes))
    return F.transform(found, lambda i: F.struct(i.alias("place"), F.array_join(F.slice(words, i + 1, run), " ").alias("words")))


def hits(docs: DataFrame, known: Sequence[Template]) -> DataFrame:
    """doc, text_key, n_words, place, words; and for each row one hit without a place."""
    text = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("found"),
    )
    none = F.array(F.struct(F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("words")))
    every = F.concat(none, *[_hits(F.col("found"), k, known) for k in sorted({t.run for t in known})])
    return rows.select("doc", "text_key", F.size("found").cast("bigint").alias("n_words"), F.inline(every))


def places(docs: DataFrame, known: Sequence[Template] | None = None) -> DataFrame:
    """Verified spans: doc, text_key, template, label, phrase, start, end (in words), votes, runs; and rows without
    a template, with n_words and the number of equal rows in ``copies``.
    """
    known = templates() if known is None else list(known)
    spark = docs.sparkSession
    positions = spark.createDataFrame(
        [(n, i, t.run, " ".join(t.words[i : i + t.run])) for n, t in enumerate(known) for i in range(t.runs)],
        "template int, position int, run int, words string",
    )
    votes = hits(docs, known).join(F.broadcast(positions), "words", "left")
    diagonals = votes.groupBy("doc", "text_key", "template", (F.col("place") - F.col("position")).alias("diagonal")).agg(
        F.max("n_words").alias("n_words"), F.count("*").alias("copies"), F.min("place").alias("start"),
        F.max(F.col("place") + F.col("run")).alias("end"),
        F.bit_or(F.expr("shiftleft(1L, position)")).alias("mask"),
    )
    about = spark.createDataFrame(
        [(n, t.label, t.phrase, t.runs, t.needed, len(t.words), 0 if t.phrase else DRIFT) for n, t in enumerate(known)],
        "template int, label string, phrase boolean, runs int, needed int, size int, drift int",
    )
    same = Window.partitionBy("doc", "text_key", "template").orderBy("diagonal")
    named = diagonals.join(F.broadcast(about), "template", "left")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(same) > F.col("drift"), F.lit(True))
    numbered = named.withColumn("new", apart.cast("int")).withColumn("group", F.sum("new").over(same))
    merged = numbered.groupBy("doc", "text_key", "template", "label", "phrase", "runs", "needed", "size", "group").agg(
        F.max("n_words").alias("n_words"), F.max("copies").alias("copies"), F.min("start").cast("bigint").alias("start"),
        F.max("end").cast("bigint").alias("end"), F.bit_count(F.bit_or("mask")).alias("votes"),
    )
    fits = (F.col("votes") >= F.col("needed")) & (F.col("end") - F.col("start") <= STRETCH * F.col("size"))
    return merged.withColumn("verified", fits).drop("needed", "size", "group")


def scan(docs: DataFrame, known: Sequence[Template] | None = None) -> DataFrame:
    """Per document its words, places of phrases, labels, and the largest share of a template that was found."""
    base = F.col("verified") & F.col("phrase")

    def listed(labels: Column) -> Column:
        return F.array_join(F.array_sort(labels), ",")

    per_text = places(docs, known).groupBy("doc", "text_key").agg(
        F.max("n_words").alias("n_words"), F.max(F.when(F.col("template").isNull(), F.col("copies"))).alias("copies"),
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        listed(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        listed(F.collect_set(F.when(F.col("verified"), F.col("label")))).alias("labels"),
        F.coalesce(F.max(F.col("votes") / F.col("runs")), F.lit(0.0)).alias("score"),
    )
    repeated = per_text.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(
        F.col("doc").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )
