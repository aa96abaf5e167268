"""Licence scans over a positional index of rare tokens, in DataFrame functions only.

Templates of licence notices are indexed by their rarest words and the places of these words. Rarity is the inverse
document frequency over the whole corpus, so the index follows the corpus. For every file, all its indexed words are
looked up, however many notices it holds; postings that agree on the relative position (place in file minus place in
template) add up, and a template is a candidate where their share is high enough. A candidate counts once one of its
mandatory key phrases is verified in the file.

Base labels come from four phrases and always stay.

Edge cases: a null text is empty (no words, score 0); a text that is one long run of licence words costs in proportion
to its length, because a word has a bounded number of postings; words of equal rarity are indexed by their place;
repeated rows are scanned one by one; further columns are ignored, whatever their names; an empty table gives an empty
result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# label: (text of a notice in lower-case words, phrases of which one is mandatory)
TEMPLATES = (
    ("gpl", "this work is licensed under the gnu general public license version", ("gnu general public license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    ("gpl-3.0", "gnu general public license version 3", ("general public license version 3", "gpl 3 0", "gplv3")),
    ("gpl-2.0", "gnu general public license version 2", ("general public license version 2", "gpl 2 0", "gplv2")),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("apache org licenses license 2 0",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
)
RARE_PER_TEMPLATE = 8
MIN_SCORE = 0.7


def _array(values) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def canonical(text):
    """Words of a text in lower case, one space before each and after the last; a lone space where there is none."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, " ")), F.lit(" "))


def _words(docs: DataFrame, *keep: str) -> DataFrame:
    return docs.select(*keep, canonical(F.col("text")).alias("canon")).withColumn("words", F.split(F.trim("canon"), " "))


def word_idf(docs: DataFrame, templates=TEMPLATES) -> dict[str, float]:
    """IDF over all documents of every template word: one row per template word reaches the driver."""
    vocabulary = sorted({w for _, text, _ in templates for w in text.split()})
    found = _words(docs).select(F.explode(F.expr(f"array_append(array_intersect(words, {_array(vocabulary)}), '')")).alias("w"))
    df = dict(found.groupBy("w").count().collect())  # '' counts the documents
    return {w: math.log((1 + df.get("", 0)) / (1 + df.get(w, 0))) + 1e-3 for w in vocabulary}


def postings(idf: dict[str, float], templates=TEMPLATES, rare: int = RARE_PER_TEMPLATE) -> list[tuple[str, int, int, float]]:
    """(word, template, place, share): a template's rarest places, whose shares add up to 1."""
    out = []
    for t, (_, text, _) in enumerate(templates):
        places = sorted(enumerate(text.split()), key=lambda x: (-idf[x[1]], x[0]))[:rare]
        total = sum(idf[w] for _, w in places)
        out += [(w, t, p, idf[w] / total) for p, w in places]
    return out


def _word_shares(entries: list[tuple[str, int, int, float]]) -> dict[str, float]:
    """The share of each distinct word of a template's entries."""
    out: dict[str, float] = {}
    for word, _, _, x in entries:
        out[word] = out.get(word, 0.0) + x
    return out


def _fewest(shares: dict[str, float], least: float) -> int:
    """How many distinct words make up a share of ``least``, at the fewest."""
    total, n = 0.0, 0
    for x in sorted(shares.values(), reverse=True):
        if total >= least - 1e-9:
            break
        total, n = total + x, n + 1
    return max(1, n)


def scan_licenses(docs: DataFrame, templates=TEMPLATES, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of ``docs``."""
    spark = docs.sparkSession
    idf = word_idf(docs, templates)
    index = postings(idf, templates)
    indexed = sorted({p[0] for p in index})
    phrases = sorted({p for _, _, ps in templates for p in ps})

    starts = []
    for phrase in BASE:
        first, *rest = phrase.split()
        starts.append(" AND ".join([f"w = '{first}'", *(f"get(words, i + {k}) = '{w}'" for k, w in enumerate(rest, 1))]))
    any_base = " OR ".join(f"contains(canon, ' {p} ')" for p in BASE)
    places = f"filter(transform(words, (w, i) -> CASE WHEN {' OR '.join(f'({s})' for s in starts)} THEN i END), x -> x IS NOT NULL)"
    base_labels = "array_compact(array(" + ", ".join(f"CASE WHEN contains(canon, ' {p} ') THEN '{lab}' END" for p, lab in BASE.items()) + "))"
    verified = "array_compact(array(" + ", ".join(f"CASE WHEN contains(canon, ' {p} ') THEN '{p}' END" for p in phrases) + "))"
    known = f"array_intersect({_array(indexed)}, words)"
    # Words that a template needs at least to reach the share; and whether some template reaches it, wherever its words stand.
    shares = [_word_shares([p for p in index if p[1] == t]) for t in range(len(templates))]
    least = min(_fewest(x, min_score) for x in shares)
    entries = "array(" + ", ".join("array(" + ", ".join(f"named_struct('word', '{w}', 'share', {x!r}D)" for w, x in sorted(t.items())) + ")" for t in shares) + ")"
    reached = f"exists({entries}, t -> aggregate(t, 0D, (a, e) -> a + CASE WHEN array_contains(known, e.word) THEN e.share ELSE 0D END) >= {min_score - 1e-9}D)"

    files = (
        _words(docs, "doc_id")
        .withColumn("places", F.expr(f"CASE WHEN {any_base} THEN {places} ELSE CAST(array() AS array<int>) END"))
        .withColumn("base", F.expr(base_labels))
        .withColumn("known", F.expr(known))
        .withColumn("looked_up", F.expr(f"CASE WHEN size(known) >= {least} THEN {reached} ELSE false END"))
        .select(
            F.monotonically_increasing_id().alias("row_id"),
            "doc_id",
            F.expr("CASE WHEN canon = '  ' THEN 0L ELSE length(canon) - length(replace(canon, ' ', '')) - 1L END").alias("n_words"),
            F.size("places").cast("long").alias("n_base"),
            F.array_min("places").cast("long").alias("first_word"),
            F.array_max("places").cast("long").alias("last_word"),
            "base",
            F.expr(f"CASE WHEN looked_up THEN {verified} END").alias("verified"),
            F.expr("CASE WHEN looked_up THEN filter(transform(words, (w, i) -> CASE WHEN array_contains(known, w) THEN named_struct('place', i, 'word', w) END), x -> x IS NOT NULL) END").alias("hits"),
        )
    )
    files = materialize(files, "licence-hits")  # narrow; fixes row_id too
    row = ["row_id", "doc_id", "n_words", "n_base", "first_word", "last_word", "base"]

    table = spark.createDataFrame(index, "word string, template int, at int, share double")
    wanted = spark.createDataFrame([(t, label, list(ps)) for t, (label, _, ps) in enumerate(templates)], "template int, label string, phrases array<string>")
    aligned = (
        files.filter("hits IS NOT NULL")
        .select(*row, "verified", F.explode("hits").alias("hit"))
        .select(*row, "verified", "hit.place", "hit.word")
        .join(F.broadcast(table), "word")  # bounded by the templates
        .groupBy(*row, "verified", "template", (F.col("place") - F.col("at")).alias("shift"))
        .agg(F.sum("share").alias("matched"))
        .groupBy(*row, "verified", "template")
        .agg(F.max("matched").alias("matched"))
        .join(F.broadcast(wanted), "template")  # bounded by the templates
        .withColumn("good", (F.col("matched") >= min_score) & F.arrays_overlap("verified", "phrases"))
        .groupBy(*row)
        .agg(
            F.collect_set(F.when(F.col("good"), F.col("label"))).alias("own"),
            F.max(F.when(F.col("good"), F.least(F.round("matched", 9), F.lit(1.0)))).alias("score"),
        )
    )
    none = files.filter("hits IS NULL").select(*row, F.expr("CAST(array() AS array<string>)").alias("own"), F.lit(None).cast("double").alias("score"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return none.unionByName(aligned).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", "own")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: licences of all documents."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
