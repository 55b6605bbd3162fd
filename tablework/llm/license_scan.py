"""Licence scan by a positional rare-token index (operator 9); DataFrame functions only.

Templates are licence statements, held as words with their positions: the
postings. How rare a licence word is comes from the corpus: the number of
documents that hold it, over all documents. A file's licence words say which
templates it can match at all: those whose mandatory key phrase it holds the
words of. For each of these, the file's licence word of highest inverse document
frequency among the phrase's words is looked up; a match holds the phrase in
full, so none is missed, whatever else of the template was changed, and the
rarest word has the fewest places to look at. A file without any such template
has nothing looked up. Each place of such a word is joined with its postings;
that fixes where the whole template would have to begin. The words of the
template are then compared at that alignment, inside the row. A label is given
when at least ``COVER`` of the words agree and the template's key phrase stands
there in full. The score is the best agreement found (1 for a base phrase).

Base phrases are templates too: two or three words that are their own key
phrase, to be matched in full.

The postings are fixed values of this module (a few hundred rows at most), so
they are broadcast; document frequencies are one row per template word. A
document is read twice and never shuffled: what is shuffled is one row per
document and matched alignment.

Defined cases: NULL and empty texts have no words, no labels and score 0;
repeated rows give one row each with equal results; an empty table gives no
rows; other columns are not read, so names cannot clash; of equally rare
words the alphabetically first is looked up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_words, with_row_key

# Base phrases and their labels (fixed values).
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Licence statements: label, statement, mandatory key phrase (fixed values).
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     "source and binary forms"),
    ("cc-by", "licensed under the creative commons attribution license", "creative commons attribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
     "permission is hereby granted"),
    ("mit", "released under the mit license", "mit license"),
    ("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation",
     "affero general public license"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at",
     "in compliance with the license"),
    ("artistic", "licensed under the artistic license 2 0", "artistic license"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
     "promote products derived from this software", "endorse or promote products"),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the "
     "software and accompanying documentation covered by this license", "person or organization obtaining"),
    ("bsl", "distributed under the boost software license version 1 0", "boost software license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license",
     "creative commons attribution"),
    ("cc-by-sa", "licensed under the creative commons attribution share alike license", "attribution share alike"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain",
     "dedicated the work to the public domain"),
    ("cddl", "subject to the terms of the common development and distribution license",
     "common development and distribution license"),
    ("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    ("eupl", "licensed under the european union public licence", "european union public licence"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
     "public license", "general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
     "hereby granted", "with or without fee"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
     "general public license", "lesser general public license"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial "
     "portions of the software", "copies or substantial portions"),
    ("mit", "the software is provided as is without warranty of any kind express or implied",
     "provided as is without warranty"),
    ("ms-pl", "licensed under the microsoft public license", "microsoft public license"),
    ("odbl", "made available under the open database license", "open database license"),
    ("ofl", "this font software is licensed under the sil open font license version 1 1", "open font license"),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     "free and unencumbered software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be "
     "held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
]
COVER = 0.7


def _find(words: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i:i + len(phrase)] == phrase)


def templates() -> list[dict]:
    """Base phrases first, then statements, as words with their key phrase's place."""
    rows = [{"label": label, "base": True, "words": p.split(), "key_at": 0, "key_n": len(p.split())}
            for p, label in sorted(BASE.items())]
    for label, text, key in TEMPLATES:
        words = text.split()
        rows.append({"label": label, "base": False, "words": words,
                     "key_at": _find(words, key.split()), "key_n": len(key.split())})
    return [r | {"t": t} for t, r in enumerate(rows)]


def document_frequencies(docs: DataFrame, vocabulary: list[str], text_col: str = "text"
                         ) -> tuple[dict[str, int], int]:
    """In how many documents each word of a fixed vocabulary stands, and the
    number of documents. One row per vocabulary word reaches the driver."""
    words = F.array(*[F.lit(w) for w in sorted(vocabulary)])
    seen = docs.select(F.explode(F.concat(
        F.array(F.lit("")), F.array_intersect(ascii_words(text_col), words))).alias("w"))
    count = {r["w"]: r["n"] for r in seen.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return count, count.get("", 0)


def look_up_words(frequency: dict[str, int], n_docs: int) -> list[tuple[str, list[str], dict]]:
    """(word of highest inverse document frequency, all words) of the key phrase
    of each template, with the template."""
    idf = lambda w: math.log((n_docs + 1) / (frequency.get(w, 0) + 1))
    out = []
    for t in templates():
        key = sorted(set(t["words"][t["key_at"]:t["key_at"] + t["key_n"]]), key=lambda w: (-idf(w), w))
        out.append((key[0], key, t))
    return out


def postings(spark: SparkSession, chosen: list[tuple[str, list[str], dict]]) -> DataFrame:
    """The index: a row per template and place of its look-up word, and one
    without a word or template, which every document meets."""
    rows = [(w, t["t"], t["label"], t["base"], i, t["words"], t["key_at"], t["key_n"])
            for w, _, t in chosen for i, x in enumerate(t["words"])
            # one place in the phrase is enough: every match holds it
            if x == w and i == t["key_at"] + t["words"][t["key_at"]:].index(w)]
    rows.append(("", None, None, None, 0, [], 0, 0))
    return spark.createDataFrame(rows, "word string, t int, label string, base boolean, at int, "
                                       "words array<string>, key_at int, key_n int")


def own_words(words: Column, chosen: list[tuple[str, list[str], dict]]) -> Column:
    """The look-up words of a file: of the templates whose key phrase it holds all
    words of."""
    vocabulary = F.array(*[F.lit(w) for w in sorted({w for _, key, _ in chosen for w in key})])
    phrases = sorted({(tuple(sorted(key)), w) for w, key, _ in chosen})
    possible = F.array(*[F.struct(F.array(*[F.lit(k) for k in key]).alias("key"), F.lit(w).alias("word"))
                         for key, w in phrases])
    fit = lambda held: F.filter(possible, lambda p: F.size(F.array_except(p["key"], held)) == 0)
    found = F.get(F.transform(F.array(F.array_intersect(words, vocabulary)), fit), F.lit(0))
    return F.array_distinct(F.transform(found, lambda p: p["word"]))


def matches(docs: DataFrame, chosen: list[tuple[str, list[str], dict]], id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """Verified alignments, and one row with a NULL template per document:
    id, __row_key, n_words, t, label, base, start, cover."""
    index = postings(docs.sparkSession, chosen)
    rows = with_row_key(docs, id_col, text_col).select(id_col, "__row_key", ascii_words(text_col).alias("w"))
    rows = rows.withColumn("look", own_words(F.col("w"), chosen))
    rows = rows.withColumn("n_words", F.size("w").cast("long"))
    reach = max(len(t["words"]) for t in templates())
    # An entry more, without a word, stands for the document itself.
    itself = F.array(F.struct(F.lit(0).alias("p"), F.lit("").alias("word"),
                              F.array().cast("array<string>").alias("near")))
    places = F.when(F.size("look") > 0, F.filter(
        F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.array_contains("look", F.get(F.col("w"), i)))) \
        .otherwise(F.array().cast("array<int>"))
    spots = rows.withColumn("s", F.explode(F.concat(itself, F.transform(places, lambda i: F.struct(
        i.alias("p"), F.get(F.col("w"), i).alias("word"),
        F.slice("w", F.greatest(i - reach, F.lit(0)) + 1, 2 * reach).alias("near"))))))
    met = spots.select(id_col, "__row_key", "n_words", "s.*").join(F.broadcast(index), "word")
    at = F.least(F.col("p"), F.lit(reach)) - F.col("at")
    same = F.transform("words", lambda x, i: F.coalesce(F.get(F.col("near"), at + i) == x, F.lit(False)))
    met = met.withColumn("start", F.col("p") - F.col("at")).withColumn("same", same)
    cover = F.size(F.filter("same", lambda x: x)) / F.size("same")
    key = F.forall(F.slice("same", F.col("key_at") + 1, F.col("key_n")), lambda x: x)
    good = key & (cover >= F.when(F.col("base"), 1.0).otherwise(COVER))
    return met.where(F.col("t").isNull() | good).select(
        id_col, "__row_key", "n_words", "t", "label", "base",
        F.when(F.col("t").isNotNull(), F.col("start")).alias("start"),
        F.when(F.col("t").isNotNull(), cover).alias("cover"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word,
    base_labels, labels, score and matched (label, first and last word of the
    alignment, agreement), sorted."""
    vocabulary = sorted({w for t in templates() for w in t["words"]})
    chosen = look_up_words(*document_frequencies(docs, vocabulary, text_col))
    found = matches(docs, chosen, id_col, text_col)
    base = F.col("base")
    lengths = {t["t"]: len(t["words"]) for t in templates()}
    size = F.element_at(F.create_map(*[F.lit(x) for kv in lengths.items() for x in kv]), F.col("t"))
    spans = F.when(F.col("t").isNotNull(), F.struct(
        F.col("label"), F.col("start").alias("first"), (F.col("start") + size - 1).alias("last"),
        F.col("cover")))
    # Several look-up words find one alignment: it counts once.
    once = found.groupBy(id_col, "__row_key", "n_words", "t", "label", "base", "start", "cover") \
        .agg(F.count(F.lit(1)).alias("n"))
    one = once.groupBy(id_col, "__row_key", "n_words").agg(
        F.max(F.when(F.col("t").isNull(), F.col("n"))).alias("n_rows"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("base_labels"),
        F.collect_set("label").alias("labels"),
        F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(spans)).alias("matched"))
    copies = one.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))))
    return copies.select(
        id_col, "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base_labels"), ",").alias("base_labels"),
        F.array_join(F.array_sort("labels"), ",").alias("labels"), "score", "matched")


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return scanned.select(id_col, "n_words", "n_base", "first_word", "last_word", "base_labels",
                          "labels", "score")
