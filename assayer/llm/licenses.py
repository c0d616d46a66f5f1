"""License scans over a positional index of rare words, in DataFrame functions alone.

The words of the licence notices below form a positional index: word -> (notice, position, inverse document frequency over
the licences).  A file looks up all its rare licence words; each posting names the start its notice would have, and postings
that agree on a start are counted together.  A notice counts only where its mandatory key phrase stands at the place which
that start gives it, and where AGREE rare postings agree on it, one of them outside the key phrase (the key phrase alone is
prose, unless the notice has no rare word beside it).  Phrases are found through the same index, by their first rare word.

Defined cases: null text is the empty text; a text without words has zero words and no labels; very long texts are looked
through word by word, and only rare words leave the scan; repeated rows are scanned each on its own; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import keep

#: Phrases whose places are counted, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Notices that the scan knows, as label, mandatory key phrase and notice text (lower-case words).  A label may
#: have several: the short line that names a licence, and the opening of its full notice.
NOTICES = (
    ("apache-2.0", "apache license", "licensed under the apache license version 2 0"),
    ("apache-2.0", "apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("cc-by-4.0", "cc by 4 0", "licensed under cc by 4 0"),
    ("cc-by-4.0", "creative commons attribution 4 0 international license", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-4.0", "creative commons attribution 4 0 international license", "this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0"),
    ("cc-by-nc-4.0", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc-4.0", "creative commons attribution noncommercial 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa-4.0", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa-4.0", "creative commons attribution sharealike 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc0", "cc0 1 0 universal", "dedicated to the public domain under cc0 1 0 universal"),
    ("gpl-2.0", "general public license version 2", "this work is licensed under the gnu general public license version 2"),
    ("gpl-2.0", "either version 2 of the license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0", "general public license version 3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "either version 3 of the license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "lesser general public license", "licensed under the gnu lesser general public license"),
    ("lgpl", "lesser general public license", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mpl-2.0", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("mpl-2.0", "mozilla public license", "subject to the terms of the mozilla public license version 2 0"),
    ("proprietary", "all rights reserved", "copyright all rights reserved"),
)
#: Words of the notices and phrases that any text has; they are compared where a rarer word leads to them, never looked up.
COMMON = frozenset("a all and any are by for free forms from in is license of or person rights terms the this to under use version with without work 0 1 2 3 4 as at can file if including it later may modify not one option or other software source v was you your".split())
#: Rare postings of a notice that must agree on one start, at least one of them outside its key phrase if it has any there.
AGREE = 2


def _starts(words: list[str], phrase: list[str]) -> int:
    return next(k for k in range(len(words)) if words[k:k + len(phrase)] == phrase)


def postings() -> list[tuple[str, int, int, float, bool]]:
    """(word, notice, position, idf, whether it lies outside the key phrase) of every rare word of the notices."""
    seen: dict[str, set[str]] = {}
    for label, _, notice in NOTICES:
        for w in set(notice.split()) - COMMON:
            seen.setdefault(w, set()).add(label)
    labels = len({n[0] for n in NOTICES})
    out = []
    for number, (_, key, notice) in enumerate(NOTICES):
        words, must = notice.split(), key.split()
        at = _starts(words, must)
        out += [(w, number, k, round(math.log(1 + labels / len(seen[w])), 6), not at <= k < at + len(must)) for k, w in enumerate(words) if w not in COMMON]
    return out


def phrases() -> list[tuple[str, int, str, str, int, list[str], int]]:
    """(word, place of the word, mark, label, notice, phrase, start in the notice): counted phrases and key phrases, each led by its first rare word."""
    every = [("base", label, -1, p.split(), 0) for p, label in PHRASES.items()]
    every += [("key", label, number, key.split(), _starts(notice.split(), key.split())) for number, (label, key, notice) in enumerate(NOTICES)]
    out = []
    for mark, label, number, words, start in every:
        at = next(k for k, w in enumerate(words) if w not in COMMON)
        out.append((words[at], at, mark, label, number, words, start))
    return out


#: Words around a rare word that a phrase around it can reach.
REACH = max(len(p[5]) for p in phrases()) - 1


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    index = spark.createDataFrame(postings(), "word string, notice int, at int, idf double, outside boolean")
    led = spark.createDataFrame(phrases(), "word string, led_at int, mark string, label string, notice int, phrase array<string>, phrase_at int")
    vocabulary = sorted({r[0] for r in postings()} | {r[0] for r in phrases()})
    low = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.split(low, SEPARATORS).alias("words"))
    sized = split.select("doc_id", "row", "words", F.size("words").alias("n"), (F.get("words", F.lit(0)) == "").cast("int").alias("lead"), (F.element_at("words", -1) == "").cast("int").alias("tail"))
    every = sized.select("doc_id", "row", "n", "lead", "tail", "words", F.posexplode("words").alias("pos", "word"))
    is_last, is_rare = F.col("pos") == F.col("n") - 1, F.col("word").isin(vocabulary)
    # rare words with the words around them, and the last place of every file, which tells its number of words
    first = F.greatest(F.col("pos") - REACH, F.lit(0))
    met = keep(every.where(is_rare | is_last).select(
        "doc_id", "row", F.greatest(F.col("n") - F.col("lead") - F.col("tail"), F.lit(0)).cast("long").alias("n_words"),
        is_last.alias("is_last"), (F.col("pos") - F.col("lead")).cast("long").alias("pos"), "word", (F.col("pos") - first).alias("here"),
        F.when(is_rare, F.slice("words", first + 1, 2 * REACH + 1)).alias("around")), "licence-words")
    files = met.where("is_last").select("row", "doc_id", "n_words")
    hits = met.where("around is not null").select("row", "pos", "word", "here", "around")
    # phrases whose words all stand around their first rare word
    begin = F.col("here") - F.col("led_at")
    stood = hits.join(F.broadcast(led), "word").where((begin >= 0) & (F.slice("around", F.greatest(begin, F.lit(0)) + 1, F.size("phrase")) == F.col("phrase")))
    places = stood.select("row", "mark", "label", "notice", (F.col("pos") - F.col("led_at")).alias("place"), (F.col("pos") - F.col("led_at") - F.col("phrase_at")).alias("start"))
    base = places.where("mark = 'base'").groupBy("row").agg(F.count("*").alias("n_base"), F.min("place").alias("first_word"), F.max("place").alias("last_word"), F.collect_set("label").alias("base"))
    # every rare word votes for the starts its postings name; a notice counts where its key phrase stands at the start they agree on
    keys = places.where("mark = 'key'").select("row", "label", "notice", "start")
    votes = hits.select("row", "pos", "word").join(F.broadcast(index), "word").select("row", "notice", (F.col("pos") - F.col("at")).alias("start"), "idf", "outside")
    total = spark.createDataFrame([(n, sum(p[3] for p in postings() if p[1] == n), any(p[4] for p in postings() if p[1] == n)) for n in range(len(NOTICES))], "notice int, whole double, has_outside boolean")
    agreed = votes.join(keys, ["row", "notice", "start"]).groupBy("row", "label", "notice", "start").agg(F.count("*").alias("n"), F.sum("idf").alias("idf"), F.max("outside").alias("outside"))
    agreed = agreed.join(F.broadcast(total), "notice").where((F.col("n") >= AGREE) & (F.col("outside") | ~F.col("has_outside")))
    named = agreed.groupBy("row").agg(F.collect_set("label").alias("named"), F.max(F.col("idf") / F.col("whole")).alias("cover"))
    none = F.array().cast("array<string>")
    return (files.join(base, "row", "left").join(named, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.array_join(F.array_sort(F.coalesce("base", none)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(F.coalesce("base", none), F.coalesce("named", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.round(F.least(F.coalesce("cover", F.lit(0.0)), F.lit(1.0)), 6)).alias("score")))
