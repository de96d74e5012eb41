"""License scans with SQL functions only: a positional index of the templates' rare words."""

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygauge.llm.common import settle, text_of
from skygauge.llm.rows import let

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases that count by themselves, with their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Label, customary words of the notice or grant, phrases that must be in place.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
     "associated documentation files the software to deal in the software without restriction",
     ("permission is hereby granted", "without restriction")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
     "hereby granted", ("without fee is hereby granted",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
     "that the following conditions are met", ("source and binary forms", "following conditions are met")),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("gpl", "licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license as published by the "
     "free software foundation", ("gnu general public license",)),
    ("lgpl", "redistribute it and or modify it under the terms of the gnu lesser general public license as published "
     "by the free software foundation", ("gnu lesser general public license",)),
    ("agpl", "redistribute it and or modify it under the terms of the gnu affero general public license as published "
     "by the free software foundation", ("gnu affero general public license",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ("mozilla public license",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license",
     ("creative commons attribution",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ("unencumbered software", "public domain")),
    ("zlib", "provided as is without any express or implied warranty in no event will the authors be held liable for "
     "any damages arising from the use of this software", ("implied warranty", "authors be held liable")),
    ("bsl", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("epl", "made available under the terms of the eclipse public license v 2 0", ("eclipse public license",)),
    # conditions, grants and disclaimers that stand without the notice
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial "
     "portions of the software", ("substantial portions of the software",)),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software "
     "including all implied warranties of merchantability and fitness", ("author disclaims all warranties",)),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the "
     "following disclaimer", ("redistributions of source code",)),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
     "following disclaimer in the documentation", ("redistributions in binary form",)),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied "
     "warranties including but not limited to the implied warranties of merchantability and fitness for a particular "
     "purpose are disclaimed", ("copyright holders and contributors", "purpose are disclaimed")),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is "
     "distributed on an as is basis without warranties or conditions of any kind",
     ("unless required by applicable law", "conditions of any kind")),
    ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at", ("copy of the mpl",)),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source "
     "code form or as a compiled binary", ("publish use compile sell",)),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications "
     "and to alter it and redistribute it freely", ("alter it and redistribute it freely",)),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the "
     "software and accompanying documentation covered by this license", ("person or organization obtaining",)),
)

#: Words in more templates than this are not indexed. A template's postings are those of this many of its
#: indexed words, the rarest by IDF, that have this part of its highest IDF (stop words have not); this
#: share of their weight must fall into place.
COMMON, LOOKED_UP, RARE, SHARE = 8, 8, 0.3, 0.5


class Postings:
    """Where the templates hold their rare words and key phrases."""

    def __init__(self, templates=TEMPLATES):
        texts = [text.split() for _, text, _ in templates]
        spread = Counter(w for words in texts for w in set(words))
        anchors = {w for phrase in BASE for w in phrase.split()[:1]}
        self.rare = sorted({w for w in spread if spread[w] <= COMMON and len(w) > 1} | anchors)
        self.labels = [label for label, _, _ in templates]
        self.places = {w: [] for w in self.rare}
        for t, words in enumerate(texts):
            for at, word in enumerate(words):
                if word in self.places:
                    self.places[word].append((t, at))
        self.phrases = [(t, phrase, self._find(texts[t], phrase.split())) for t, (_, _, keys) in enumerate(templates) for phrase in keys]
        self.wanted = Counter(t for t, _, _ in self.phrases)
        rare = set(self.rare)
        for phrase in [*BASE, *(p for _, p, _ in self.phrases)]:
            if not rare & set(phrase.split()):
                raise ValueError(f"no indexed word in {phrase!r}")

    @staticmethod
    def _find(words, phrase):
        return next(i for i in range(len(words)) if words[i:i + len(phrase)] == phrase)

    def chosen(self, idf: dict[str, float]) -> dict[str, list[tuple[int, int]]]:
        """Word -> (template, place): each template's own LOOKED_UP words of highest IDF, of equal ones
        the first by code point, so that templates do not compete for words."""
        own: dict[int, set] = {}
        for word, places in self.places.items():
            for t, _ in places:
                own.setdefault(t, set()).add(word)
        kept: dict[str, list] = {}
        for t, words in own.items():
            best = sorted(words, key=lambda w: (-idf[w], w))[:LOOKED_UP]
            for word in best:
                if idf[word] >= RARE * idf[best[0]]:
                    kept.setdefault(word, []).extend(p for p in self.places[word] if p[0] == t)
        return kept


def _words(text: Column) -> tuple[Column, Column, Column]:
    """Pieces between separators, how many empty ones lead, and how many are words. Lower-casing
    all letters names the same ASCII words and boundaries as lower-casing A-Z."""
    pieces = F.split(F.lower(text), SPLIT, -1)
    return pieces, lambda p: (F.get(p, F.lit(0)) == "").cast("int"), lambda p: (
        F.greatest(F.lit(0), F.size(p) - (F.get(p, F.lit(0)) == "").cast("int") - (F.element_at(p, -1) == "").cast("int"))
    )


def _phrase_places(pieces: Column, hits: Column, phrase: str, rare: set[str]) -> Column:
    """Where, counted in pieces, the phrase's words stand consecutively."""
    words = phrase.split()
    anchor = next(i for i, w in enumerate(words) if w in rare)
    wanted = F.array(*map(F.lit, words))
    here = F.filter(hits, lambda h: (h["word"] == words[anchor]) & (h["at"] >= anchor) & (
        F.slice(pieces, F.greatest(h["at"] - anchor, F.lit(0)) + 1, F.lit(len(words))) == wanted))
    return F.transform(here, lambda h: h["at"] - anchor)


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row per row.

    Words are the runs of digits, letters and non-ASCII characters of the lower-cased text, from 0.
    n_base counts the places of the base phrases, first_word and last_word are the smallest and
    largest of their starts (null without any), base_labels their labels. labels adds those of
    templates that a text holds: each template's own rarest words by IDF over all documents are
    looked up in its postings, wherever and however often the text has them; entries of a template
    that agree on the relative position are added up by IDF; where they reach ``share`` of the template's weight and every
    key phrase stands at the same relative position, the template's label is given, whatever
    else the text holds. score is the largest such share (0 to 1; 0 without any). Labels are
    sorted, distinct arrays.

    Texts are cut into words once; what goes on is the few indexed words and phrase places of each,
    frozen on shared storage, then events keyed by (row, template, relative position), which
    combine before the shuffle; a text with very many of them is spread by its positions. The
    templates are a fixed list. A null text is empty; repeated rows give repeated rows; an empty
    table gives none. Other columns are not read.
    """
    index = Postings()
    rare = set(index.rare)
    phrases = [*BASE, *dict.fromkeys(p for _, p, _ in index.phrases if p not in BASE)]
    number = {p: i for i, p in enumerate(phrases)}
    pieces, lead, count = _words(F.col("text"))
    some = F.array(*map(F.lit, index.rare))

    def found(p):
        shift = lead(p)
        at = F.array_compact(F.transform(p, lambda w, i: F.when(w.isin(*index.rare), F.struct(w.alias("word"), i.alias("at")))))

        def places(hits, phrase):
            return F.transform(
                _phrase_places(p, hits, phrase, rare),
                lambda i: F.struct(F.lit(number[phrase]).alias("phrase"), (i - shift).alias("at")),
            )

        def kept(hits):
            moved = F.transform(hits, lambda h: F.struct(h["word"].alias("word"), (h["at"] - shift).alias("at")))
            return F.struct(moved.alias("hits"), F.concat(*(places(hits, phrase) for phrase in phrases)).alias("phrases"))

        none = F.struct(F.array().cast("array<struct<word:string,at:int>>").alias("hits"),
                        F.array().cast("array<struct<phrase:int,at:int>>").alias("phrases"))
        return F.struct(count(p).alias("n_words"), F.when(F.arrays_overlap(p, some), let(at, kept)).otherwise(none).alias("f"))

    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).select("id", let(pieces, found).alias("p"))
    rows = settle(rows.select(F.monotonically_increasing_id().alias("row"), "id", "p.n_words", "p.f.hits", "p.f.phrases"))

    with_hits = rows.where(F.size("hits") > 0)
    stats = with_hits.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["word"]))).alias("word")).groupBy("word").count()
    seen = {r.word: r["count"] for r in stats.collect()}  # at most the indexed words
    documents = rows.count()
    idf = {w: math.log((documents + 1) / (seen.get(w, 0) + 1)) + 1e-9 for w in index.rare}
    chosen = index.chosen(idf)
    weights = [sum(idf[w] for w, places in chosen.items() for u, _ in places if u == t) for t in range(len(index.labels))]

    idf_map = F.create_map(*(x for w in chosen for x in (F.lit(w), F.lit(idf[w]))))
    entry = "array<struct<t:int,at:int>>"
    post = F.create_map(*(x for w in chosen for x in (
        F.lit(w), F.array(*(F.struct(F.lit(t).alias("t"), F.lit(a).alias("at")) for t, a in chosen[w])).cast(entry))))
    keys: dict[int, list] = {}
    for t, phrase, at in index.phrases:
        keys.setdefault(number[phrase], []).append((t, at))
    phrase_post = F.create_map(*(x for n, places in keys.items() for x in (
        F.lit(n), F.array(*(F.struct(F.lit(t).alias("t"), F.lit(a).alias("at")) for t, a in places)))))

    votes = with_hits.select("row", F.explode("hits").alias("h")).select(
        "row", F.explode(F.element_at(post, F.col("h.word"))).alias("p"), F.col("h.at").alias("at"), F.element_at(idf_map, F.col("h.word")).alias("w"),
    ).select("row", "p.t", (F.col("at") - F.col("p.at")).alias("offset"), "w", F.lit(0).alias("key"))
    proofs = with_hits.select("row", F.explode("phrases").alias("h")).select(
        "row", F.explode(F.element_at(phrase_post, F.col("h.phrase"))).alias("p"), F.col("h.at").alias("at"),
    ).select("row", "p.t", (F.col("at") - F.col("p.at")).alias("offset"), F.lit(0.0).alias("w"), F.lit(1).alias("key"))
    aligned = votes.unionByName(proofs).groupBy("row", "t", "offset").agg(F.sum("w").alias("w"), F.sum("key").alias("keys"))
    get = lambda values, kind: F.element_at(F.array(*map(F.lit, values)), F.col("t") + 1).cast(kind)
    part = F.least(F.lit(1.0), F.col("w") / get(weights, "double"))
    held = (
        aligned.where((F.col("keys") == get([index.wanted[t] for t in range(len(weights))], "long")) & (part >= share))
        .groupBy("row").agg(F.collect_set(get(index.labels, "string")).alias("method"), F.max(part).alias("score"))
    )

    base = F.filter("phrases", lambda p: p["phrase"] < len(BASE))
    at = F.transform(base, lambda p: p["at"].cast("long"))
    names = F.transform(base, lambda p: F.element_at(F.array(*map(F.lit, BASE.values())), p["phrase"] + 1))
    base_labels = F.array_sort(F.array_distinct(names))
    return rows.join(held, "row", "left").select(
        "id", F.col("n_words").cast("long").alias("n_words"), F.size(base).cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), base_labels.alias("base_labels"),
        F.array_sort(F.array_union(base_labels, F.coalesce("method", F.array().cast("array<string>")))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
