"""Licence scan with a positional index of rare words.

Every template is a sequence of words with mandatory key phrases. Words get an inverse document frequency over the
templates; the index keeps, for the rarest words of each template, the template and the place inside it. A file's rare
licence words are looked up, their postings minus their own places give starts, and a start on which enough rare words of a
template agree is a candidate; it counts if the key phrases stand where they belong.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame

from doseweave.llm.common import map_texts

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Rare words indexed per template.
RARE_WORDS = 4
#: Words by which a key phrase of a template may be off its place.
SLACK = 8

# Phrases whose places are counted, and the labels they give.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Opening words of well-known licence notices, label and mandatory key phrases.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license version 2"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("gpl-3", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl", "it under the terms of the gnu general public license as published by the free software foundation", ["terms of the gnu general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("agpl-3", "under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial"]),
    ("cc0", "to the extent possible under law the author has dedicated all copyright to the public domain cc0", ["public domain cc0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("proprietary", "all rights reserved no part of this may be reproduced", ["all rights reserved"]),
]


class Template:
    def __init__(self, label: str, words: list[bytes], phrases: list[list[bytes]], base: bool):
        self.label, self.words, self.base = label, words, base
        self.phrases = [(next(i for i in range(len(words)) if words[i : i + len(p)] == p), p) for p in phrases]
        self.needed = 1


class RareWordIndex:
    """Postings (template, place) of the highest-IDF words of each template."""

    def __init__(self, phrases: dict[str, str] | None = None, notices=None, rare: int = RARE_WORDS):
        split = lambda text: WORD.findall(text.lower().encode())
        phrases, notices = BASE_PHRASES if phrases is None else phrases, NOTICES if notices is None else notices
        self.templates = [Template(label, split(p), [split(p)], True) for p, label in phrases.items()]
        self.templates += [Template(label, split(t), [split(k) for k in keys], False) for label, t, keys in notices]
        seen = Counter(w for t in self.templates for w in set(t.words))
        self.idf = {w: math.log((1 + len(self.templates)) / n) for w, n in seen.items()}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for number, template in enumerate(self.templates):
            inner = [w for _, p in template.phrases for w in p]
            pool = set(template.words) if not template.base else set(inner)
            chosen = sorted(pool, key=lambda w: (-self.idf[w], w))[:rare]
            # one place per rare word: its first; a phrase must agree on all, a notice on the half of them
            template.needed = len(chosen) if template.base else (len(chosen) + 1) // 2
            for word in chosen:
                self.postings[word].append((number, template.words.index(word)))
        self.rare = frozenset(self.postings)

    def scan(self, text: bytes) -> dict:
        words = WORD.findall(text.lower())
        found = {"n_words": len(words), "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0}
        rare = self.rare.intersection(words)
        if not rare:
            return found
        votes: dict[tuple[int, int], int] = Counter()
        for place, word in enumerate(words):
            if word in rare:
                for number, offset in self.postings[word]:
                    votes[number, place - offset] += 1
        starts, base, labels, score = [], set(), set(), 0.0
        for (number, start), agreeing in votes.items():
            template = self.templates[number]
            if agreeing < template.needed or not all(self._stands(words, start + at, p, template.base) for at, p in template.phrases):
                continue
            if template.base:
                starts.append(start)
                base.add(template.label)
                share = 1.0
            else:
                share = sum(a == b for a, b in zip(words[max(start, 0) :], template.words[max(-start, 0) :], strict=False)) / len(template.words)
            labels.add(template.label)
            score = max(score, share)
        found |= {"n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None)}
        return found | {"base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": score}

    @staticmethod
    def _stands(words: list[bytes], at: int, phrase: list[bytes], exact: bool) -> bool:
        slack = 0 if exact else SLACK
        return any(words[i : i + len(phrase)] == phrase for i in range(max(at - slack, 0), at + slack + 1) if i >= 0)


def scanned(docs: DataFrame, index: RareWordIndex | None = None, keep=None) -> DataFrame:
    """Every row of ``docs`` with the licences of its whole text.

    Added: ``n_words``, ``n_base`` (places of base phrases), ``first_word`` and ``last_word`` (their least and greatest
    start, null without one), ``base_labels``, ``labels`` (distinct, sorted, comma-joined) and ``score``: 1 for a base
    phrase, else the largest share of a found notice's words in place, 0 if none. Null texts are empty. Columns of
    ``docs`` with the added names are replaced.
    """
    index = index or RareWordIndex()

    def work():
        def step(texts: list[bytes]) -> dict[str, list]:
            rows = [index.scan(t) for t in texts]
            return {k: [r[k] for r in rows] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}

        return step

    added = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return map_texts(docs, work, added, keep=keep)
