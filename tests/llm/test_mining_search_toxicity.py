"""Toxicity, phrase mining and ranked search on small tables: hard rows and brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from doseweave.llm import phrase_mining, ranked_search, toxicity
from doseweave.llm.byte_words import Words, byte_classes, whole
from doseweave.llm.clause_grammar import clause_evidence, grammar

SCHEMA = "doc_id long, text string, lang string, source string, score string, rank string, word string"


@pytest.fixture(scope="module")
def hard(spark):
    draw = random.Random(3)
    words = ["alpha", "Beta", "gamma", "von", "der", "über", "x1", "Ω"]
    text = lambda n: "".join(draw.choice(words) + draw.choice([" ", " ", " ", "  ", ", ", "\n", "\t"]) for _ in range(n))
    rows = [(i, text(draw.randint(1, 60)), draw.choice(["en", "de", None])) for i in range(80)]
    rows += [(100, None, "en"), (101, "", "de"), (102, " \n.", None), (103, text(40000), "en"), (5, text(30), "en"), (None, text(20), "de")]
    rows += [(200 + i, "the very same line of words again", "en") for i in range(50)] + [(200, "the very same line of words again", "en")]
    return spark.createDataFrame([(*r, "s", "x", "y", "z") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_at_text_borders():
    column = pa.array([b"ab", b"cD e", None, b"", b" ", b"f"], pa.binary())
    words = Words(*whole(column.slice(0)), byte_classes(b" "))
    assert [words.distinct.to_pylist()[i] for i in words.ids] == [b"ab", b"cd", b"e", b"f"]
    assert words.owner.tolist() == [0, 1, 1, 5]
    assert len(Words(*whole(column.slice(2, 3)), byte_classes(b" "))) == 0


def brute_phrases(rows, least, top):
    counts, total = {}, Counter()
    for r in rows:
        lang = "und" if r.lang is None else r.lang
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), r.text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lowered):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            for size in range(1, 5):
                for i in range(len(w) - size + 1):
                    counts[lang, tuple(w[i : i + size])] = counts.get((lang, tuple(w[i : i + size])), 0) + 1
    cand = {k: v for k, v in counts.items() if len(k[1]) > 1 and v >= least}
    out = {}
    for (lang, p), a in cand.items():
        inside = any(
            len(q) > len(p) and m == lang and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            for (m, q), b in cand.items()
        )
        cuts = [(2000000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        if not inside:
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return {
        (lang, rank, p.decode(), -a, left, right, total[lang], -score)
        for lang, found in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    }


@pytest.mark.parametrize(("least", "top", "hot"), [(30, 2000, 1000), (2, 25, 1000), (2, 2000, 1)])
def test_phrases_match_brute_force(hard, nothing, monkeypatch, least, top, hot):
    """With every leading pair on one route (hot 1) and with most of them spread (hot 1000)."""
    monkeypatch.setattr(phrase_mining, "HOT_PARTS", hot)
    rows = phrase_mining.collocations(hard, least, top).collect()
    assert {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in rows} == brute_phrases(hard.collect(), least, top)
    assert rows and phrase_mining.collocations(nothing).count() == 0


def test_multikey_quicksort_counts_every_frequent_prefix():
    draw = np.random.default_rng(4)
    keys = draw.integers(1, 6, (3000, 4))
    keys[draw.random(3000) < 0.3, 2:] = 0
    keys[draw.random(3000) < 0.2, 3] = 0
    weights = draw.integers(1, 9, 3000)
    want = Counter()
    for key, weight in zip(keys.tolist(), weights.tolist(), strict=True):
        for depth in range(1, 5):
            if key[depth - 1]:
                want[tuple(key[:depth])] += weight
    for least in (1, 60):
        got = {
            tuple(keys[row, :depth].tolist()): int(total)
            for depth, rows, totals in phrase_mining.equal_partitions(keys, weights, least) for row, total in zip(rows, totals, strict=True)
        }
        assert got == {k: v for k, v in want.items() if v >= least}


def brute_search(docs, items, top=10):
    terms = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    tokens = [(r.doc_id, terms(r.text)) for r in docs]
    n, length, df = sum(bool(t) for _, t in tokens), sum(len(t) for _, t in tokens), Counter()
    for _, t in tokens:
        df.update(set(t))
    out = []
    for item, text in items:
        found = []
        for doc, t in tokens:
            tf = Counter(t)
            m = 25 + 75 * len(t) * n // max(length, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 8 * m)) for x in terms(text) if tf[x])
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if missing else doc, -score) for rank, (score, missing, doc) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_search_matches_brute_force(spark, hard, nothing, block):
    """In one block and in several, with terms on both sides of the limit for common ones."""
    items = [(1, "alpha Beta, gamma line of"), (2, "x1 x1 über"), (3, None), (4, ""), (5, "unknown words"), (None, "the very same LINE"), (1, "alpha Beta, gamma line of"), (6, "der Ω")]
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = ranked_search.ranked(hard, table, block_bytes=block).collect()
    assert sorted(map(tuple, rows), key=repr) == brute_search(hard.collect(), items)
    assert ranked_search.ranked(nothing, table, block_bytes=block).count() == 0
    assert ranked_search.ranked(hard, table.limit(0)).count() == 0


def test_clauses():
    def kinds(text, **classes):
        tokens = text.split()
        return {k: v for k, v in clause_evidence(grammar(), tokens, {i: (classes[t], 1.0) for i, t in enumerate(tokens) if t in classes}).items() if v}

    mark = {"idiot": "insult", "kill": "harm"}
    assert kinds("what an idiot", **mark) == {"insult": 1}
    assert kinds("you are an idiot", **mark) == {"aimed insult": 1}
    assert kinds("idiot like you", **mark) == {"aimed insult": 1}
    assert kinds("this is not an idiot", **mark) == {"denied insult": 1}
    assert kinds("it said idiot", **mark) == {"told insult": 1}
    assert kinds('" idiot " is a word', **mark) == {"told insult": 1}
    assert kinds("plants that kill", **mark) == {"harm": 1}
    assert kinds("we will kill", **mark) == {"threat": 1}
    assert kinds("we will kill you", **mark) == {"aimed threat": 1}
    assert kinds("we will not kill", **mark) == {"denied threat": 1}
    assert kinds("you idiot and you idiot", **mark) == {"aimed insult": 2}


def test_toxicity_learns_words_and_leaves_copies_alone(spark, nothing):
    draw = random.Random(8)
    syllables = ["an", "the", "lo", "mer", "ti", "sha", "re"]
    word = lambda: "".join(draw.choice(syllables) for _ in range(draw.randint(1, 4)))
    docs, marks = [], []
    for i in range(600):
        words = [word() for _ in range(draw.randint(20, 80))]
        toxic = int(i % 5 == 0)
        for _ in range(4 * toxic):
            words.insert(draw.randrange(len(words)), "zork" + word())
        docs.append((i, " ".join(words)))
        marks.append((i, 0, toxic))
    copied = "copied words that only look bad qqq www eee rrr"
    docs += [(1000 + i, copied) for i in range(40)] + [(2000, None), (2001, ""), (2002, "zorkan " * 20000), (2003, "a " * 50000), (0, "again " * 5)]
    marks += [(1000 + i, 0, 1) for i in range(40)] + [(None, 0, 1), (7, None, None), (8, 0, 5)]
    table = spark.createDataFrame([(*d, "x", 1.5, 2) for d in docs], "doc_id long, text string, lang string, score double, predicted int")
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.fit(table, labels)
    assert any(e[0].startswith("zork") for e in model.entries) and not any(e[0][:3] in ("qqq", "www", "eee", "rrr", "cop") for e in model.entries)
    rows = toxicity.scored(table, model).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    truth = dict((m[0], m[2]) for m in marks[:600])
    right = [r.predicted == truth[r.doc_id] for r in rows if r.doc_id in truth and r.doc_id % 600 and len(r.text) > 40]
    assert sum(right) >= 0.98 * len(right)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2000].score == by_id[2001].score and by_id[2002].predicted == 1 and by_id[2003].predicted == 0
    untaught = toxicity.fit(table, labels.limit(0))
    assert toxicity.scored(nothing, untaught).count() == 0 and untaught.weights.min() > 0
