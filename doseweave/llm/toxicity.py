"""Toxicity by a weighted finite-state pattern grammar.

Insults are a few fixed words and the word beginnings that a bounded sample of labelled texts shows to be toxic; an
Aho-Corasick machine finds them in whole texts. Only clauses with such a word, or with one of harm, are read by the grammar of
``clause_grammar``, which tells plain, aimed, denied and told insults and threats apart. A text's score is a logistic
function of the evidence of each kind; its weights start from the grammar's own and are fitted to the sample.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doseweave.llm.clause_grammar import KINDS, PRIOR, clause_evidence, grammar
from doseweave.llm.common import durable, map_texts

#: Labelled texts that are learned from, at most, by class; chosen by a hash of the id.
SAMPLE = {1: 6000, 0: 12000}
#: Code points of a word beginning.
SHORTEST, LONGEST = 3, 10
#: Labelled toxic texts that a beginning must be in, false entries that are accepted, and entries at most.
SUPPORT, FALSE_ENTRIES, ENTRIES = 5, 0.05, 1000
#: Spread of the weights around the grammar's own.
SPREAD = 2.0

# Fixed word lists.
INSULTS = "idiot moron imbecile stupid scum trash garbage vermin loser pathetic worthless disgusting clown fool bastard dumb dummkopf trottel abschaum versager connard crétin ordure imbécile estúpido basura escoria".split()
HARMS = "kill hurt destroy beat burn shoot stab punch smash hang töten schlagen vernichten tuer frapper détruire matar golpear destruir".split()

WORD = re.compile(r"\w+")
TOKEN = re.compile(r'\w+|["“”„«»]')
CLAUSE_END = re.compile(r"[.;:!?\n\r]")
_WHOLE = "\0"


@dataclass
class ToxicityModel:
    """``entries``: (beginning, whole word only, class, strength); ``weights`` by kind of match."""

    entries: list[tuple[str, bool, str, float]]
    weights: np.ndarray = field(default_factory=lambda: np.array([PRIOR[k] for k in KINDS]))
    bias: float = -3.0

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.bias + evidence @ self.weights, -30, 30)))


class Reader:
    """Evidence of whole texts."""

    def __init__(self, model: ToxicityModel):
        self.machine, self.finder = grammar(), ahocorasick.Automaton()
        for beginning, full, kind, strength in model.entries:
            known = self.finder.get(beginning, {"length": len(beginning)})
            known[full] = (kind, strength)
            self.finder.add_word(beginning, known)
        if len(self.finder):
            self.finder.make_automaton()

    def _anchors(self, text: str) -> list[tuple[int, str, float]]:
        """(place, class, strength) of the listed words, by place; the longest entry of a word counts."""
        found: dict[int, tuple[int, str, float]] = {}
        for end, known in self.finder.iter(text) if len(self.finder) else ():
            length = known["length"]
            begin = end - length + 1
            if begin and (text[begin - 1].isalnum() or text[begin - 1] == "_"):
                continue
            ends = end + 1 == len(text) or not (text[end + 1].isalnum() or text[end + 1] == "_")
            entry = known.get(True) if ends and True in known else known.get(False)
            if entry and found.get(begin, (0,))[0] < length:
                found[begin] = (length, *entry)
        return [(place, *found[place][1:]) for place in sorted(found)]

    def evidence(self, text: str) -> list[float]:
        """log2(1 + strength) of each kind of match over all clauses of a text."""
        text = text.lower()
        anchors, total = self._anchors(text), Counter()
        i = 0
        while i < len(anchors):
            place = anchors[i][0]
            begin = max(text.rfind(c, 0, place) for c in ".;:!?\n\r") + 1
            stop = CLAUSE_END.search(text, place)
            end = stop.start() if stop else len(text)
            tokens, known = [], {}
            while i < len(anchors) and anchors[i][0] < end:
                known[anchors[i][0]] = anchors[i][1:]
                i += 1
            places = {}
            for token in TOKEN.finditer(text, begin, end):
                if token.start() in known:
                    places[len(tokens)] = known[token.start()]
                tokens.append(token.group())
            total.update(clause_evidence(self.machine, tokens, places))
        return [math.log2(1 + max(total[k], 0.0)) for k in KINDS]


def held_out() -> Column:
    """Whether a row is kept from learning: crc32 of its id as text, modulo 5, is 0 (a null id counts as empty)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _sample(docs: DataFrame, labels: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """Texts (text, toxic) of the labelled ids with the lowest hashes, as many of each class as ``sizes`` says.

    Of texts with the same class and signature one stays, so that copies of a text don't make its words look toxic.
    """
    marks = labels.filter(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    by_id = marks.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = None
    for kind, rows in sizes.items():
        own = by_id.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        chosen = own if chosen is None else chosen.unionByName(own)
    # At most 18,000 ids and marks, so they can go to every task; an id with many rows is cut to the same bound below.
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(durable(chosen)), "doc_id")
    keyed = texts.select(F.xxhash64("doc_id", "text").alias("key"), "text", "toxic")
    limit = keyed.select("key").distinct().orderBy("key").limit(sum(sizes.values())).agg(F.max("key").alias("last"))
    bounded = keyed.filter(F.col("key") <= limit.scalar()).dropDuplicates(["key"])

    def work():
        return lambda texts: {"signature": [signature(t.decode("utf-8", "replace")) for t in texts]}

    signed = map_texts(bounded, work, "signature long")
    first = signed.groupBy("signature", "toxic").agg(F.min(F.struct("key", "text")).alias("first"))
    return durable(first.select("toxic", F.col("first.text").alias("text")))


def signature(text: str) -> int:
    """The lowest hash of three words in a row (of the whole text, if shorter): near copies mostly have the same one."""
    words = [zlib.crc32(w.encode()) for w in WORD.findall(text.lower())]
    if len(words) < 3:
        return zlib.crc32(text.encode())
    a = np.array(words, np.uint64)
    with np.errstate(over="ignore"):
        mixed = (a[:-2] * np.uint64(0x9E3779B97F4A7C15) + a[1:-1]) * np.uint64(0xBF58476D1CE4E5B9) + a[2:]
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return int((mixed ^ (mixed >> np.uint64(29))).min() >> np.uint64(1))


def beginnings(text: str) -> set[str]:
    """Word beginnings of a text, and its whole words (marked by a final zero)."""
    words = set(WORD.findall(text.lower()))
    return {w[:n] for w in words for n in range(SHORTEST, min(len(w), LONGEST) + 1)} | {w + _WHOLE for w in words if len(w) <= LONGEST}


def _beginning_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = {0: Counter(), 1: Counter()}
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[toxic].update(beginnings(text))
        names = sorted(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([counts[1][n] for n in names], pa.int64()), pa.array([counts[0][n] for n in names], pa.int64())],
            names=["beginning", "toxic", "clean"],
        )


def _learned(found: list[tuple[str, int, int]], toxic: int, clean: int) -> list[tuple[str, bool, str, float]]:
    """Entries from (beginning, toxic texts, clean texts): those that chance doesn't explain, none inside another."""
    base = toxic / max(toxic + clean, 1)
    scored = []
    for name, a, b in found:
        share = a / (a + b)
        if share <= base:
            continue
        gain = (a + b) * (share * math.log(share / base) + ((1 - share) * math.log((1 - share) / (1 - base)) if b else 0.0))
        scored.append((gain, name, a, b))
    least = math.log(max(len(found), 1) / FALSE_ENTRIES)
    # The longest of equally good beginnings is the most exact one; a whole word gives way to the same letters as a beginning.
    scored.sort(key=lambda x: (-round(x[0], 9), -(0 if x[1].endswith(_WHOLE) else len(x[1])), x[1]))
    taken: list[tuple[str, bool, str, float]] = []
    for gain, name, a, b in scored:
        letters = name.rstrip(_WHOLE)
        # Half of all texts with it, at least, are toxic, whatever the sample's share of toxic texts was.
        if gain < least or a <= 2 * b or len(taken) >= ENTRIES:
            continue
        if any(letters.startswith(t) or t.startswith(letters) for t, *_ in taken):
            continue
        taken.append((letters, name.endswith(_WHOLE), "insult", round((a + 1) / (a + 3 * b + 2), 6)))
    return taken


def _fitted(model: ToxicityModel, evidence: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> ToxicityModel:
    """Weights with the highest posterior, by Newton steps with halving; never below zero."""
    x = np.c_[evidence, np.ones(len(evidence))]
    prior = np.append([PRIOR[k] for k in KINDS], model.bias)
    precision = np.append(np.full(len(KINDS), 1 / SPREAD**2), 1e-4)

    def loss(beta: np.ndarray) -> float:
        z = x @ beta
        return float((weights * (np.logaddexp(0, z) - toxic * z)).sum() + 0.5 * (precision * (beta - prior) ** 2).sum())

    beta = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (weights * (p - toxic)) + precision * (beta - prior)
        curve = (x * (weights * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(precision)
        step, size = np.linalg.solve(curve, slope), 1.0
        while loss(beta - size * step) > loss(beta) and size > 1e-6:
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return ToxicityModel(model.entries, np.maximum(beta[:-1], 0.0), float(beta[-1]))


def fit(docs: DataFrame, labels: DataFrame, sizes: dict[int, int] | None = None) -> ToxicityModel:
    """Learns from the rows of ``labels`` that aren't held out and the texts of their ids.

    ``sizes`` bounds the sample by class. Labels other than 0 and 1 and null ids are left out, an id with several labels is toxic
    if one of them is. Without any labelled text the model is the fixed lists with the grammar's own weights.
    """
    sample = _sample(docs, labels, sizes or SAMPLE)
    counts = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    fixed = [(w, False, "insult", 1.0) for w in INSULTS] + [(w, True, "harm", 1.0) for w in HARMS]
    if not counts.get(1) or not counts.get(0):
        return ToxicityModel(fixed)
    seen = sample.select("text", "toxic").mapInArrow(_beginning_counts, "beginning string, toxic long, clean long")
    sums = seen.groupBy("beginning").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # At most twenty times the entries come back, those with the most toxic texts above their clean ones.
    best = sums.filter((F.col("toxic") >= SUPPORT) & (F.col("toxic") > 2 * F.col("clean"))).orderBy((F.col("toxic") - F.col("clean")).desc(), "beginning")
    learned = _learned([(r.beginning, r.toxic, r.clean) for r in best.limit(20 * ENTRIES).collect()], counts[1], counts[0])
    letters = [e[0] for e in learned]
    rest = [e for e in fixed if not any(e[0].startswith(x) for x in letters)]
    model = ToxicityModel(learned + rest)
    rows = evidenced(sample, model, ["toxic"]).groupBy("toxic", "evidence").agg(F.count(F.lit(1)).alias("n")).collect()
    share = labels.filter(~held_out() & F.col("toxic").isin(0, 1)).agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.5
    # The sample has more toxic texts than the labels: its rows are weighed back, so that scores are probabilities.
    scale = {1: share / counts[1], 0: (1 - share) / counts[0]}
    size = sum(counts.values())
    return _fitted(
        model, np.array([list(r.evidence) for r in rows]), np.array([float(r.toxic) for r in rows]),
        np.array([r.n * scale[r.toxic] * size for r in rows]),
    )


def evidenced(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None) -> DataFrame:
    """Adds ``evidence``: log2(1 + strength) of each kind of match."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        reader = Reader(shared.value)
        return lambda texts: {"evidence": [reader.evidence(t.decode("utf-8", "replace")) for t in texts]}

    return map_texts(docs, work, "evidence array<double>", keep=keep)


def scored(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from a score of 0.5).

    The whole text is read and nothing else. A null or empty text has no evidence and so the score of a text without a match.
    Repeated rows are scored each; columns of ``docs`` with the added names are replaced. Scores are rounded to 12 digits, so
    that they don't depend on the order of additions.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        model = shared.value
        reader = Reader(model)

        def step(texts: list[bytes]) -> dict[str, list]:
            evidence = np.array([reader.evidence(t.decode("utf-8", "replace")) for t in texts]).reshape(len(texts), len(KINDS))
            score = np.round(model.score(evidence), 12)
            return {"score": score.tolist(), "predicted": (score >= 0.5).astype(int).tolist()}

        return step

    return map_texts(docs, work, "score double, predicted int", keep=keep)
