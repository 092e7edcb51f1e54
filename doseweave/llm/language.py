"""Language identification by nearest centroid.

A text is the normalised TF-IDF vector of its letter trigrams, none of them hashed together; trigrams that no sampled
text has count in its length only. Each language has several centroids, found by spherical k-means on a bounded sample
of labelled texts; a text takes the language of the nearest centroid by cosine, and is rejected if even that one is too
far. How far is too far depends on the language and on the length of the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doseweave.llm.common import map_texts, with_texts

#: Labelled texts per language that the centroids are fitted on, chosen by hash from all of them.
SAMPLE_PER_LANGUAGE = 300
CENTROIDS = 4
#: A text is rejected below this share of the low quantile of cosines that texts of its length have with their own language.
REJECT_SHARE = 0.5
LOW_QUANTILE = 0.01
#: Lengths are compared by powers of two of trigrams; so many cosines are needed for a quantile of a language and length.
LENGTHS = 32
LEAST_COSINES = 20
#: Code points of the shortest start of a sampled text that cosines are taken of; each next one is twice as long.
SHORTEST_START = 10
#: Bytes of text that are compared at once.
PIECE = 1 << 20
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.array([ord(chr(c).lower()) if chr(c).isalpha() and len(chr(c).lower()) == 1 else 32 for c in range(0x250)], np.uint32)


def trigram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, trigram, count) of each distinct trigram of each text, in order of text.

    What is no letter is a space, and none stands in the middle. A trigram is its three code points in 63 bits.
    """
    lengths = np.array([len(t) + 2 for t in texts], np.int64)
    codes = np.frombuffer(("  " + "  ".join(texts) + "  ").encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(codes < len(_FOLD), _FOLD[np.minimum(codes, len(_FOLD) - 1)], codes)
    letters, place = np.unique(codes, return_inverse=True)
    letters, place, size = letters.astype(np.int64), place.astype(np.int64), len(letters)
    if len(texts) > 1 and size**3 * len(texts) >= 1 << 63:
        half = len(texts) // 2
        parts = [trigram_counts(texts[:half]), trigram_counts(texts[half:])]
        parts[1] = (parts[1][0] + half, *parts[1][1:])
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))
    inner = (codes[1:-1] != 32) if texts else np.zeros(0, bool)
    owner = np.repeat(np.arange(len(texts)), lengths)[inner]
    key = ((owner * size + place[:-2][inner]) * size + place[1:-1][inner]) * size + place[2:][inner] if texts else np.zeros(0, np.int64)
    key, counts = np.unique(key, return_counts=True)
    owner, rest = np.divmod(key, size**3)
    first, rest = np.divmod(rest, size * size)
    return owner, letters[first] << 42 | letters[rest // size] << 21 | letters[rest % size], counts


@dataclass
class LanguageModel:
    """``vocabulary`` is in order; ``floors`` has a row per language and a column per power of two of trigrams."""

    languages: list[str]
    vocabulary: np.ndarray
    idf: np.ndarray
    unseen: float
    centroids: np.ndarray
    owner: np.ndarray
    floors: np.ndarray

    def cosines(self, found: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
        """Cosine of each of ``n`` texts, given as trigram counts, with each centroid."""
        text, trigram, counts = found
        place = np.minimum(np.searchsorted(self.vocabulary, trigram), len(self.vocabulary) - 1)
        seen = self.vocabulary[place] == trigram
        weights = np.log1p(counts) * np.where(seen, self.idf[place], self.unseen)
        norms = np.sqrt(np.bincount(text, weights * weights, n))
        text, place, weights = text[seen], place[seen], weights[seen]
        dots = np.array([np.bincount(text, weights * c[place], n) for c in self.centroids]).T
        return dots / np.where(norms == 0, 1, norms)[:, None]

    def nearest(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language (``und`` without a letter), cosine in 0..1 and rejection of each text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        found = trigram_counts(texts)
        cosine = self.cosines(found, len(texts))
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(texts)), best], 0, 1)
        known = [bool(LETTER.search(t)) for t in texts]
        names = [self.languages[self.owner[b]] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        floor = self.floors[self.owner[best], _length(np.bincount(found[0], found[2], len(texts)))]
        return names, np.where(known, score, 0.0), (score < floor) | (score <= 0) | ~np.array(known, bool)


def _length(trigrams: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(trigrams, 1)).astype(int), LENGTHS - 1)


def _clusters(vectors: np.ndarray, count: int, steps: int = 20) -> np.ndarray:
    """Spherical k-means; the first centres are chosen farthest from each other."""
    centres = [vectors.mean(axis=0)]
    while len(centres) < min(count, len(vectors)):
        centres.append(vectors[(vectors @ np.array(centres).T).max(axis=1).argmin()])
    centres = np.array(centres)
    for _ in range(steps):
        own = (vectors @ centres.T).argmax(axis=1)
        sums = np.array([vectors[own == k].sum(axis=0) if (own == k).any() else centres[k] for k in range(len(centres))])
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = sums / np.where(norms == 0, 1, norms)
    return centres.astype(np.float32)


def _centroids(texts: list[tuple[np.ndarray, np.ndarray]], names: np.ndarray, count: int) -> LanguageModel:
    """The model of trigrams and counts of the texts of ``names``, without floors."""
    vocabulary, df = np.unique(np.concatenate([t for t, _ in texts]), return_counts=True)
    unseen = float(np.log(1 + len(texts)) + 1)
    idf = unseen - np.log(1 + df)
    languages, rows = sorted(set(names)), []
    for name in languages:
        own = [(np.searchsorted(vocabulary, t), np.log1p(n)) for (t, n), x in zip(texts, names, strict=True) if x == name]
        columns = np.unique(np.concatenate([p for p, _ in own]))
        vectors = np.zeros((len(own), len(columns)), np.float32)
        for row, (places, tf) in zip(vectors, own, strict=True):
            weights = tf * idf[places]
            row[np.searchsorted(columns, places)] = weights / np.linalg.norm(weights)
        centres = _clusters(vectors, count)
        rows.append(np.zeros((len(centres), len(vocabulary)), np.float32))
        rows[-1][:, columns] = centres
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return LanguageModel(languages, vocabulary, idf, unseen, np.concatenate(rows), owner, np.zeros((len(rows), LENGTHS)))


def _floors(languages: list[str], cosines: list[tuple[str, int, float]], share: float) -> np.ndarray:
    """``share`` of the low quantile per language and length; from the next shorter length with enough cosines, else the
    next longer one. A language with too few at every length gets the quantiles of all languages together."""

    def quantiles(points: list[tuple[str, int, float]], least: int) -> np.ndarray | None:
        by_length = {k: [c for _, at, c in points if at == k] for k in {at for _, at, _ in points}}
        enough = {k: float(np.quantile(v, LOW_QUANTILE)) for k, v in by_length.items() if len(v) >= least}
        if not enough:
            return None
        return np.array([enough[max((k for k in enough if k <= at), default=min(enough))] for at in range(LENGTHS)])

    together = quantiles(cosines, LEAST_COSINES)
    if together is None:
        together = quantiles(cosines, 1)
    if together is None:
        together = np.zeros(LENGTHS)
    own = [quantiles([p for p in cosines if p[0] == name], LEAST_COSINES) for name in languages]
    return share * np.array([together if q is None else q for q in own])


def fit(
    labelled: DataFrame, rows: int = SAMPLE_PER_LANGUAGE, centroids: int = CENTROIDS, share: float = REJECT_SHARE
) -> LanguageModel:
    """Fits on up to about ``rows`` texts of each non-null ``lang``, those with the lowest hash of ``doc_id``.

    Floors come from cosines of whole texts and of their starts, each with centroids of the other half of the sample.
    Trigrams are counted on the executors; the driver gets the distinct trigrams of each sampled text and start, as
    Arrow batches that pass through its JVM as they are.
    """
    keyed = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "text", F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("string").alias("doc_id")
    )
    place = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(""))), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sizes = {r.lang: r.n for r in keyed.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    nothing = LanguageModel([], np.zeros(0, np.int64), np.zeros(0), 0.0, np.zeros((0, 0), np.float32), np.zeros(0, int), np.zeros((0, LENGTHS)))
    if not sizes:
        return nothing
    size = F.element_at(F.create_map(*[F.lit(x) for pair in sorted(sizes.items()) for x in pair]), F.col("lang"))
    chosen = keyed.filter(place * size <= rows)

    def starts(text: str) -> list[str]:
        lengths = [SHORTEST_START << k for k in range(LENGTHS) if SHORTEST_START << k < len(text)]
        return [text, *[text[:n] for n in lengths]]

    def counted(text: str) -> tuple[list[bytes], list[bytes]]:
        found = [trigram_counts([t])[1:] for t in starts(text)]
        return [t.astype(np.int64).tobytes() for t, _ in found], [n.astype(np.int64).tobytes() for _, n in found]

    def work():
        def step(texts: list[bytes]) -> dict[str, list]:
            made = [counted(t.decode("utf-8", "replace")) for t in texts]
            return {"trigrams": [t for t, _ in made], "counts": [n for _, n in made]}

        return step

    sample = map_texts(
        chosen.select("lang", "doc_id", "text"), work, "trigrams array<binary>, counts array<binary>", keep=["lang", "doc_id"], piece=PIECE
    ).toArrow().to_pylist()
    sample = sorted((r for r in sample if len(r["trigrams"][0])), key=lambda r: (r["lang"], r["doc_id"] or "", r["trigrams"][0], r["counts"][0]))
    if not sample:
        return nothing
    names = np.array([r["lang"] for r in sample], dtype=object)
    vectors = [[(np.frombuffer(t, np.int64), np.frombuffer(n, np.int64)) for t, n in zip(r["trigrams"], r["counts"], strict=True)] for r in sample]
    model = _centroids([v[0] for v in vectors], names, centroids)
    cosines = []
    halves = np.arange(len(sample)) % 2 == 0
    for half in (halves, ~halves):
        if not half.any() or half.all():
            continue
        other = _centroids([v[0] for v, h in zip(vectors, half, strict=True) if not h], names[~half], centroids)
        for v, name in ((v, n) for v, n, h in zip(vectors, names, half, strict=True) if h and n in other.languages):
            text = np.repeat(np.arange(len(v)), [len(t) for t, _ in v])
            all_of = other.cosines((text, np.concatenate([t for t, _ in v]), np.concatenate([n for _, n in v])), len(v))
            own = all_of[:, other.owner == other.languages.index(name)].max(axis=1)
            lengths = _length(np.array([n.sum() for _, n in v]))
            cosines += [(name, int(at), float(c)) for at, c, (t, _) in zip(lengths, own, v, strict=True) if len(t)]
    model.floors = _floors(model.languages, cosines, share)
    return model


def held_out() -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2 (a null id counts as empty)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identified(docs: DataFrame, model: LanguageModel, keep=None) -> DataFrame:
    """Every row of ``docs`` with ``lang_pred``, ``score`` and ``lang_rejected``.

    The whole text is used and nothing else. Null or empty texts and texts without a letter are ``und`` with score 0
    and rejected. Columns of ``docs`` with the added names are replaced. A model without a language rejects all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        def step(texts: list[bytes]) -> dict[str, list]:
            names, score, rejected = shared.value.nearest([t.decode("utf-8", "replace") for t in texts])
            return {"lang_pred": names, "score": score.tolist(), "lang_rejected": rejected.tolist()}

        return step

    return map_texts(docs, work, "lang_pred string, score double, lang_rejected boolean", keep=keep, piece=PIECE)


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with its columns, whose language is recognised; the model is fitted on them first."""
    named = docs.withColumnsRenamed({c: f"carried:{c}" for c in docs.columns if c.lower() in ("lang_pred", "score", "lang_rejected")})
    model = fit(docs.filter(~held_out()))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work():
        return lambda texts: {"rejected": shared.value.nearest([t.decode("utf-8", "replace") for t in texts])[2].tolist()}

    kept = with_texts(named, work, "rejected boolean", "carried:judged", piece=PIECE).filter(~F.col("`carried:judged`.rejected"))
    return kept.select(*[F.col(f"`carried:{c}`" if f"carried:{c}" in named.columns else f"`{c}`").alias(c) for c in docs.columns])
