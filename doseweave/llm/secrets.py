"""Secret scan in DataFrame operations: fixed patterns plus sliding-window entropy.

Places of a pattern come from two built-in functions: the matches, and the gaps that splitting by the same pattern
leaves; a match starts where the gaps and matches before it end. Long runs of key characters are candidates. Each has a
character class with an entropy bound, and a window slides over it: the counts of its characters are kept, and the entropy
sum changes by those of the one character that enters and the one that leaves. Every step costs the same however long a
candidate is. Candidates on the allow-list are suppressed.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns and the least length of a match (of its second group for the first one).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_ASSIGNED = 6
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: Character classes of a candidate, the first that fits, with the least window entropy in bits per character.
CLASSES = [
    ("entropy_hex", r"^(?=.*[0-9])(?=.*[a-fA-F])[0-9a-fA-F]+$", 3.05),
    ("entropy_alnum", r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9]+$", 3.65),
    ("entropy_base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_=-]+$", 3.85),
]
#: Candidates that are no secrets: identifiers of known shape and words of samples.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    r"|^[0-9-]+$|(?i:example|sample|placeholder|changeme|dummy|xxxx)"
)
#: A candidate is a path, and no secret, if it has two slashes and so much of the rest stands in pieces of words and numbers.
#: A slash alone says nothing, it is a character of base64.
_WORD = r"(?:[A-Z]*|[A-Z]?[a-z]++(?:[A-Z][a-z]++)*+[0-9]*+|[A-Za-z]{0,4}[0-9]+)"
#: Nothing is tried twice, so that a long piece needs no deep stack: a word must end at a joint or at the end.
PATH_PIECE = f"^{_WORD}(?=[_=+-]|$)(?:[_=+-]{_WORD}(?=[_=+-]|$))*+$"
PATH_SHARE = 0.8
KINDS = ["assign", "access", "hex", *[name for name, _, _ in CLASSES]]
SPAN = "array<struct<kind:int,s:bigint,e:bigint,text:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _places(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Spans of all matches in code points; ``text`` of a span is the wanted group of its match.

    Matches are added up in chunks of about the square root of their number, since adding one copies those of its chunk.
    """
    regex = F.lit(pattern)
    rows = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, regex, F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, regex, F.lit(group)).alias("part"),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("found"))

    def advance(done: Column, row: Column) -> Column:
        begin = done["at"] + F.length(row["gap"])
        end = begin + F.coalesce(F.length(row["hit"]), F.lit(0))
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("s"), end.alias("e"), row["part"].alias("text"))
        return F.struct(end.alias("at"), F.when(row["hit"].isNull(), done["found"]).otherwise(F.concat(done["found"], F.array(span))).alias("found"))

    def chunked(every: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(every))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.size(every), step), lambda at: F.aggregate(F.slice(every, at, step), start, advance))

    def joined(done: Column, chunk: Column) -> Column:
        moved = F.transform(
            chunk["found"], lambda x: F.struct(x["kind"].alias("kind"), (x["s"] + done["at"]).alias("s"), (x["e"] + done["at"]).alias("e"), x["text"].alias("text"))
        )
        return F.struct((done["at"] + chunk["at"]).alias("at"), F.concat(done["found"], moved).alias("found"))

    found = F.aggregate(_let(rows, chunked), start, joined, lambda done: done["found"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def high_entropy(text: Column, bound: Column, window: int = WINDOW) -> Column:
    """First start and last end of the windows of ``text`` at or above ``bound`` bits per character, -1 without one.

    ``text`` holds characters of ``ALPHABET`` only. The counts of the window's characters are a string with one character
    per letter of the alphabet, code point 48 for none, so a step changes two of its characters.
    """
    weight = [n * math.log2(n) if n else 0.0 for n in range(window + 2)]
    gain = F.array(*[F.lit(weight[n + 1] - weight[n]) for n in range(window + 1)])
    letters = F.lit(ALPHABET)
    start = F.struct(
        F.lit(0).alias("i"), F.lit("").alias("seen"), F.lit("0" * len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"),
        F.lit(-1).alias("first"), F.lit(-1).alias("last"),
    )

    def count(counts: Column, at: Column) -> Column:
        return F.ascii(F.substr(counts, at, F.lit(1))) - 48

    def enter(done: Column, char: Column) -> Column:
        at = F.instr(letters, char)
        return F.struct(at.alias("at"), count(done["counts"], at).alias("n"))

    def leave(done: Column, new: Column) -> Column:
        counts = F.overlay(done["counts"], F.char(new["n"] + 49), new["at"], F.lit(1))
        at = F.when(done["i"] >= window, F.instr(letters, F.substr(done["seen"], F.lit(1), F.lit(1)))).otherwise(F.lit(0))
        return F.struct(at.alias("at"), counts.alias("counts"), F.when(at > 0, count(counts, at)).otherwise(F.lit(0)).alias("n"))

    def advance(done: Column, char: Column) -> Column:
        return _let(enter(done, char), lambda new: _let(leave(done, new), lambda old: moved(done, char, new, old)))

    def moved(done: Column, char: Column, new: Column, old: Column) -> Column:
        full = old["at"] > 0
        total = done["sum"] + F.get(gain, new["n"]) - F.when(full, F.get(gain, old["n"] - 1)).otherwise(F.lit(0.0))
        return _let(total, lambda known: stepped(done, char, old, full, known))

    def stepped(done: Column, char: Column, old: Column, full: Column, total: Column) -> Column:
        i = done["i"] + 1
        high = (i >= window) & (F.lit(math.log2(window)) - total / window >= bound)
        return F.struct(
            i.alias("i"), F.concat(F.when(full, F.substr(done["seen"], F.lit(2))).otherwise(done["seen"]), char).alias("seen"),
            F.when(full, F.overlay(old["counts"], F.char(old["n"] + 47), old["at"], F.lit(1))).otherwise(old["counts"]).alias("counts"),
            total.alias("sum"), F.when(high & (done["first"] < 0), i - window).otherwise(done["first"]).alias("first"),
            F.when(high, i).otherwise(done["last"]).alias("last"),
        )

    return F.aggregate(F.split(text, ""), start, advance, lambda done: F.struct(done["first"].alias("first"), done["last"].alias("last")))


def is_path(text: Column) -> Column:
    pieces = F.split(text, "/", -1)
    worded = F.aggregate(F.filter(pieces, lambda x: x.rlike(PATH_PIECE)), F.lit(0), lambda n, x: n + F.length(x))
    return text.rlike("/.*/") & (worded >= PATH_SHARE * (F.length(text) - F.size(pieces) + 1))


def _entropy_spans(text: Column) -> Column:
    candidates = F.filter(_places(text, CANDIDATE, 0), lambda x: ~x["text"].rlike(ALLOWED) & ~is_path(x["text"]))

    def classed(x: Column) -> Column:
        kind, bound = F.lit(-1), F.lit(99.0)
        for number, (_, pattern, least) in reversed(list(enumerate(CLASSES))):
            fits = x["text"].rlike(pattern)
            kind, bound = F.when(fits, F.lit(3 + number)).otherwise(kind), F.when(fits, F.lit(least)).otherwise(bound)
        return F.struct(kind.alias("kind"), x["s"].alias("s"), bound.alias("bound"), x["text"].alias("text"))

    def scanned(x: Column) -> Column:
        return F.struct(x["kind"].alias("kind"), x["s"].alias("s"), high_entropy(x["text"], x["bound"]).alias("w"))

    # the class is settled before the fold, which would otherwise match its patterns again at each step
    kinds = F.filter(F.transform(candidates, classed), lambda x: x["kind"] > 0)
    high = F.filter(F.transform(kinds, scanned), lambda x: x["w"]["first"] >= 0)
    return F.transform(
        high, lambda x: F.struct(x["kind"].alias("kind"), (x["s"] + x["w"]["first"]).alias("s"), (x["s"] + x["w"]["last"]).alias("e"), F.lit("").alias("text"))
    )


def found_secrets(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with ``base_spans`` and ``spans``: kind number, start and end in code points, in order.

    Kinds are numbered as in ``KINDS``; ``spans`` holds the base spans too. Base matches are leftmost and don't overlap
    within a kind. Null and empty texts have none. Columns of ``docs`` with the added names are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    assigned = F.filter(_places(text, ASSIGN, 0, 2), lambda x: F.length(x["text"]) >= LEAST_ASSIGNED)
    base = F.concat(assigned, _places(text, ACCESS, 1), _places(text, HEX, 2))
    plain = lambda spans: F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e"))))
    return docs.withColumn("base_spans", plain(base)).withColumn("spans", F.array_sort(F.concat("base_spans", plain(_entropy_spans(text)))))


def span_text(spans: Column) -> Column:
    """Spans as comma-joined kind:start:end."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"], x["e"])), ",")


def span_count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == KINDS.index(kind))).cast("long")
