"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets.

Two small collections of ``SIDE`` keys, each made of two minhashes, are paired: table (i, j) has the key
(A_i, B_j). ``SIDE**2`` tables so cost 4 ``SIDE`` minhashes instead of 4 ``SIDE**2``. A pair of similarity s meets in
some table unless no A key or no B key agrees: at the threshold of 0.8 it is missed with a probability of about
2 (1 - 0.64) ** ``SIDE``, 1e-5 for 12, far less above it; groups are also joined through third documents.

* Documents with equal shingle sets are one class from the start, so exact copies never meet in a table.
* First every member of a table key is paired with the key's smallest class only. Confirmed links are joined to
  components. Then members of one key that are still in different components are compared by their signatures inside
  tasks; components that look alike form a cluster, and in a cluster all sets outside the largest component meet all
  others in blocks, where only links that join components leave the task. No group is ever written out as pairs.
* Components come from repeated minimum labels over durable link tables; nothing is collected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doseweave.llm.common import durable, map_texts, pieces

SHINGLE = 4
PERCENT = 80
SIDE = 12
HASHES = 4 * SIDE
#: Signatures of links at the threshold agree in 38 of 48 hashes on average; fewer than this happens once in a million.
AGREEING = 23
#: Members of one key that a task compares with each other at a time.
BLOCK = 512
#: Documents of one block whose full sets a task holds, and shingles of one product of membership matrices.
SETS = 256
COLUMNS = 1 << 13
SEED = 20_000_003
MEMO_WORDS = 1 << 18
_EMPTY = np.zeros(0, np.uint64)


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED)
    return draw.integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, HASHES, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sorted 64-bit hashes of the distinct word shingles of a text."""

    def __init__(self, shingle: int = SHINGLE):
        self.shingle, self.memo = shingle, {}

    def word_hashes(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for word in set(words).difference(memo):
            memo[word] = xxhash.xxh3_64_intdigest(word)
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))

    def __call__(self, text: bytes) -> np.ndarray:
        """A-Z is lower-cased and words end at ASCII white space; fewer words than a shingle are one whole."""
        words = text.lower().split()
        if not words:
            return _EMPTY
        hashes, length = self.word_hashes(words), min(self.shingle, len(words))
        total = np.full(len(words) - length + 1, length, np.uint64)
        for k in range(length):
            total = _mixed(total ^ hashes[k : len(words) - length + 1 + k]) + np.uint64(k)
        return np.unique(total)


def signature(hashes: np.ndarray, multiply: np.ndarray, add: np.ndarray) -> np.ndarray:
    out = np.empty(HASHES, np.uint64)
    for k in range(HASHES):
        out[k] = (hashes * multiply[k] + add[k]).min()
    return (out >> np.uint64(32)).astype(np.uint32)


def sketched(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Per row ``doc_id``, ``n_shingles``, ``set_hash`` (null for an empty set) and ``sig`` (4 bytes per minhash)."""

    def work():
        shingles, (multiply, add) = Shingler(shingle), _multipliers()

        def step(texts: list[bytes]) -> dict[str, list]:
            sets = [shingles(t) for t in texts]
            return {
                "n_shingles": [len(s) for s in sets],
                "set_hash": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "sig": [signature(s, multiply, add).tobytes() if len(s) else None for s in sets],
            }

        return step

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "n_shingles long, set_hash binary, sig binary", keep=["doc_id"])


def table_keys(classes: DataFrame) -> DataFrame:
    """One row (``key``, ``id``) per class and table in which it can meet another class.

    A table key is a pair of side keys, so a class shares it only if it shares both sides. The ``2 * SIDE`` side keys are
    counted first; only those that several classes have are brought back to their class and paired.
    """
    sides = F.array(*[F.xxhash64(F.lit(k), F.substring("sig", k * 8 + 1, 8)) for k in range(2 * SIDE)])
    keyed = classes.select("id", F.xxhash64("set_hash").alias("c"), F.posexplode(sides).alias("side", "h"))
    several = keyed.groupBy("h").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("h")
    shared = keyed.select("id", "c", (F.col("side") < SIDE).alias("left"), "h").join(several, "h", "left_semi")
    met = shared.groupBy("id", "c").agg(
        F.collect_list(F.when(F.col("left"), F.col("h"))).alias("a"), F.collect_list(F.when(~F.col("left"), F.col("h"))).alias("b")
    )
    return met.select("id", F.explode("a").alias("a"), "b").select("id", "a", F.explode("b").alias("b")).select(F.xxhash64("a", "b").alias("key"), "id")


def _sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """``id`` and ``shingles`` (8 bytes each) of the documents that stand for the wanted classes.

    Rows of one id with equal texts are neighbours in their task and give one row.
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")
    wanted = docs.select(F.col("doc_id").cast("long").alias("id"), text).join(ids, "id", "left_semi")

    def run(batches):
        shingles, before = Shingler(shingle), None
        for batch in batches:
            for start, end in pieces(pc.binary_length(batch.column(1)).to_pylist()):
                names, sets = [], []
                for name, value in zip(*[batch.column(i).slice(start, end - start).to_pylist() for i in range(2)], strict=True):
                    row = (name, shingles(value).tobytes())
                    if row != before:
                        names.append(name)
                        sets.append(row[1])
                    before = row
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return wanted.sortWithinPartitions("id", F.xxhash64("text")).mapInArrow(run, "id long, shingles binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a``, ``b`` whose sets are similar enough."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b"
    )

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                shared = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``label``, the smallest id reachable, for all ids of ``links`` (``a``, ``b``).

    Every round replaces a link by one from each end to the smallest neighbour, and then by the neighbour's own; chains
    shorten geometrically. Links are durable after each half of a round, so a plan reads a table twice and no more, and
    rounds end as soon as every id but a smallest one has a single link.
    """
    edges = durable(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    ids = durable(_ends(edges, ("a",), ("b",)).select(F.col("a").alias("id")).distinct())
    while not _settled(edges):
        both = _ends(edges, ("a", "b"), ("b", "a"), ("a", "a"))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = durable(both.join(lowest, "a").filter("b >= a AND m < b").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = durable(_ends(large.join(small, "a"), ("b", "m"), ("a", "m")).filter("a > b").distinct())
    return ids.join(edges, ids.id == edges.a, "left").select("id", F.coalesce("b", "id").alias("label"))


def _ends(edges: DataFrame, *rows: tuple[str, ...]) -> DataFrame:
    """A row ``a``, ``b`` (or ``a`` alone) of each named choice of columns, from one pass."""
    made = [F.struct(*[F.col(c).alias(name) for c, name in zip(row, "ab", strict=False)]) for row in rows]
    return edges.select(F.explode(F.array(*made)).alias("row")).select("row.*")


def _settled(edges: DataFrame) -> bool:
    """Whether every id has a single link to a smaller one that has none: another round would change nothing."""
    up = _ends(edges.select("a", "b", F.lit(1).alias("one"), F.lit(0).alias("none")), ("a", "one"), ("b", "none"))
    places = up.groupBy("a").agg(F.sum("b").alias("links"), F.min("b").alias("least"))
    return places.filter("links > 1 OR links = 1 AND least = 0").isEmpty()


def _forest(left: np.ndarray, right: np.ndarray) -> list[int]:
    """Positions of the pairs that join something new, one after the other."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    kept = []
    for i, (x, y) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(i)
    return kept


def _blocked(members: DataFrame, by: str, block: Column, blocks: Column, skip: Column | None = None) -> DataFrame:
    """Copies each row to all pairs of its block with the blocks of its group: ``block_a`` <= ``block_b``, ``side``."""
    spread = members.withColumns({"_own": block.cast("int"), "_other": F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1))})
    spread = spread.withColumns({
        "block_a": F.least("_own", "_other"), "block_b": F.greatest("_own", "_other"), "side": (F.col("_own") > F.col("_other")).cast("int"),
    })
    return (spread if skip is None else spread.filter(~skip)).drop("_own", "_other")


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    side = table.column("side").to_numpy()
    own = table.column("block_a")[0].as_py() == table.column("block_b")[0].as_py()
    left = np.flatnonzero(side == 0)
    return left, left if own else np.flatnonzero(side == 1)


def _like_components(keyed: DataFrame) -> DataFrame:
    """Components ``a``, ``b`` with members of like signatures under one key, as a spanning forest per pair of blocks.

    ``keyed``: key, block_a, block_b, side, label, sig.
    """

    def run(table: pa.Table) -> pa.Table:
        labels = table.column("label").to_numpy()
        sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(labels), HASHES)
        left, right = _sides(table)
        found = []
        for i in left:
            near = ((sigs[right] == sigs[i]).sum(axis=1) >= AGREEING) & (labels[right] != labels[i])
            other = np.unique(labels[right[near]])
            found.append(np.column_stack([np.full(len(other), labels[i]), other]))
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        pairs = pairs[_forest(pairs[:, 0], pairs[:, 1])]
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return keyed.groupBy("key", "block_a", "block_b").applyInArrow(run, "a long, b long").distinct()


def _links_in_blocks(placed: DataFrame, percent: int) -> DataFrame:
    """Confirmed links between components, from the full sets of two blocks at a time, as a spanning forest.

    ``placed``: cluster, block_a, block_b, side, label, shingles. Sizes of all intersections come from products of
    membership matrices over the shingles that occur more than once.
    """

    def run(table: pa.Table) -> pa.Table:
        labels = table.column("label").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        sizes = np.array([len(x) for x in sets])
        left, right = _sides(table)
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        shared = count[column] > 1
        number = np.cumsum(count > 1) - 1
        owner, column = owner[shared], number[column[shared]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        common = np.zeros((len(left), len(right)), np.float32)
        for first in range(0, int(column.max()) + 1 if len(column) else 0, COLUMNS):
            lo, hi = np.searchsorted(column, [first, first + COLUMNS])
            member = np.zeros((len(sets), COLUMNS), np.float32)
            member[owner[lo:hi], column[lo:hi] - first] = 1
            common += member[left] @ member[right].T
        common = common.astype(np.int64)
        good = (100 * common >= percent * (sizes[left][:, None] + sizes[right][None, :] - common)) & (labels[left][:, None] != labels[right][None, :])
        i, j = np.nonzero(good)
        a, b = labels[left[i]], labels[right[j]]
        kept = _forest(a, b)
        return pa.table({"a": pa.array(a[kept], pa.int64()), "b": pa.array(b[kept], pa.int64())})

    return placed.groupBy("cluster", "block_a", "block_b").applyInArrow(run, "a long, b long")


def _open_links(sets: DataFrame, tagged: DataFrame, like: DataFrame, percent: int) -> DataFrame:
    """Links between components of one cluster, all members with all others except inside its largest component."""
    cluster = components(like).select(F.col("id").alias("label"), F.col("label").alias("cluster"))
    members = durable(tagged.select("id", "label").distinct().join(cluster, "label"))
    sizes = members.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("cluster").agg(F.max(F.struct("n", F.col("label").alias("main"))).alias("x"), F.sum("n").alias("all"))
    main = main.select("cluster", "x.main", F.ceil(F.col("x.n") / SETS).alias("main_blocks"), F.ceil((F.col("all") - F.col("x.n")) / SETS).alias("other_blocks"))
    placed = members.join(main, "cluster").withColumn("inner", F.col("label") == F.col("main"))
    own = F.when(F.col("inner"), F.pmod(F.xxhash64("id"), "main_blocks")).otherwise(F.col("main_blocks") + F.pmod(F.xxhash64("id"), "other_blocks"))
    pairs = _blocked(placed, "cluster", own, F.col("main_blocks") + F.col("other_blocks"), F.col("_other").cast("long") < F.when(F.col("inner"), F.col("main_blocks")).otherwise(F.lit(0)))
    return _links_in_blocks(pairs.join(sets, "id").select("cluster", "block_a", "block_b", "side", "label", "shingles"), percent)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable) and ``kept``.

    Null texts and texts without a word have an empty set and are linked with nothing. Equal sets are always linked.
    Rows with the same ``doc_id`` are one node. A row with a null ``doc_id`` can't be named: it is linked with nothing,
    has a null component and is kept. An empty table gives an empty result.
    """
    rows = durable(sketched(docs, shingle))
    named = rows.filter("doc_id IS NOT NULL AND set_hash IS NOT NULL")
    classes = durable(named.groupBy("set_hash").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n")))
    sizes = classes.groupBy("id").agg(F.first("sig").alias("sig"), F.first("n").alias("n"))
    star = table_keys(classes).withColumn("c", F.min("id").over(Window.partitionBy("key"))).filter("id > c")
    stars = durable(star.select("key", "c", "id"))
    fits = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))
    pairs = durable(
        stars.select(F.col("c").alias("a"), F.col("id").alias("b")).distinct()
        .join(sizes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a")
        .join(sizes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
        .filter(fits(F.col("na"), F.col("nb"))).filter(_agreeing("sa", "sb") >= AGREEING).select("a", "b")
    )
    several = named.groupBy("doc_id").agg(F.min("set_hash").alias("x"), F.max("set_hash").alias("y")).filter("x <> y")
    of_several = named.join(several.select("doc_id"), "doc_id", "left_semi").join(classes.select("set_hash", "id"), "set_hash")
    same_id = of_several.groupBy("doc_id").agg(F.min("id").alias("a"), F.collect_set("id").alias("all"))
    same_id = same_id.select("a", F.explode("all").alias("b")).filter("a <> b")
    wanted = stars.select("id").union(stars.select(F.col("c").alias("id"))).distinct()
    sets = durable(_sets(docs, wanted, shingle))
    links = durable(_confirmed(pairs, sets, percent))
    label = durable(components(links))
    member = stars.select("key", "id").union(stars.select("key", F.col("c").alias("id")).distinct())
    tagged = member.join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    mixed = tagged.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("m")).filter("lo < hi AND m > 2")
    open_rows = tagged.join(mixed.select("key", "m"), "key").join(classes.select("id", "sig"), "id").select("key", "m", "id", "label", "sig")
    blocks = F.ceil(F.col("m") / BLOCK)
    like = durable(_like_components(_blocked(open_rows, "key", F.pmod(F.xxhash64("id"), blocks), blocks).drop("id", "m")))
    if not like.isEmpty():
        links = links.union(_open_links(sets, tagged, like, percent))
    final = components(links.union(same_id))
    label = classes.join(final, "id", "left").select("set_hash", F.coalesce("label", "id").alias("label"))
    out = rows.withColumn("set_hash", F.when(F.col("doc_id").isNotNull(), F.col("set_hash"))).join(label, "set_hash", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _agreeing(x: str, y: str):
    """In how many minhashes two signatures agree."""
    same = [(F.substring(x, 4 * k + 1, 4) == F.substring(y, 4 * k + 1, 4)).cast("int") for k in range(HASHES)]
    total = same[0]
    for term in same[1:]:
        total = total + term
    return total


def deduplicated(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, with its columns, that stand for their group."""
    gone = near_duplicates(docs, shingle, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
