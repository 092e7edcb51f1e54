"""The ten operators on small tables: hard rows, and brute force where SQL can't express them."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from doseweave.llm import catalog as llm_catalog
from doseweave.llm import decontamination, html_extraction, language, licences, minhash, mixing, quality, secrets, suffix_dedup, token_files
from doseweave.llm.entropy_coding import FrequencyTable, decode, encode
from doseweave.llm.suffix_sorting import big_endian_words, equal_classes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, labels string"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(["an", "the", "lo", "mer", "ti", "sha"]) for _ in range(draw.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def hard(spark):
    base = prose(1, 120)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, None, None, None), (4, "", "en", "b"), (5, "  \n\t ", None, "b"),
        (6, "1234 !!", "de", None), (7, base + " more words here", "en", "a"), (8, prose(2, 30000), "en", "a"), (9, "Hi", "fr", "b"),
        (10, prose(3, 90), "en", "b"), (10, prose(3, 90), "en", "b"), (None, prose(4, 60), None, "a"),
    ]
    return spark.createDataFrame([(*r, 0, "x", "y") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, prose(1, 40)), (2, "hi"), (3, None), (4, ""), (None, prose(4, 20))], "item_id long, text string")


def test_language(hard, nothing):
    model = language.fit(hard.filter(~language.held_out()))
    rows = {r.doc_id: r for r in language.identified(hard, model).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].lang_rejected for i in (3, 4, 5, 6))
    assert rows[8].lang_pred in model.languages and 0 <= rows[8].score <= 1
    assert language.accepted(hard).columns == hard.columns
    assert 3 not in {r.doc_id for r in language.accepted(hard).collect()}
    assert language.identified(nothing, language.fit(nothing)).count() == 0


def test_language_rejects_what_it_has_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    draw = random.Random(11)
    words = lambda n, low, high: " ".join("".join(chr(draw.randint(low, high)) for _ in range(draw.randint(3, 8))) for _ in range(n))
    alphabets = [(97, 122), (0x430, 0x44F), (0x3B1, 0x3C9), (0x4E00, 0x9000)]
    foreign = [words(n, *a) for a in alphabets for n in (6, 50, 1000, 5000, 30000)]
    model = language.fit(docs.filter(~language.held_out()))
    assert model.nearest(foreign)[2].all()
    kept = language.identified(docs.filter(language.held_out()), model).filter(~F.col("lang_rejected"))
    total, right = docs.filter(language.held_out()).count(), kept.filter("lang = lang_pred").count()
    assert right >= 0.98 * total
    english = " ".join(r.text for r in docs.filter("lang = 'en'").orderBy("doc_id").limit(300).collect())
    assert all(model.nearest([english[:n]])[0] == ["en"] and not model.nearest([english[:n]])[2][0] for n in (500, 5000, 300000))
    assert "lang_rejected" in llm_catalog.op4_language_id(spark, "/root/testdata/sf0.001").columns


def test_mixing(hard, nothing):
    rows = mixing.mixed(hard).collect()
    assert len(rows) == hard.count()
    assert all(r.taken <= 2 * r.size for r in rows)
    total = sum(r["size"] for r in rows)
    assert sum(r.taken for r in rows) <= 1.5 * total
    assert {r.source: r.target for r in rows}[None] == 4.0 and abs(sum({r.source: r.target for r in rows}.values()) - 1.5 * total) < 1e-6
    assert mixing.mixture(hard).columns == hard.columns
    assert mixing.mixed(nothing).count() == mixing.mix_sizes(nothing).count() == 0


@pytest.mark.parametrize("pass_blocks", [8, 2])
def test_decontamination(hard, nothing, bench, monkeypatch, pass_blocks):
    monkeypatch.setattr(decontamination, "PASS_BLOCKS", pass_blocks)

    def brute(text, items):
        words = decontamination.words_of((text or "").encode())
        hit, found = set(), set()
        for item, t in items:
            own = decontamination.words_of((t or "").encode())
            n = min(13, len(own))
            wins = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
            for i in range(len(words) - n + 1 if own else 0):
                if tuple(words[i : i + n]) in wins:
                    hit.update(range(i, i + n))
                    found.add("" if item is None else str(item))
        return len(words), len(hit), sorted(found)

    items = [tuple(r) for r in bench.collect()]
    for size in (1 << 20, 64):  # one block, several blocks
        for r in decontamination.benchmark_hits(hard, bench, block_bytes=size).collect():
            assert (r.n_words, r.n_hit, r.hit_items) == brute(r.text, items)
            assert sum(b - a for a, b in zip(r.hit_starts, r.hit_ends, strict=True)) == r.n_hit and r.longest >= (13 if r.n_hit >= 13 else 0)
    clean = decontamination.decontaminated(hard, bench)
    assert clean.columns == hard.columns and 1 not in {r.doc_id for r in clean.collect()}
    assert decontamination.benchmark_hits(nothing, bench).count() == 0
    assert decontamination.benchmark_hits(hard, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_near_duplicates(spark, hard, nothing):
    draw = random.Random(5)
    texts = {}
    for group in range(6):
        words = prose(100 + group, 80).split()
        for copy in range(12):
            own = list(words)
            for _ in range(copy):
                own[draw.randrange(80)] = f"w{draw.randrange(10**6)}"
            texts[group * 100 + copy] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    shingles = minhash.Shingler()
    sets = {i: set(shingles(t.encode()).tolist()) for i, t in texts.items()}
    root = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                if root[b] > root[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[b], changed = root[a], True
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()} == root
    rows = minhash.near_duplicates(hard).collect()
    found = {r.doc_id: r.component_id for r in rows}
    assert found[2] == 1 and found[7] == 1 and found[None] is None and found[3] == 3 and len(rows) == hard.count()
    assert minhash.near_duplicates(nothing).count() == 0 and minhash.deduplicated(hard).columns == hard.columns


def test_open_clusters_are_linked(spark):
    """Members of a chain that aren't like the smallest one are found through each other."""
    words = prose(77, 200).split()
    chain = []
    for step in range(8):
        own = list(words)
        for k in range(step * 6):
            own[(k * 7) % 200] = f"changed{k}"
        chain.append((step, " ".join(own)))
    rows = minhash.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string")).collect()
    shingles = minhash.Shingler()
    sets = [set(shingles(t.encode()).tolist()) for _, t in chain]
    want = list(range(8))
    for i in range(8):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                want[i] = min(want[i], want[j])
    assert {r.doc_id: r.component_id for r in rows} == dict(enumerate(want))


def test_suffix_dedup(spark, hard, nothing):
    for docs in (hard, spark.createDataFrame([(i, prose(i % 3, 50) + prose(i, 60) + prose(9, 70)) for i in range(30)], "doc_id long, text string")):
        rows = suffix_dedup.deduplicated_bytes(docs).collect()
        texts = [(r.text or "").encode() for r in docs.collect()]
        small = [t for t in texts if len(t) < 100_000]
        want = sorted(suffix_dedup.brute_force(small))
        got = sorted((r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in rows if r.n_bytes < 100_000)
        assert got == want and len(rows) == len(texts)
    assert suffix_dedup.deduplicated_bytes(nothing).count() == 0


def test_salted_anchors_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(i, 40) + prose(9, 90) + prose(i + 500, 40)) for i in range(40)], "doc_id long, text string")
    whole = {r.doc_id: r.n_removed for r in suffix_dedup.deduplicated_bytes(docs).collect()}
    monkeypatch.setattr(suffix_dedup, "GROUP", 4)
    assert {r.doc_id: r.n_removed for r in suffix_dedup.deduplicated_bytes(docs).collect()} == whole and min(whole.values()) > 0


def test_deep_shallow_classes():
    data = (prose(1, 60) + "To To " * 80 + prose(1, 60)).encode()
    starts = np.arange(len(data) - 49)
    order, name = equal_classes(big_endian_words(data), starts, 50)
    strings = [data[i : i + 50] for i in starts]
    want = {int(i) for i in starts if strings.count(strings[i]) > 1}
    assert set(order.tolist()) == want and len(set(name.tolist())) == len({strings[i] for i in want})
    for i, n in zip(order, name, strict=True):
        assert strings[i] == strings[order[np.flatnonzero(name == n)[0]]]


def test_quality(hard, nothing):
    draw = random.Random(3)
    for _ in range(20):
        lengths = [draw.randint(0, 40) for _ in range(5)]
        words = np.array([draw.randint(0, 3) for _ in range(sum(lengths))], np.int64)
        best, at = quality.longest_repeats(words, np.array(lengths)), 0
        for n in lengths:
            own = words[at : at + n].tolist()
            for i in range(n):
                want = max([next((k for k in range(n) if max(i, j) + k >= n or own[i + k] != own[j + k]), 0) for j in range(n) if j != i], default=0)
                assert best[at + i] == want
            at += n
    rows = {r.doc_id: r for r in quality.judged(hard).collect()}
    assert rows[3].n_words == 0 and rows[3].base_failed and not rows[3].kept and rows[8].kept
    assert quality.judged(nothing).count() == 0


def test_licences(spark, hard, nothing):
    texts = ["Released UNDER the MIT License. under the mit license", "under the mit", "Apache License, Version 2.0", "cc-by-nc", "All rights reserved; no part of this may be reproduced"]
    rows = licences.scanned(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()
    assert [(r.n_base, r.base_labels) for r in rows] == [(2, "mit"), (0, ""), (1, "apache-2"), (1, "cc-by-nc"), (0, "")]
    assert (rows[0].first_word, rows[0].last_word, rows[4].labels) == (1, 5, "proprietary")
    assert licences.scanned(hard).count() == hard.count() and licences.scanned(nothing).count() == 0


def test_secrets(spark, hard, nothing):
    texts = ['é token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" x', "AKIA" + "A1" * 8 + " AKIAabc", "PassWord: abc12 secret:abc123", "aB3xK9mQ2wE7rT5yU8iO1pL4", "123e4567-e89b-12d3-a456-426614174000"]
    found = secrets.found_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id")
    spans = [r[0] for r in found.select(secrets.span_text(F.col("spans"))).collect()]
    assert spans[0].startswith("assign:2:51,hex:11:51") and spans[1].startswith("access:0:20") and spans[2].endswith("assign:16:29")
    assert spans[3].startswith("entropy_base64") or spans[3].startswith("entropy_alnum")
    assert "entropy" not in spans[4]
    assert secrets.found_secrets(hard).count() == hard.count() and secrets.found_secrets(nothing).count() == 0


def test_secrets_with_slashes(spark):
    draw = random.Random(5)
    keys = []
    for size in (40, 64, 88, 344):
        made = (base64.b64encode(draw.randbytes(size)).decode()[:size] for _ in range(10000))
        keys += [next(k for k in made if k.count("/") >= least) for least in (2, 3)]
    paths = ["home/user1/Projects/MyApp2/build/output", "/wp-content/uploads/2019/07/IMG_20190712/Final-v2", "Documents/2021/Report-Final_v2/Section3"]
    texts = [f"key {k} end" for k in keys] + paths + ["keys/v1/prod/" + keys[0].replace("/", "")]
    found = secrets.found_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id")
    n = [r[0] for r in found.select(secrets.span_count(F.col("spans"), "entropy_base64")).collect()]
    assert n == [1] * len(keys) + [0] * len(paths) + [1]


def test_coding_round_trip():
    draw = np.random.default_rng(1)
    for n in (0, 1, 5, 1024, 200_001):
        ids = (draw.zipf(1.3, n) % 5000).astype(np.uint32)
        used, counts = np.unique(np.r_[ids, 7].astype(np.int64), return_counts=True)
        table = FrequencyTable(used, counts)
        block = encode(ids, table)
        assert np.array_equal(decode(block, table), ids)
    broken = bytearray(block)
    broken[-3] ^= 1
    with pytest.raises((ValueError, IndexError)):
        decode(bytes(broken), table)


def test_token_files(spark, hard, nothing):
    tokenizer = token_files.word_tokenizer(TOKENIZER).tokenizer
    folder = token_files.scratch_folder(spark)
    token_files.write_token_files(hard, folder, TOKENIZER, block_ids=500)
    rows = token_files.read_token_files(spark, folder, with_ids=True).orderBy("start").collect()
    docs = sorted(hard.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in rows] == [d.doc_id for d in docs]
    total = 0
    for r, d in zip(rows, docs, strict=True):
        ids = [*tokenizer.encode(d.text or "", add_special_tokens=False).ids, token_files.END_ID]
        assert (r.start, r.ids, r.ids_crc32) == (total, ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        total += len(ids)
    empty = token_files.scratch_folder(spark)
    token_files.write_token_files(nothing, empty, TOKENIZER)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_html(spark):
    maker = html_extraction.PageMaker(1234)
    labeller, right, total = html_extraction.default_labeller(), 0, 0
    for _ in range(80):
        html, labels = maker.page()
        found = labeller.decode(html_extraction.block_features(html_extraction.leaf_blocks(html)))
        right, total = right + sum(a == b for a, b in zip(found, labels, strict=True)), total + len(labels)
    assert right > 0.97 * total
    page = "<nav><a href=x>Menu</a></nav><article><h1>A &amp; B</h1><p>One  two\n three.<p>Four&nbsp;five.</article><footer>&copy; me</footer>"
    table = spark.createDataFrame([(1, page, "u"), (2, None, None), (3, "", "u"), (4, "<<<div", "u")], "page_id long, html string, text string")
    rows = {r.page_id: r for r in html_extraction.extracted(table).collect()}
    assert rows[1].text == "A & B\nOne two three.\nFour five." and rows[1].n_chars == len(rows[1].text)
    assert rows[2].text == rows[3].text == "" and rows[2].n_chars == 0
