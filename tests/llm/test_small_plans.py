"""Components, their plans, and what the driver gets of a language sample."""

import random

import pyspark.sql.classic.dataframe as classic

from doseweave.llm import language, minhash


def smallest(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def test_components_of_chains_stars_and_random_links(spark, monkeypatch):
    draw, scans = random.Random(5), []
    kept = minhash.durable
    monkeypatch.setattr(minhash, "durable", lambda df: (scans.append(df._jdf.queryExecution().executedPlan().toString().count("FileScan")), kept(df))[1])
    chain = [(i, i + 1) for i in range(130, 160)] + [(i + 1, i) for i in range(1000, 1040, 2)]
    stars = [(500, i) for i in range(501, 540)] + [(999, i) for i in range(960, 999)] + [(501, 500), (500, 501)]
    loose = [(draw.randint(2000, 2080), draw.randint(2000, 2080)) for _ in range(60)]
    links = chain + stars + loose + [(160, 999), (-7, 2000), (7, 7)]
    rows = [tuple(r) for r in minhash.components(spark.createDataFrame(links, "a long, b long")).collect()]
    assert len(rows) == len(set(rows)) and dict(rows) == smallest(links)
    assert minhash.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert max(scans) <= 2


def test_settled_links_need_no_round(spark, monkeypatch):
    made, kept = [], minhash.durable
    monkeypatch.setattr(minhash, "durable", lambda df: (made.append(1), kept(df))[1])
    rows = minhash.components(spark.createDataFrame([(1, i) for i in range(2, 9)], "a long, b long")).collect()
    assert {(r.id, r.label) for r in rows} == {(i, 1) for i in range(1, 9)} and len(made) == 2


def test_sampled_trigrams_reach_the_driver_as_arrow(spark, monkeypatch):
    sent, kept = [], classic.DataFrame.collect
    monkeypatch.setattr(classic.DataFrame, "collect", lambda df: (sent.append(df.columns), kept(df))[1])
    texts = {"en": "the house and the river of the town", "de": "das haus und der fluss von der stadt"}
    docs = spark.createDataFrame([(i, f"{t} {i}", k) for i in range(20) for k, t in texts.items()], "doc_id long, text string, lang string")
    model = language.fit(docs)
    assert model.languages == ["de", "en"] and not any("trigrams" in c for c in sent)
    assert model.nearest(list(texts.values()))[0] == ["en", "de"]
