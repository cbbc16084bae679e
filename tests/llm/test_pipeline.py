import corpus_pipeline
from codefacts.llm import linededup, simhash
from codefacts.llm.common import table


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == columns
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert len(kept[name]) == docs.count() > 0
    quality = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    assert all(quality.get(i, 1) == 1 for i in kept["quality"])
    assert all(r.n_chars == len(r.text) for r in kept["lines"].values())
    assert linededup.deduplicated(docs).where("n_removed > 0").count() == 0
    fps = [simhash.fingerprint(r.text) for r in kept["near"].values()]
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(fps) for b in fps[:i])
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == set(kept["near"])
    assert sum(r.length for r in got) == sum({r.doc_id: r.doc_tokens for r in got}.values())


def test_edges(spark):
    sf = "/root/testdata/sf0.001"
    schema = table(spark, sf, "documents").schema
    same = " ".join(f"word{i}" for i in range(30))
    rows = [(None, "some words of text", "en", "s", 3), (1, None, None, None, None), (2, "", "en", "s", 0), (3, same, "en", "s", 1), (3, same, "en", "s", 1), (4, same, "en", "s", 1), (5, "12 34", "en", "s", 1)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf).collect()
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.language(spark, spark.createDataFrame(rows, schema), sf).collect()) == [0, 3, 3, 4]
    near = corpus_pipeline.near(spark, spark.createDataFrame(rows, schema), sf).collect()
    assert sorted(r.doc_id or 0 for r in near) == [0, 1, 3, 5]


def test_near_copies(spark):
    """Every pair of five-word similarity 0.8 or more is joined, however many bits the fingerprints differ in."""
    import random

    from codefacts.llm import jaccard

    rng = random.Random(3)
    texts, parent = [], []
    for k in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for copy in range(4):
            w = list(words)
            for _ in range(copy):
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
            parent.append(k)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, table(spark, "/root/testdata/sf0.001", "documents").schema)
    sets = [jaccard.shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if parent[i] == parent[j] and jaccard.similar(sets[i], sets[j], 0.8)]
    assert any((simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count() > 3 for i, j in pairs)
    found = {r.doc_id: r.component for r in jaccard.near_copies(docs).collect()}
    assert all(found[i] == found[j] for i, j in pairs)
    assert all(parent[i] == parent[j] for i in found for j in found if found[i] == found[j])
    kept = {r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()}
    assert kept == {min(i for i in found if found[i] == c) for c in found.values()}


def test_near_large_bucket(spark, monkeypatch):
    """Pieces of a large bucket meet, and the forest joins what any two members of it do."""
    from codefacts.llm import jaccard

    monkeypatch.setattr(jaccard, "SHARD", 3)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(0, 200, 5)] + ["one other text of a few words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component for r in jaccard.near_copies(docs).collect()}
    assert len({found[i] for i in range(40)}) == 1 and found[40] != found[0]


def test_near_ambiguous_ids(spark):
    """Rows that share a doc_id but not their text are documents of their own."""
    texts = ["the quick brown fox jumps over the lazy dog today", "an entirely different text about rivers and mountains far away"]
    schema = table(spark, "/root/testdata/sf0.001", "documents").schema
    docs = spark.createDataFrame([(1, t, "en", "s", 1) for t in texts] + [(2, texts[1], "en", "s", 1)], schema)
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.near(spark, docs, "").collect()) == sorted((1, t) for t in texts)
