"""The corpus pipeline's near-dedup against brute-force Jaccard on copies with scattered edits."""

import random
from itertools import combinations

import corpus_pipeline as pipeline
from tarnwick.llm import jaccard_dedup
from tests.llm.conftest import SF
from tests.llm.test_operators import simhash


def shingles(text, size=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randrange(10**9)}"
    return words


def kept_by_brute_force(texts):
    """The smallest id of each component, and the linked pairs."""
    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = []
    for a, b in combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if 5 * len(x & y) >= 4 * len(x | y):
            near.append((a, b))
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return sorted({find(k) for k in texts}), near


def test_edited_copies_against_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = rng.choices(vocabulary, k=40)
    texts = {}
    for base in range(40):
        words = rng.choices(vocabulary, k=rng.randrange(60, 400))
        if base % 3 == 0:
            words += passage
        for k in range(6):
            texts[len(texts) + 1] = " ".join(edited(rng, words, rng.randrange(0, 1 + len(words) // 22)) if k else words)
    hub = rng.choices(vocabulary, k=200)
    for _ in range(80):
        texts[len(texts) + 1] = " ".join(edited(rng, hub, rng.randrange(2, 5)))
    chain = rng.choices(vocabulary, k=150)
    for k in range(12):
        texts[len(texts) + 1] = " ".join(chain[4 * k : 4 * k + 90])
    for text in ("one two", "One  two", "one two three", "", None, " "):
        texts[len(texts) + 1] = text
    want, near = kept_by_brute_force(texts)
    far = [p for p in near if (simhash(texts[p[0]] or "") ^ simhash(texts[p[1]] or "")).bit_count() > 2]
    assert len(far) > 100
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in pipeline.near_dedup(spark, docs, SF).collect()) == want


def test_hub_of_near_copies_on_either_side_of_the_threshold(spark):
    """Copies of one text that mostly link through it alone, as many pairs lie below 0.8, and a boilerplate that many others share."""
    rng = random.Random(3)
    vocabulary = [f"v{i}" for i in range(2000)]
    hub, boiler = rng.choices(vocabulary, k=100), rng.choices(vocabulary, k=60)
    rows = [" ".join(edited(rng, hub, 2)) for _ in range(60)] + [" ".join(boiler + rng.choices(vocabulary, k=rng.randrange(8, 30))) for _ in range(60)]
    texts = dict(enumerate(rows))
    want, _ = kept_by_brute_force(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in pipeline.near_dedup(spark, docs, SF).collect()) == want


def test_long_texts_that_share_a_passage_are_told_apart_without_their_texts(spark):
    """2,048 parities say nothing of sets of 6,000 shingles and more; similar pairs are never lost, also where one set has twice as many cells."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(1500)]
    texts = [" ".join(passage + [f"t{k}_{i}" for i in range(rng.randrange(4700, 7000))]) for k in range(8)]
    base = [f"b{i}" for i in range(8150)]
    texts += [" ".join(base), " ".join(base + [f"c{i}" for i in range(900)]), " ".join(edited(rng, base, 100))]
    docs = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    heads = docs.select("node", jaccard_dedup._begun(docs, "text", 5, 80).alias("made")).select("node", "made.*")
    fits = [(a, b) for a, b in combinations(range(len(texts)), 2) if 5 * min(len(shingles(texts[a])), len(shingles(texts[b]))) >= 4 * max(len(shingles(texts[a])), len(shingles(texts[b])))]
    assert len(fits) > 15
    got = jaccard_dedup._possible(spark.createDataFrame(fits, "a long, b long"), heads, 80).select("a", "b").collect()
    assert {tuple(r) for r in got} == {(8, 9), (8, 10), (9, 10)} & set(kept_by_brute_force(dict(enumerate(texts)))[1])
    assert (8, 9) in {tuple(r) for r in got}


def test_pairs_of_copies_with_shared_runs_are_met_once(spark):
    """Near copies share long runs of shingles, with gaps between; each similar pair is found though only the first shingle of a run makes a row."""
    rng = random.Random(13)
    hub = [f"h{i}" for i in range(400)]
    texts = {k: " ".join(edited(rng, hub, rng.randrange(0, 9))) for k in range(60)}
    want, near = kept_by_brute_force(texts)
    assert near
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in pipeline.near_dedup(spark, docs, SF).collect()) == want


def test_a_hub_asks_for_few_parities(spark, monkeypatch):
    """Of a large group's candidates, each text's most promising one is tried before the parities of all are fetched."""
    rng = random.Random(5)
    hub = rng.choices([f"w{i}" for i in range(3000)], k=200)
    texts = {i: " ".join(edited(rng, hub, rng.randrange(3, 6))) for i in range(1, 201)}
    tried, possible = [], jaccard_dedup._possible
    monkeypatch.setattr(jaccard_dedup, "_possible", lambda pairs, *more: tried.append(pairs.count()) or possible(pairs, *more))
    monkeypatch.setattr(jaccard_dedup, "PIVOT_ROUNDS", 0)
    kept = jaccard_dedup.keep_one_similar(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == kept_by_brute_force(texts)[0]
    assert sum(tried) <= 10 * len(texts), tried


def test_whole_rows_are_not_shuffled(spark):
    """Rows with their texts stay where they are, however small the tables are that Spark may broadcast by itself."""
    from tarnwick.llm.common import setting

    rows = [(i, f"a text of some words that is number {i // 2} of a few") for i in range(40)]
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", -1):
        kept = jaccard_dedup.keep_one_similar(spark.createDataFrame(rows, "doc_id long, text string"))
        assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 40, 2))


def test_rows_are_chosen_by_bits(spark, monkeypatch):
    rows = spark.createDataFrame([(n, str(n)) for n in (0, 1, 62, 63, 64, 127, 128, (1 << 33) + 63, (7 << 33) + 64)], "no long, row string")
    for most in (1 << 20, 0):
        monkeypatch.setattr(jaccard_dedup, "MOST_WORDS", most)
        wanted = [0, 63, 64, (1 << 33) + 63]
        assert sorted(r.no for r in jaccard_dedup._only(rows, "no", spark.createDataFrame([(n,) for n in [*wanted, 63, 5]], "x long")).collect()) == wanted
        assert jaccard_dedup._only(rows, "no", spark.createDataFrame([], "x long")).count() == 0
