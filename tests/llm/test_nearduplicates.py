import random

import pytest

from shelfmark.llm import nearduplicates as nd


def corpus(seed, n=160):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        if out and rnd.random() < 0.4:
            base = list(rnd.choice(out)[1].split())
            for _ in range(rnd.randrange(0, 5)):
                base[rnd.randrange(len(base))] = rnd.choice(words)
            out.append((i, " ".join(base)))
        else:
            out.append((i, " ".join(rnd.sample(words, rnd.randrange(1, 30)))))
    return out


@pytest.mark.parametrize("seed, threshold", [(0, 0.7), (1, 0.5), (2, 0.9), (3, 1.0)])
def test_against_brute_force(spark, seed, threshold):
    docs = corpus(seed)
    sets = {i: set(nd.WORD.findall(t.lower())) for i, t in docs}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold - 1e-12}
    pairs, members = nd.similar_pairs(spark.createDataFrame(docs, "doc_id long, text string"), threshold=threshold, shingle=1)
    assert {(r["a"], r["b"]) for r in nd.expanded(pairs, members).collect()} == want


def test_shingles_and_groups(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen".split()
    docs = [(3, " ".join(base)), (1, " ".join(base)), (2, " ".join([*base, "end"])), (9, " ".join(reversed(base))), (10, "ab")]
    out = {r["key"]: (r["class"], r["group"], r["n_links"]) for r in nd.groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {1: (1, 1, 1), 3: (1, 1, 1), 2: (2, 1, 1), 9: (9, 9, 0), 10: (10, 10, 0)}


def test_edges(spark):
    long = " ".join(f"v{i}" for i in range(40_000))
    rows = [(1, None, 1, 1), (2, "", 1, 1), (3, "?!", 1, 1), (4, "same text", 1, 1), (5, "same text", 1, 1), (6, long, 1, 1), (7, long + " more", 1, 1), (None, "same text", 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, block int")  # columns named as the operator's own
    pairs, members = nd.similar_pairs(df, shingle=1)
    assert {(r["a"], r["b"]) for r in nd.expanded(pairs, members).collect()} == {(4, 5), (6, 7)}
    pairs, members = nd.similar_pairs(df.limit(0))
    assert pairs.count() == 0 and members.count() == 0 and nd.groups(df.limit(0)).count() == 0


def test_one_common_word_is_no_hot_spot(spark):
    docs = [(i, f"the of and a{i} b{i} c{i} d{i} e{i}") for i in range(400)]
    pairs, _ = nd.similar_pairs(spark.createDataFrame(docs, "doc_id long, text string"), threshold=0.7, shingle=1)
    assert pairs.count() == 0


def brute(docs, threshold):
    sets = {i: set(nd.WORD.findall(t.lower())) for i, t in docs}
    return {(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold - 1e-12}


@pytest.mark.parametrize("seed, threshold", [(4, 0.7), (5, 0.5), (6, 0.8)])
def test_parts_ranges_and_groups_at_small_bounds(spark, monkeypatch, seed, threshold):
    # sets in several parts, tokens in several ranges, lists of several groups and tasks of few pairs give the same pairs
    for name, value in (("PART", 8), ("LIST", 24), ("GROUP", 4), ("TASK_PAIRS", 50)):
        monkeypatch.setattr(nd, name, value)
    docs = corpus(seed, 240)
    pairs, members = nd.similar_pairs(spark.createDataFrame(docs, "doc_id long, text string"), threshold=threshold, shingle=1)
    assert {(r["a"], r["b"]) for r in nd.expanded(pairs, members).collect()} == brute(docs, threshold)


def test_groups_count_each_link_once(spark, monkeypatch):
    monkeypatch.setattr(nd, "TASK_PAIRS", 50)
    docs = corpus(7, 200)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    pairs, members = nd.similar_pairs(df, threshold=0.6, shingle=1)
    links = [(r["a"], r["b"]) for r in pairs.collect()]
    got = {r["key"]: r for r in nd.groups(df, threshold=0.6, shingle=1).collect()}
    assert set(got) == {r["key"] for r in members.collect()}
    for r in members.collect():
        assert got[r["key"]]["class"] == r["class"] and got[r["key"]]["n_links"] == sum(r["class"] in x for x in links)
    label = {c: c for x in links for c in x}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert all(r["group"] == label.get(r["class"], r["class"]) for r in got.values())


@pytest.mark.parametrize("words, threshold", [(2_000, 0.7), (5_000, 0.7), (5_000, 0.8)])
def test_unrelated_long_texts_of_one_vocabulary_are_told_apart(spark, words, threshold):
    rnd = random.Random(words)
    vocabulary = range(words * 4)
    docs = [(i, " ".join(f"w{w}" for w in rnd.sample(vocabulary, words))) for i in range(200)]
    docs.append((200, docs[0][1] + " " + " ".join(f"x{i}" for i in range(words // 10))))
    classes, _ = nd._classes(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", 1)
    found = {(r["a"], r["b"]) for r in nd.candidate_pairs(classes, threshold).collect()}
    assert (0, 200) in found and len(found) < 0.01 * 201 * 200 / 2


def test_a_cluster_of_nearly_equal_texts_is_many_tasks(spark, monkeypatch):
    # 2,000 texts that share 95 of 100 words: two million links, but no task of more than some of them, nor any list of them
    monkeypatch.setattr(nd, "TASK_PAIRS", 100_000)
    base = " ".join(f"b{i}" for i in range(95))
    docs = [(i, base + " " + " ".join(f"o{i}x{j}" for j in range(5))) for i in range(2_000)]
    out = nd.groups(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), shingle=1).collect()
    assert len(out) == 2_000 and {(r["group"], r["n_links"]) for r in out} == {(0, 1_999)}


@pytest.mark.parametrize("threshold", [0.5])  # at 0.7 no list of these is split
def test_lists_of_many_rows_are_split_by_further_tokens(spark, monkeypatch, threshold):
    rnd = random.Random(8)
    docs = []
    for i in range(1_500):
        words = rnd.choice(docs)[1].split() if i % 5 == 4 else [f"w{rnd.randrange(300)}" for _ in range(rnd.randrange(12, 30))]
        words[0] = f"w{rnd.randrange(300)}"
        docs.append((i, " ".join(words)))
    classes, members = nd._classes(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", 1)
    matrix = nd._matrix(classes, threshold).repartition(1, "key", "task").sortWithinPartitions("key", "task").toArrow()
    looked = []
    near = nd._List.near
    monkeypatch.setattr(nd._List, "near", lambda self, i, j: looked.append(len(i)) or near(self, i, j))
    work = []
    for most in (1 << 40, 16):
        monkeypatch.setattr(nd, "LONG", most)
        looked.clear()
        found = [frozenset(x) for batch in nd._candidates(matrix, threshold) for x in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)]
        least = {r["key"] for r in members.where("key = class").collect()}
        assert {frozenset(x) for x in brute(docs, threshold) if least.issuperset(x)} <= set(found)
        work.append(sum(looked))
    assert work[1] < work[0]  # lists were split
