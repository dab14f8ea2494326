import numpy as np

from shelfmark.llm import quality as q

PROSE = "The office sent a late note and we have read it twice. It was not clear who had moved the list to the other room. "


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, lang string, n_words int, text_type string")


def test_types(spark):
    rows = [(i, PROSE * (1 + i % 4) + f"Then week {i} came.", "en") for i in range(200)]
    rows += [(1_000 + i, "\n".join(f"- item{i}x{j} thing{j}" for j in range(20)), "en") for i in range(40)]
    rows += [(2_000 + i, "\n".join(f"row{j} | {j * 7}.20 | 2024-01-{j:02}" for j in range(10, 28)), "en") for i in range(30)]
    rows += [(3_000, "depot " * 200, "en"), (3_001, PROSE.replace(". ", ".\n").replace(" and", "\nand"), None), (3_002, PROSE.rstrip(" ."), "und")]
    out = {r["doc_id"]: r for r in q.text_types(docs(spark, rows)).collect()}
    assert all(out[i]["p_prose"] > 0.5 for i in [*range(200), 3_001, 3_002])
    assert all(out[i]["p_prose"] < 0.5 for i in [*range(1_000, 1_040), *range(2_000, 2_030), 3_000])
    assert out[1_000]["text_type"] == "list" and out[2_000]["text_type"] == "table"
    assert all(abs(sum(r[f"p_{t}"] for t in q.TYPES) - 1) < 1e-9 for r in out.values())


def test_edges(spark):
    rows = [(1, None, None), (2, "", "en"), (3, "   \n\n", "en"), (4, "?!?", "en"), (5, PROSE * 3_000, "en"), (5, PROSE * 3_000, "en"), (None, PROSE, "en")]
    out = q.text_types(docs(spark, rows)).collect()
    assert len(out) == 7 and all(r["text_type"] == "junk" and r["mean_word_length"] == 0 for r in out if r["doc_id"] in (1, 2, 3, 4))
    assert q.text_types(docs(spark, rows).limit(0)).count() == 0


def test_statistics():
    got = dict(zip([x.split()[0] for x in q.STATS.split(", ")], q.statistics_of("One two three.\n\n- a b: 12", q.Common(frozenset({"one", "two"}), frozenset())), strict=True))
    assert got["n_words"] == 6 and got["line_stop_share"] == 0.5 and abs(got["common_share"] - 2 / 6) < 1e-12 and got["marker_share"] == 0.5
    assert abs(got["mean_word_length"] - 15 / 6) < 1e-12 and abs(got["symbol_share"] - 3 / 18) < 1e-12


def test_learns_accuracies():
    rnd = np.random.default_rng(2)
    names = list(q.labelling_functions().values())
    true = rnd.random(4_000) < 0.8
    votes = np.empty((4_000, len(names)), int)
    for j, answers in enumerate(names):
        right = rnd.random(4_000) < (0.6 if j == 3 else 0.9)
        yes = next((i for i, (_, t) in enumerate(answers) if "prose" in t), len(answers))
        no = next((i for i, (_, t) in enumerate(answers) if "prose" not in t), len(answers))
        votes[:, j] = np.where(true == right, yes, no)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, given = q.learn(patterns, counts.astype(float))
    assert abs(prior[0] - 0.8) < 0.05
    assert np.mean((q.posterior(votes, prior, given)[:, 0] > 0.5) == true) > 0.97


def test_prose_of_a_language_with_few_documents(spark):
    # whether 500, 20 or 3 documents share its language, prose is prose
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    whole = {r["doc_id"]: r["p_prose"] >= 0.5 for r in q.text_types(df).select("doc_id", "p_prose").collect()}
    for lang, n in (("es", 19), ("es", 3), ("ru", 5)):
        few = df.where(f"lang = '{lang}'").orderBy("doc_id").limit(n)
        part = q.text_types(df.where(f"lang IS DISTINCT FROM '{lang}'").unionByName(few))
        got = {r["doc_id"]: r["p_prose"] >= 0.5 for r in part.select("doc_id", "p_prose").collect()}
        ids = [r["doc_id"] for r in few.collect()]
        flips = [i for i in ids if got[i] != whole[i]]
        assert not [i for i in flips if whole[i]], (lang, n, flips)
