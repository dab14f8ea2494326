import random

import pytest

from shelfmark.llm import leakage as lk

ITEM = "The orchard of Etvelo sank after 841 nights, yet its floating glacier of Ranso never hummed 12 times near the gate."


def run(spark, docs, items):
    d = spark.createDataFrame([(*x, 1, "clash") for x in docs], "doc_id long, text string, key int, words string")
    i = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, slots string")
    m = lk.template_matches(d, i)
    return {(r[0], r[1]) for r in lk.verbatim(m).collect()}, {(r["doc_id"], r["item_id"]): r["kind"] for r in lk.leaks(m).collect()}


def test_kinds(spark):
    filler = "Nothing of note was written here by anyone on that day, and so the page stayed empty. "
    other = ITEM.replace("841 nights", "17 days").replace("Etvelo", "Morkad").replace("Ranso", "Tivol").replace("12", "9")
    docs = [(1, filler + ITEM + filler), (2, filler + ITEM.upper()), (3, filler + other), (4, filler), (5, " ".join(ITEM.split()[:9])), (6, None), (7, ""), (8, filler * 3_000 + ITEM), (8, ITEM), (None, ITEM)]
    found, kinds = run(spark, docs, [(1, ITEM), (2, None), (3, "too short"), (4, ITEM)])
    assert found == {(d, i) for d in (1, 2, 8, None) for i in (1, 4)}
    assert kinds[3, 1] == "reparameterised" and kinds[1, 1] == "verbatim"


def test_inconsistent_slots(spark):
    item = "Then Morkad gave Etvelo 5 coins and Morkad took 5 more coins from the old wooden chest."
    doc = "Then Tivol gave Ranso 7 coins and Kimra took 9 more coins from the old wooden chest."
    _, kinds = run(spark, [(1, doc)], [(1, item)])
    assert kinds == {(1, 1): "template"}


@pytest.mark.parametrize("before", ["some", "14", "9", ""])
def test_passage_that_begins_with_a_unit(spark, before):
    ten = "days w2 w3 w4 w5 w6 w7 w8 w9 w10"
    item = f"alpha beta 14 {ten} gamma"
    found, kinds = run(spark, [(1, f"{before} {ten} omega"), (2, f"{before} {ten.replace('days', 'roads')} omega")], [(1, item)])
    assert found == {(1, 1)} and kinds[1, 1] == "verbatim"
    assert run(spark, [(1, item)], [(1, f"{before} {ten} omega")])[0] == {(1, 1)}


def test_empty(spark):
    assert run(spark, [], [(1, ITEM)]) == (set(), {}) and run(spark, [(1, ITEM)], []) == (set(), {})


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["7", "Name", "12", "Ort"]
    items = [(i, " ".join(rnd.choices(words, k=rnd.randrange(8, 25)))) for i in range(12)]
    docs = []
    for d in range(60):
        body = rnd.choices(words, k=30)
        if rnd.random() < 0.6:
            src = rnd.choice(items)[1].split()
            a = rnd.randrange(len(src))
            body[10:10] = src[a : a + rnd.randrange(5, 16)]
        docs.append((d, " ".join(body)))
    grams = lambda t: {tuple(w[i : i + 10]) for w in [lk.WORD.findall(t.lower())] for i in range(len(w) - 9)}
    want = {(d, i) for d, t in docs for i, u in items if grams(t) & grams(u)}
    assert run(spark, docs, items)[0] == want


UNIT_SWAP = {"grams": "kilos", "nights": "weeks", "days": "hours", "Nächten": "Tagen", "grammes": "kilos", "nuits": "jours", "noches": "semanas", "gramos": "kilos"}


def reparameterised(text, rnd, names, consistent=True):
    """The text with other numbers, names and units; inconsistently: each use of a value gets another."""
    to = {}

    def new(old, make):
        if not consistent:
            return make()
        return to.setdefault(old, make())

    def one(m):
        w = m.group()
        if w.isdigit():
            return new(w, lambda: str(rnd.randrange(1_000, 99_999)))
        if w in names:
            return new(w, lambda: "".join(rnd.choice("BDFGKLMNPRSTV") for _ in range(1)) + "".join(rnd.choice(["ako", "uri", "ente", "isol", "umba"]) for _ in range(3)))
        return UNIT_SWAP.get(w, w)

    return lk.re.sub(r"[A-Za-zÀ-ÿ]+|[0-9]+", one, text)


def test_reparameterised_items_are_found(spark):
    """Sentences of the items with other numbers, names and units, each hidden in a document; and with a value that is used twice exchanged for two."""
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    uses = {}
    for t in texts:
        for w in set(lk.re.findall(r"[A-Za-zÀ-ÿ]+", t)):
            uses[w] = uses.get(w, 0) + 1
    names = {w for w, n in uses.items() if n == 1 and w[0].isupper() and w[1:].islower() and uses.get(w.lower(), 0) == 0}
    sentences = sorted({x for t in texts for x in lk.re.split(r"(?<=[.?]) ", t) if len(lk.WORD.findall(x)) >= 12 and names & set(lk.re.findall(r"[A-Za-zÀ-ÿ]+", x))})
    rnd = random.Random(3)
    filler = " Nothing else was said on that day and nobody wrote a word of it down. "
    items = list(enumerate(sentences))
    docs = [(i, filler + reparameterised(t, rnd, names) + filler) for i, t in items]
    # one value twice, near enough for one window
    twice = "In the year the {0} of Orvane and the {0} of Tillmar were sold for {1} coins and {1} pearls each."
    items += [(10_000 + i, twice.format(f"Kestrel{'abcdefgh'[i]}", 100 + i)) for i in range(8)]
    docs += [(10_000 + i, filler + "In the year the Bram of Orvane and the Cole of Tillmar were sold for 7 coins and 9 pearls each." + filler) for i in range(8)]
    _, kinds = run(spark, docs, items)
    whole = lambda i: any(len(set(lk.WORD.findall(x))) >= 10 for x in lk.re.split("|".join([r"[0-9]+", *sorted(names & set(lk.re.findall(r"[A-Za-zÀ-ÿ]+", items[i][1])))]), items[i][1]))
    planted = {(i, i) for i in range(len(sentences)) if not whole(i)}
    said = {p for p, kind in kinds.items() if kind == "reparameterised" and p[0] < 10_000}
    recall, precision = len(said & planted) / len(planted), len(said & {(i, i) for i in range(len(sentences))}) / len(said)
    print(f"recall {recall:.3f} precision {precision:.3f} of {len(planted)}")
    assert recall >= 0.9 and precision >= 0.9
    assert all(kinds.get((10_000 + i, 10_000 + j), "template") == "template" for i in range(8) for j in range(8))


def test_a_family_of_items_and_names_that_many_items_share(spark):
    text = "The Korvan of team {} sold {} boxes to Delmo and kept the other {} for the market near the river."
    items = [(i, text.format(i + 3, i + 20, i + 50)) for i in range(40)]
    doc = text.format(7, 900, 811).replace("Korvan", "Hestor").replace("Delmo", "Brinsa")
    _, kinds = run(spark, [(1, doc)], items)
    assert len(kinds) == 40 and set(kinds.values()) <= {"reparameterised", "template"} and "reparameterised" in kinds.values()


def test_rows_of_numbers_are_no_template(spark):
    item = "Prices: " + " ".join(str(100 + i) for i in range(12)) + " and that is all there was to say about it today."
    doc = "Costs " + " ".join(str(900 + i) for i in range(12)) + " thank you."
    found, kinds = run(spark, [(1, doc), (2, "x " + item)], [(1, item)])
    assert found == {(2, 1)} and (1, 1) not in kinds


def test_results_do_not_depend_on_how_items_are_partitioned(spark):
    items = spark.createDataFrame([(i, f"The Korvan of team {i} sold {i + 20} boxes to Delmo and kept the rest for the market.") for i in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "The Hestor of team 9 sold 999 boxes to Brinsa and kept the rest for the market.")], "doc_id long, text string")
    one, many = (sorted(map(tuple, lk.leaks(lk.template_matches(docs, items.repartition(n))).collect())) for n in (1, 20))
    assert one == many and one
