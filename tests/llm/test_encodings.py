import random
import re

import pytest

from shelfmark.llm import encodings as e

WORDS = {
    "fr": "l’équipe a déplacé le procès-verbal où été près château garçon fête naïveté à l’été “privé” cœur".split(),
    "de": "die Größe für Übung später schön Brücke heißt Straße zurück große „Ordner“ – über möchte".split(),
    "es": "año pequeño mañana costó ¿qué cambió montaña ¡qué último próximo después reunión".split(),
    "ru": "Каждый протокол стоит около монет несмотря на жалобы завтра принесёт другой справочник вместо списка чертёж".split(),
    "ko": "연락이 온 뒤 우리는 보고서 때문에 중복된 대차대조표를 다시 검토했다 다음 달까지 초안을 끝내고 준비해야 한다 회의에서 통계표 비교했다".split(),
    "en": "the café’s naïve résumé isn’t “quarterly” – prices rose to €5 and won’t fall".split(),
}


def sentence(rnd, lang, n=14):
    return " ".join(rnd.choice(WORDS[lang]) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def model():
    rnd = random.Random(1)
    return e.Model([sentence(rnd, lang) for lang in WORDS for _ in range(120)])


@pytest.mark.parametrize("pair", e.PAIRS, ids=str)
def test_round_trip(pair):
    rnd = random.Random(2)
    done = 0
    for lang in WORDS:
        text = sentence(rnd, lang)
        bad = e.garble(text, pair)
        if bad is None or bad == text or e.LOST in bad:
            continue
        out, whole = e.restore(bad, pair)
        assert whole and out == text
        done += 1
    assert done or pair[1] in ("utf-8", "cp949")


def test_held_out_accuracy(model):
    rnd = random.Random(3)
    usual = {"fr": ("utf-8", "cp1252"), "de": ("utf-8", "mac_roman"), "es": ("utf-8", "latin-1"), "ru": ("utf-8", "cp1251"), "ko": ("utf-8", "cp1252"), "en": ("cp1252", "utf-8")}
    ko = [("utf-8", "latin-1"), ("utf-8", "cp949"), ("cp949", "cp1252"), ("cp949", "utf-8"), ("utf-8 twice", "cp1252"), ("utf-8", "mac_roman")]
    hits = total = restored = whole = clean = 0
    for lang in WORDS:
        for i in range(40):
            text, rest = sentence(rnd, lang), sentence(rnd, lang)
            clean += bool(model.spans(text))
            pair = ko[i % len(ko)] if lang == "ko" else usual[lang]
            bad = e.garble(text, pair)
            if bad is None or bad == text:
                continue
            spans = model.spans(f"{rest} {bad}" if i % 2 else bad)
            total += 1
            hits += bool(spans)
            if e.LOST not in bad:
                whole += 1
                restored += model.repaired(bad, model.spans(bad))[0] == text
    assert hits >= 0.97 * total and clean <= 2 and restored >= 0.9 * whole


def test_cut_off_or_cleaned(model):
    for text, pair in (("Приложение Отчёт заключение", ("utf-8", "cp1252")), ("회의록 검토 보고서", ("utf-8", "latin-1")), ("회의록 검토 보고서", ("utf-8", "cp1252"))):
        bad = e.garble(text, pair)
        for cut in (bad[:-1], bad[1:], re.sub("[\x80-\xa0]", " ", bad, count=1)):
            assert model.spans(cut), (cut, pair)


def test_odd_but_sound(model):
    for text in ("résumé", "Ｓｕmaror", "Sоlortov", "so​ft­hyphen", "", "plain", "«  périmé  »", "УЖЕ ПЕРЕВЕДЁН", "ÉTÉ"):
        assert not model.spans(text), text


def test_rows(spark, model):
    bad = e.garble("Größe für Übung später", ("utf-8", "cp1252"))
    rows = [(1, None, "x"), (2, "", "x"), (3, bad, "x"), (3, bad, "x"), (4, "fine " * 60_000 + bad, "x"), (5, "schön", "x")]
    df = spark.createDataFrame(rows, "file_id long, t string, garbled string")
    got = e.garbled(df, "file_id", "t", model).collect()
    assert sorted(r["key"] for r in got) == [3, 3, 4]
    assert {r["restored"][-22:] for r in got} == {"Größe für Übung später"} and all(r["complete"] for r in got)
    assert e.garbled(df.limit(0), "file_id", "t", model).count() == 0
    assert e.fit([df.select("t").limit(0)]).spans(bad) == []  # nothing to learn from: nothing is known


#: Sound texts with letters and signs that the sample of the corpus hardly has.
SOUND = [
    'L’été à Noël, cœur d’œuvre où l’île naît ; Æsop, maïs, aiguë, capharnaüm',
    'Größe: 5 µm ± 2 °C × 3 ÷ 4 = ½ · ¼ ¾ – „Übermaß“ §12 ¶3',
    '½ кг муки, ¼ л воды, 3 × 4 см, № 7 «Ёлка» — съёмка, подъезд',
    'Příliš žluťoučký kůň úpěl ďábelské ódy, šťastný rok 2024',
    'Zażółć gęślą jaźń – źdźbło, łódź, ćma, Łukasz Żak',
    '東京都は日本の首都です。ひらがなとカタカナも書きます。',
    '北京是中华人民共和国的首都，位于华北平原。上海很大。',
    'El pingüino Ñandú comió piñas en Ávila: ¿qué más? ¡Óle! 3.ª planta, n.º 5',
    'Smørrebrød på Ærø, blåbærsyltetøy og fløte; Århus, Öresund, Åland, þorn, ðe',
    'Árvíztűrő tükörfúrógép, İstanbul ışığı, ağaç, şöförü, çiğ köfte',
    'Ελληνικά κείμενα με τόνους: Αθήνα, Θεσσαλονίκη και Ρόδος',
    '한글 문서 × 2부, 온도 25 ℃, 면적 30 ㎡, 가격 ₩5,000 → 약 10 %',
    'naïve café — “résumé” … £5 €7 ¥9 © 2020 ® ™ † ‡ ¤ ¬ ¯ ¸ ª º',
    'Tiếng Việt có dấu: Đường phố Hà Nội, người dân, nước mắm',
    'Привет, ï и ö рядом; Œuvre, Škoda, Žižkov, Dvořák, Łódź в тексте',
    'ça, là, où, déjà; N°5, À côté, Ô temps, Éric, Ève, Ça va, Ü',
]


@pytest.fixture(scope="module")
def corpus_model(spark):
    from shelfmark.llm.encoding_queries import FIELDS

    return e.fit([spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet").select(field) for name, _, field in FIELDS])


@pytest.mark.parametrize("text", SOUND)
def test_sound_texts_stay(model, corpus_model, text):
    for m in (model, corpus_model):
        for part in (text, *text.split()):
            assert m.spans(part) == []


def test_restored_texts_equal_sound_copies(spark):
    """The cache has sound copies of texts that are garbled in files."""
    from pyspark.sql import functions as F

    from shelfmark.llm.encoding_queries import p3_restored

    d = "/root/testdata/sf0.1"
    rows = p3_restored(spark, d).cache()
    cached = spark.read.parquet(f"{d}/parser_cache.parquet").where("excerpt != ''")
    garbled = rows.where("tbl = 'parser_cache'").select(F.col("row_id").alias("cache_id"))
    sound = cached.join(garbled, "cache_id", "left_anti").groupBy("path").agg(F.min("excerpt").alias("sound"), F.countDistinct("excerpt").alias("n")).where("n = 1")
    files = spark.read.parquet(f"{d}/files.parquet").select(F.col("file_id").alias("row_id"), F.col("original_path").alias("path"))
    pairs = rows.where("field = 'content_excerpt' AND complete").join(files, "row_id").join(sound, "path").select((F.col("restored") == F.col("sound")).alias("same"))
    n, same = pairs.agg(F.count("*"), F.count(F.when(F.col("same"), 1))).first()
    assert n > 100 and same / n >= 0.95


def test_model_is_learnt_from_all_texts(spark):
    texts = [(f"Größe {chr(0xAC00 + 3 * i)}{chr(0xAC00 + i)} {i}",) for i in range(3_000)]
    model = e.fit([spark.createDataFrame(texts, "t string").repartition(3)])
    assert model.known.issuperset(c for (t,) in texts for c in t)


def test_counts_equal_those_of_texts_garbled_as_a_whole():
    rnd = random.Random(5)
    texts = [sentence(rnd, lang) for lang in WORDS for _ in range(30)]
    got = e.learnt(texts)
    clean = [t for t in texts if e.presumed_clean(t)]
    for state, pair in enumerate(e.PAIRS):
        runs = [run for t in clean for run in e.RUN.findall(e.garble(t, pair) or "")]
        want = e.Counter(x for run in runs for x in zip(["", *run], [*run, ""]))
        assert {(a, b): n for (k, a, b), n in got.items() if k == state} == want, pair


def test_each_part_is_garbled_once(monkeypatch):
    rnd = random.Random(6)
    texts = [sentence(rnd, lang) for lang in WORDS for _ in range(100)]
    made, garble = [], e.garble
    monkeypatch.setattr(e, "garble", lambda text, pair: made.append((text, pair)) or garble(text, pair))
    e.learnt(texts)
    assert 0 < len(made) == len(set(made)) <= len(e.PAIRS) * sum(map(len, WORDS.values()))


def test_counts_in_spark_equal_those_of_all_texts(spark):
    rnd = random.Random(7)
    texts = [sentence(rnd, lang) for lang in WORDS for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in [*texts, "ascii", "", *texts]], "t string").repartition(4)
    got, n = e._learnt_of(df)
    want = e.learnt(dict.fromkeys(texts))
    assert n == len(set(texts)) + 1 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_paths_only_where_they_may_leave_clean_text(model, monkeypatch):
    rnd = random.Random(8)
    sound = [sentence(rnd, lang) for lang in WORDS for _ in range(20)]
    bad = [b for i, t in enumerate(sound) if (b := e.garble(t, e.PAIRS[i % len(e.PAIRS)])) and b != t]
    long = " ".join(sound) * 12
    assert sum(not c.isascii() for c in long) > 3 * e.HELD_STEPS
    texts = [*sound, *bad, *(f"{rnd.choice(sound)} {b} {rnd.choice(sound)}" for b in bad), *(b[i : i + 3] for b in bad for i in range(0, 12, 3)), long, long + bad[0], bad[0] + long, long + bad[1] + long]
    with_path = [model._path(t) if not t.isascii() else [] for t in texts]
    asked, path = [], e.Model._path
    monkeypatch.setattr(e.Model, "_path", lambda self, text: asked.append(text) or path(self, text))
    assert [model.spans(t) for t in texts] == with_path and all(with_path[-3:])
    asked.clear()
    assert not any(model.spans(t) for t in [*sound, long]) and len(asked) <= 2
