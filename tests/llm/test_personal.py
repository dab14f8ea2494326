import pytest

from shelfmark.llm import personal as p

NAMES = p.Names.of([("Edwin", "given"), ("Götz", "given"), ("Tarrowby", "family"), ("Niederloh", "family"), ("Stavely-Orme", "family"), ("온유", "given"), ("보라", "given"), ("남궁", "family"), ("김", "family"), ("Фёдор", "given"), ("Заречнов", "family"), (None, "given"), ("x", None)])


@pytest.mark.parametrize(
    "text, out",
    [
        ("Write to a.b@example.net now", "Write to [EMAIL] now"),
        ("write to a.b [at] mail [dot] example [dot] net now", "write to [EMAIL] now"),
        ("ask rufus (at) example.com, please", "ask [EMAIL], please"),
        ("ask rufus at example dot com please", "ask [EMAIL] please"),
        ("Пишите ivan собака mail точка ru сегодня", "Пишите [EMAIL] сегодня"),
        ("ivan (собака) mail [точка] ru", "[EMAIL]"),
        ("문의 kim(골뱅이)mail(점)com", "문의 [EMAIL]"),
        ("voir luc [chez] mail [point] fr demain", "voir [EMAIL] demain"),
        ("ask kim@mail[.]com please", "ask [EMAIL] please"),
        ("ask kim@mail(.)com please", "ask [EMAIL] please"),
        ("ａ．ｂ＠ｅｘａｍｐｌｅ．ｎｅｔ!", "[EMAIL]!"),
        ("mail еdwin@example.net", "mail [EMAIL]"),
        ("Reach Edwin Tarrowby on +1 617 555 0102 after lunch", "Reach [NAME] on [PHONE] after lunch"),
        ("call 303-555-0140", "call [PHONE]"),
        ("tel. 07700 900403", "tel. [PHONE]"),
        ("call zero seven seven zero zero nine zero zero four zero three soon", "call [PHONE] soon"),
        ("공일공 영공구육 일삼사사", "[PHONE]"),
        ("Signed by TARROWBY, Edwin B.", "Signed by [NAME] B."),
        ("Edwin R. Stavely-Orme", "[NAME]"),
        ("담당자 남궁온유 과장에게", "담당자 [NAME] 과장에게"),
        ("김 보라 님이", "[NAME] 님이"),
        ("681개 남궁온유 님이 어제 남궁 보라 선생님과", "681개 [NAME] 님이 어제 [NAME] 선생님과"),
        ("하늘 보라 가을 색상표", "하늘 보라 가을 색상표"),
        ("주민번호 940704-2760012 확인", "주민번호 [ID_NUMBER] 확인"),
        ("SSN 967-32-9880 was", "SSN [ID_NUMBER] was"),
        ("DNI 31885084-R de", "DNI [ID_NUMBER] de"),
        ("Ausweisnummer LJ88M8503 wurde", "Ausweisnummer [ID_NUMBER] wurde"),
        ("N° 1 51 03 99 606 435 00 Au", "N° [ID_NUMBER] Au"),
        ("Звонить Фёдор ЗАРЕЧНОВ: 8-000-555-24-96", "Звонить [NAME]: [PHONE]"),
        ("80 Drariskyr Street, Flat 9A is", "[ADDRESS] is"),
        ("an Birkenhainstraße 77, 00091 Solstadt.", "an [ADDRESS]."),
        ("au 165, rue des Tilleroses, 00252 Limrisfa.", "au [ADDRESS]."),
        ("Domicilio: Plaza Zenprilan nº 34, tel.", "Domicilio: [ADDRESS], tel."),
        ("Адрес: ул. Речная, д. 146, кв. 57", "Адрес: [ADDRESS]"),
        ("주소 가람시 여울구 물안개길 110번길 11 / 전화", "주소 [ADDRESS] / 전화"),
        ("Ratio 3:276, part 00848-315, size 718 x 248 mm.", "Ratio 3:276, part 00848-315, size 718 x 248 mm."),
        ("Artikel 600-436-660 bleibt, Version 457.245.25, ref 2024-415-536", "Artikel 600-436-660 bleibt, Version 457.245.25, ref 2024-415-536"),
        ("Tag @Junpelno and use #21. The rose bed in April.", "Tag @Junpelno and use #21. The rose bed in April."),
        ("calle cortada por obras; Road works near the Lane project", "calle cortada por obras; Road works near the Lane project"),
        ("edwin.tarrowby@example.net", "[EMAIL]"),
        ("budget_Edwin_Tarrowby.docx", "budget_[NAME].docx"),
        ("call six one seven five five five zero one zero two now", "call [PHONE] now"),
        ("Dial sechs eins sieben fünf fünf fünf null eins null zwei bitte", "Dial [PHONE] bitte"),
        ("phone 6175550102 today", "phone [PHONE] today"),
        ("tel 555.0102, 전화 0212345678", "tel [PHONE], 전화 [PHONE]"),
        ("order 6175550102 and one two three", "order 6175550102 and one two three"),
        ("Jean-Edwin Tarrowby came", "[NAME] came"),
        ("", ""),
    ],
)
def test_redaction(text, out):
    assert p.redacted(text, p.find(text, NAMES)) == out


def test_offsets_map_back():
    text = "x​ｂ　tel ０７７００ ９００４０３ end"
    spans = p.find(text, NAMES)
    assert [text[a:b] for a, b, _ in spans] == ["０７７００ ９００４０３"]


def table(spark, names):
    return spark.createDataFrame(names.rows(), "kind string, word string")


def learnt(spark, texts, names=NAMES):
    return {tuple(r) for r in p.completed(texts, table(spark, names)).collect()} - set(names.rows())


def test_candidates_beside_cues():
    text = "Звонить Милица Полынин: 8. Applicant: Stavely-Orme, Fergus / Mieter: Falko Niederloh, Birkenweg 7"
    seen = p.candidates(text, NAMES, {"звонить", "applicant:", "mieter:"})
    assert seen["given", "милица", "полынин"] == 1 and seen["family", "полынин", ""] == 1 and seen["given", "fergus", "stavely-orme"] >= 1
    assert ("given", "birkenweg", "niederloh") not in seen
    assert not any("милица" in k for k in p.candidates(text, NAMES))


def test_cues_are_learnt(spark):
    # 'Vexed' announces names that are known, and so tells those that aren't; 'Blue' stands before anything
    texts = [(f"Vexed Edwin Tarrowby {i}",) for i in range(8)] + [(f"Blue House Garden {i}; blue Edwin Tarrowby",) for i in range(8)] + [("Vexed Mirabel Quorne",), ("So vexed Mirabel Quorne was",), ("Blue Lemon Tree",), ("Blue Lemon Tree again",)]
    got = learnt(spark, spark.createDataFrame(texts, "t string"))
    assert {("given", "mirabel"), ("family", "quorne")} <= got and not any(w in ("lemon", "tree", "house", "garden") for _, w in got)


def test_what_only_passes_a_filter_is_no_name(spark, monkeypatch):
    # a filter of so few bits lets every word pass
    monkeypatch.setattr(p, "_filter", lambda words: p.Filter(p.LEAST_BITS, {i: p.pa.compress(b"\xff" * (1 << 16), "zstd", asbytes=True) for i in range(2)}))
    df = spark.createDataFrame([(1, "Edwin Tarrowby met Blue Garden and Kind Regards at 10"), (2, "Kind Regards")], "file_id long, t string")
    got = {r["key"]: r["redacted"] for r in p.personal(df, "file_id", ["t"], NAMES, learn=False).collect()}
    assert got == {1: "[NAME] met Blue Garden and Kind Regards at 10", 2: "Kind Regards"}


def test_more_names_than_fit_a_worker(spark):
    # 600,000 names: tables and filters, no set of them
    many = spark.range(300_000).selectExpr("concat('gx', id) AS token", "'given' AS name_part").unionByName(spark.range(300_000).selectExpr("concat('fx', id) AS token", "'family' AS name_part"))
    names = many.selectExpr("translate(initcap(token), '0123456789', 'abcdefghij') AS token", "name_part")
    df = spark.createDataFrame([(1, "Then Gxcde Fxjjj wrote, and Gxcde Other did not.")], "file_id long, t string")
    assert p.personal(df, "file_id", ["t"], names, learn=False).first()["redacted"] == "Then [NAME] wrote, and Gxcde Other did not."


def test_learning_goes_on_to_the_end(spark):
    chain = ["Edwin Aarbon", "Berwin Aarbon", "Berwin Carbon", "Derwin Carbon", "Derwin Earbon", "Ferwin Earbon", "Ferwin Garbon"]
    texts = spark.createDataFrame([(f"{n} came.",) for i, n in enumerate(chain) for _ in range(128 >> i)], "t string")
    assert learnt(spark, texts) == {("given", w) for w in ("berwin", "derwin", "ferwin")} | {("family", w) for w in ("aarbon", "carbon", "earbon", "garbon")}


def test_rows_and_learning(spark):
    rows = [(1, "Edwin Fontorge came.", "a"), (2, "Götz Fontorge saw. Tarrowby", "a"), (3, "Silas Fontorge and Silas Tarrowby and Silas Niederloh", "a"), (4, None, "a"), (5, "", "a"), (5, "", "a"), (6, "x " * 150_000 + "Silas Fontorge", "a"), (None, "a@b.example", "a")]
    df = spark.createDataFrame(rows, "file_id long, t string, kinds string")
    got = {r["key"]: r for r in p.personal(df, "file_id", ["t"], NAMES).collect()}
    assert got[1]["redacted"] == "[NAME] came." and got[4]["redacted"] is None and got[5]["redacted"] == "" and got[6]["redacted"].endswith("[NAME]")
    assert got[3]["redacted"] == "[NAME] and [NAME] and [NAME]" and got[None]["kinds"] == ["email"] and got[2]["kinds"] == ["name"]
    assert p.personal(df, "file_id", ["t"], NAMES).count() == 8 and p.personal(df, "file_id", ["t"], NAMES, found_only=True).count() == 5
    assert p.personal(df.limit(0), "file_id", ["t"], p.Names()).count() == 0
    assert {r["kinds"][0] for r in p.personal(df, "file_id", ["t"], p.Names(), learn=False, found_only=True).collect()} == {"email"}
