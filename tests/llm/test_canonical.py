import unicodedata as ud

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import canonical as c

ODD = "aééㅎ각ᆨ가​­ 　Ａｂ１ﬁﬂΟοаеСРt\t /_-.²½№가ㅏ⁠﻿\U0001f642‍Е"


def whole(value):
    """Every character folded and the whole text composed."""
    out = c._HYPHENS.sub("-", ud.normalize("NFC", c.folded(value)))
    return c.WORD.sub(lambda m: c.one_script(m.group()), out)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet=ODD, max_size=40)))
def test_splicing_equals_normalising_the_whole(value):
    assert c.canonical(value) == whole(value)
    assert c.canonical(c.canonical(value)) == c.canonical(value)


@pytest.mark.parametrize(
    "value, form",
    [
        ("résumé", "résumé"), ("Ｓｕmaror ｖ２", "Sumaror v2"), ("Mor​eldal", "Moreldal"), ("a b　c", "a b c"), ("ﬁle", "file"), ("한글", "한글"),
        ("Sоlortov", "Solortov"), ("набрoсoк", "набросок"), ("Übеrblісk", "Überblick"), ("Relophgo의", "Relophgo의"), ("билет Sulosu", "билет Sulosu"),
        ("x² № ½ 〈2024〉·", "x² № ½ 〈2024〉·"), ("", ""), ("e​́", "é"), ("AЕ́", "AÉ"),
        ("𝐑𝐞𝐩𝐨𝐫𝐭", "Report"), ("re‑port, re‐port, re−port", "re-port, re-port, re-port"), ("5 − 3", "5 − 3"), ("नि‍क", "नि‍क"), ("👨‍👩‍👧", "👨‍👩‍👧"), ("می‌خواهم", "می‌خواهم"), ("a∕b", "a∕b"),
    ],
)
def test_forms(value, form):
    assert c.canonical(value) == form and c.is_canonical(value) == (value == form)


def test_rows(spark):
    rows = [(1, "ok", None, 5), (1, "ok", None, 5), (2, "Ａ", "", 5), (None, "a" * 300_000 + "e\u0301", "x\u00a0y", 5)]
    df = spark.createDataFrame(rows, "file_id long, filename string, folder string, field int")  # a column named as one of the result's
    got = c.forms(df, "file_id", ["filename", "folder"]).collect()
    assert len(got) == 8 and {(r["key"], r["field"]) for r in got if not r["was_canonical"]} == {(2, "filename"), (None, "filename"), (None, "folder")}
    assert all(r["canonical"] is None for r in got if r["value"] is None)
    found = c.forms(df, "file_id", ["filename", "folder"], changed_only=True).collect()
    assert {(r["key"], r["field"]) for r in found} == {(2, "filename"), (None, "filename"), (None, "folder")}
    skipped = c.forms(df, "file_id", ["filename"], {"filename": lambda: lambda v: v == "Ａ"}, True).collect()
    assert {r["key"] for r in skipped} == {None}
    assert c.forms(df.limit(0), "file_id", ["filename"]).count() == 0


@pytest.mark.parametrize("value, form", [("Ꭱeport", "Report"), ("օffice", "office"), ("ꓑaper", "Paper"), ("ԁata", "data"), ("ᏒЕport", "REport"), ("Հայաստան", "Հայաստան"), ("ᎠᏂ", "ᎠᏂ")])
def test_look_alikes_of_other_alphabets(spark, value, form):
    c.learn_looks(c.looks(spark))
    assert c.canonical(value) == form and c.is_canonical(form)


@pytest.mark.parametrize("value, words", [("сору of report", ["сору"]), ("report РАСА 2", ["РАСА"]), ("сору", []), ("копия сору", []), ("report отчёт сору", []), ("plain", [])])
def test_words_wholly_in_look_alikes_are_told(value, words):
    assert c.spoofed(value) == words and c.canonical(value) == value


def test_model_of_filenames_is_learnt_from_all_of_them(spark, tmp_path, monkeypatch):
    from shelfmark.llm import canonical_queries as q

    names = [(i, f"Größe {chr(0xAC00 + 3 * i)}{chr(0xAC00 + i)} {i}", "a", "b") for i in range(3_000)]
    spark.createDataFrame(names, "file_id long, filename string, original_path string, folder string").repartition(3).write.parquet(f"{tmp_path}/files.parquet")
    models, fit = [], q.e.fit
    monkeypatch.setattr(q.e, "fit", lambda texts: models.append(fit(texts)) or models[-1])
    assert q.p2_found(spark, str(tmp_path)).count() == 0
    assert models[0].known.issuperset(c for n in names for c in n[1])
