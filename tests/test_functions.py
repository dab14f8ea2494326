import datetime as dt
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark import schema as s
from shelfmark.functions import budget, dates, similarity, text
from shelfmark.plans.assign import recovered_json


def value(spark, column, **given_):
    names = ", ".join(f"{k} string" for k in given_) or "x string"
    return spark.createDataFrame([tuple(given_.values()) or ("",)], names).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "name, core",
    [("1. plan_v2", "plan"), ("(3) 보고서_최종 (1)", "보고서"), ("메모_초안_v1.2", "메모"), ("note_20240102", "note"), ("김철수abcdef2031_197578_10350428_발표", "발표"), ("", "")],
)
def test_strip_core(spark, name, core):
    assert value(spark, text.strip_core(F.col("n")), n=name) == core


@pytest.mark.parametrize("name, schema", [("한글abc12", "KAN"), ("a_b-1 (2)", "ASASNSNS"), ("★!", "P"), ("", "")])
def test_schema(spark, name, schema):
    assert value(spark, text.schema_sequence(F.col("n")), n=name) == schema


def test_signature_of_a_family(spark):
    names = ["AVOCA 사업계획_v1.docx", "AVOCA 사업계획_v2.docx", "★ AVOCA 사업계획 (2).docx", "AVOCA 사업계획 20240301.docx", "AVOCA 사업계획 최종 3.docx"]
    assert len({value(spark, text.signature(F.col("n"), F.lit("")), n=n) for n in names}) == 1
    others = ["강의평가 사회.pdf", "budget plan.xlsx", "1234.png"]
    assert len({value(spark, text.signature(F.col("n"), F.lit("")), n=n) for n in [*names, *others]}) == 4
    assert value(spark, text.signature(F.col("n"), F.lit("원고 목차 서문")), n="123.txt") == "원고 목차"


def test_sanitize_and_tags(spark):
    clean = lambda n: value(spark, text.sanitize_name(F.col("n")), n=n)
    assert clean('a<b>:"c') == "a_b c" and clean('{"name": "보고서"}') == "보고서" and clean("CON") == "_CON" and clean("") == "folder" and clean("x") == "folder"
    assert clean("ì\x8b\x9cì\xa0\x95ì\x97\x85") == "folder" and len(clean("가" * 500)) == s.LONGEST_NAME and clean(None) == "folder"
    parts = value(spark, text.tag_parts(F.col("n")), n="2. 회의록 (2024-Q1) [FA·ab12cd]")
    assert tuple(parts) == ("회의록", "2024-Q1", "ab12cd") and value(spark, text.tag_parts(F.col("n")), n="plain") is None
    assert value(spark, text.match_core(F.col("n")), n="1. AVOCA  시스템 (2024) [FA·ab12cd]") == "avoca 시스템"
    assert value(spark, text.fuzzy_score(F.lit("avoca"), F.lit("avoca 특허 모듈"))) == 1.0


def test_redaction(spark):
    secret = "sk-" + "a1" * 12
    out = value(spark, text.redact(F.col("t")), t=f"key {secret} Authorization: Bearer abc.def ?key=Zz9 api_key='{'q' * 14}' {'0f' * 30}")
    assert secret not in out and "abc.def" not in out and "Zz9" not in out and "q" * 14 not in out and "0f0f" not in out


@pytest.mark.parametrize(
    "label, start, end",
    [("2024", (2024, 1, 1), (2024, 12, 31)), ("2024-Q2", (2024, 4, 1), (2024, 6, 28)), ("2024-H2", (2024, 7, 1), (2024, 12, 31)), ("2024-3", (2024, 3, 1), (2024, 3, 28)), ("2024-99", (2024, 12, 1), (2024, 12, 28)), ("2023–2025", (2023, 1, 1), (2025, 12, 31))],
)
def test_label_range(spark, label, start, end):
    assert tuple(value(spark, dates.label_range(F.col("l")), l=label)) == (dt.date(*start), dt.date(*end))


@pytest.mark.parametrize("label", ["", "2025-2023", "spring", "2024-Q5", None])
def test_no_range(spark, label):
    assert value(spark, dates.label_range(F.col("l")), l=label) is None


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=st.text(max_size=8), b=st.text(max_size=8))
def test_prefix_and_edit_distance(spark, a, b):
    a, b = a.replace("\0", ""), b.replace("\0", "")
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert value(spark, similarity.common_prefix(F.col("a"), F.col("b")), a=a, b=b) == n
    assert 0 <= value(spark, similarity.edit_similarity(F.col("a"), F.col("b")), a=a, b=b) <= 1


def test_axes(spark):
    assert value(spark, similarity.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))) == pytest.approx(1 / 3)
    assert value(spark, similarity.jaccard(F.array().cast("array<string>"), F.array(F.lit("a")))) == 0
    assert value(spark, similarity.extension_match(F.lit(".pdf"), F.array(F.lit(".pdf")))) == 0.5
    assert value(spark, similarity.prefix_share(F.lit("강의평가_1"), F.array(F.lit("강의평가_사회"), F.lit("x")))) == 1.0
    w = s.Weights().reclassify()
    assert w.s4 == 0 and sum((w.s1, w.s2, w.s3, w.s5, w.s6, w.s7)) == pytest.approx(1)


def test_budget(spark):
    assert value(spark, budget.effective_context(F.lit("gemini-2.5-flash"))) == 62_914
    assert value(spark, budget.chunk_size(F.lit(62_914), F.lit(10))) == 473
    assert value(spark, budget.use_microbatch(F.lit("auto"), F.lit(60_000), F.lit(8_192), F.lit(2_000))) is True


@pytest.mark.parametrize("text_", ['{"a": [1, {"b": "x', '{"a": 1,', '{"a":', '[{"i": 1}, {"i"', '{"ok": true}', '[[1, 2'])
def test_recovered_json(text_):
    json.loads(recovered_json(text_))


def test_search_tokens(spark):
    assert value(spark, text.search_tokens(F.col("t")), t="Café_Ünder-x 가나 Ёлка") == ["cafe", "under", "x", "가나", "елка"]
    assert text.query_phrases('reading_list "Ça"') == [["reading", "list"], ["ca"]]


def test_repaired_mojibake(spark):
    garbled = "견적서".encode().decode("latin-1")
    fixed = lambda t, strict=True: value(spark, text.repaired_mojibake(F.col("t"), strict), t=t)
    assert fixed(garbled + ".pdf") == "견적서.pdf"
    assert fixed(garbled + "€ 한😀.pdf") == "견적서? ??.pdf"  # beyond Latin-1: each character as '?'
    assert fixed(garbled + "€.pdf", False) == garbled + "€.pdf"
    for kept in (garbled[:-1] + "€.pdf", garbled + "€" + "�".encode().decode("latin-1"), garbled[:4] + "€" + garbled[5:], "plan €.pdf", ""):
        assert fixed(kept) == kept
    assert fixed(garbled + "�".encode().decode("latin-1")) == "견적서�"  # the strict reading takes it
