"""Spans, quantity facts and facts of notes against Python's regular expressions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from taxonaut.functions import text as t
from taxonaut.operators import profiles, requirements


@pytest.mark.parametrize("pattern,groups,window", [(r"(\d+)\s*(kg|mm)?", 2, 10), (r"제(\d{4})호[로에]?\s*분류", 1, 50), (r"a+?(b)", 1, 0), (r"(x)", 1, 3)])
def test_matched(spark, pattern, groups, window):
    rng = random.Random(3)
    bits = ["12", "7 kg", "3mm", " ", "제1234호로 분류", "aab", "x", "xx", "$0", "\\1", "\x01", "\x02", "\x03", "가나", "\n", "🙂", "word"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(80)] + [None, "", "x" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: [tuple(m) for m in r.m] for r in df.select("id", t.matched(F.col("text"), pattern, groups, window).alias("m")).collect()}
    for i, x in enumerate(texts):
        x = re.sub(f"[\x01-{chr(3 + groups)}]", " ", x or "")
        want = [(m[0], *(g or "" for g in m.groups()), x[max(0, m.start() - window) : m.start()], x[m.end() : m.end() + window]) for m in re.finditer(pattern, x)]
        assert got[i] == want, x


def test_quantity_facts(spark):
    texts = ["함량 30% 이상", "농도: 5 ppm 이하이고 3 kg 초과", "두께 0.5mm 폭 2 inch", "3:2", None, "", "size 12", "무게가 아주 아주 아주 무거운 물건으로 10 kg 이고 나서 한참 뒤에 미만", "밀도 2 g/cm3", "순도 99"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("norm", t.normalize(F.col("text")))
    both = df.select("id", "text", "norm", requirements.quantity_facts(F.col("text"), False).alias("raw"), requirements.quantity_facts(F.col("text")).alias("plain")).collect()
    for r in both:
        for body, got in (((r.text or "").lower(), r.raw), (r.norm, r.plain)):
            want = []
            for p, prop, unit in requirements.QUANTITIES:
                for m in re.finditer(p, body):
                    near = body[max(0, m.start() - 10) : m.end() + 10]
                    op = next((s for w, s in requirements.OPERATORS if w in near), "=")
                    want.append((float(m[1]), (m[2] or None) if unit is None else unit, prop, op, m[0]))
            assert [tuple(x) for x in got] == want, body
    assert any(x.property == "percent" for x in both[0].raw) and not any(x.property == "percent" for x in both[0].plain)


def test_reasons_have_their_own_windows(spark):
    text = "앞의 설명이다. 제1111호로 분류하고 제2222호로 분류하며 제3333호에 분류한다. " + "뒤" * 80
    out = spark.createDataFrame([(text,), (None,), ("제9999호로 분류",)], "c string").select(profiles.excludes(F.col("c"), F.lit("9999")).alias("x")).collect()
    assert [x.code for x in out[0].x] == ["1111", "2222", "3333"] and out[1].x == [] and out[2].x == []
    for x in out[0].x:
        m = re.search(rf"제({x.code})호[로에]?\s*분류", text)
        assert x.reason == text[max(0, m.start() - 50) : m.end() + 50].strip()[:100] and len(x.reason) > 20


NOTES = "level string, section_num int, chapter_num int, note_number int, note_content string"


def test_note_facts(spark):
    rows = [
        ("chapter", 1, 2, 1, "이 류에서 냉동 또는 pvc 재질은 제외한다. 다만, 살아 있는 동물의 고기는 제외한다"), ("section", 4, None, 2, "식용인 미조립 가구로서 100분의 30 이상, 5 리터 미만"),
        ("subheading", 1, 3, 3, "기타"), ("chapter", 1, 4, 4, None), ("other", None, None, 5, "금속 7% 8%"), ("chapter", 1, 2, 1, "이 류에서 냉동 또는 pvc 재질은 제외한다. 다만, 살아 있는 동물의 고기는 제외한다"),
    ]
    got = {(r.note_id, r.axis, r.operator, r.value, r.hardness) for r in requirements.note_facts(spark.createDataFrame(rows, NOTES)).collect()}
    assert {x for x in got if x[0] == "chapter_02_1"} >= {("chapter_02_1", "processing", "not_contains", "냉동", "hard"), ("chapter_02_1", "material", "not_contains", "PVC", "hard")}
    legal = [x for x in got if x[1] == "legal"]
    assert [x[3] for x in legal] == [re.findall(requirements.EXCLUSIONS[0], rows[0][4])[0][:30].strip()] and legal[0][4] == "hard"
    assert {x for x in got if x[0] == "section_4_2"} == {("section_4_2", a, o, v, "soft") for a, o, v in [("function", "contains", "식용"), ("completeness", "contains", "미조립"), ("completeness", "contains", "조립"), ("quant", "gte", "30%"), ("quant", "lte", "5L")]}
    assert {x[3] for x in got if x[0] == "unknown_5"} == {"금속", "금", "7%", "8%"} and not any(x[0].endswith(("_3", "_4")) for x in got)


def test_codes_inherit_the_nearest(spark):
    rows = [("section", 1, None, 1, "냉동 건조"), ("chapter", 1, 2, 2, "냉동"), ("chapter", 1, 9, 3, "훈제")]
    facts = requirements.note_facts(spark.createDataFrame(rows, NOTES))
    codes = spark.createDataFrame([("0201",), ("0301",), ("9901",), (None,)], "code string")
    got = {(r.code, r.value, r.nearest) for r in requirements.inherited_facts(codes, facts).collect()}
    assert got == {("0201", "냉동", "chapter"), ("0201", "건조", "section"), ("0301", "냉동", "section"), ("0301", "건조", "section")}
    assert requirements.note_facts(spark.createDataFrame([], NOTES)).count() == 0
