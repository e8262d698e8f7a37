import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qirtas.functions import checks, numbers, stemming, symbols
from qirtas.functions import text as T

SETTINGS = settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, values, expression):
    pairs = isinstance(values[0], tuple)
    df = spark.createDataFrame([(i, *(v if pairs else (v,))) for i, v in enumerate(values)], "i int, a string, b string" if pairs else "i int, a string")
    for c in ("a", "b") if pairs else ("a",):
        for lang in T.LANGS:
            df = df.withColumn(f"{c}_{lang}", T.tokens(F.coalesce(F.col(c), F.lit("")), lang)).withColumn(f"{c}_{lang}_c", T.content_tokens(F.col(f"{c}_{lang}"), lang))
        df = df.withColumn(f"{c}_n", T.normalized(F.col(c), "ar"))
    return [r[0] for r in df.select("i", expression.alias("x")).orderBy("i").select("x").collect()]


def test_normalisation_of_both_languages(spark):
    assert one(spark, ["الأُمَم", "ﻷن", "كتـــاب", "مدرسة", "٤٧/٣٣", "  a \n b "], T.normalized(F.col("a"), "ar")) == ["الامم", "لان", "كتاب", "مدرسه", "47/33", "a b"]
    assert one(spark, ["Ｆｕｌｌ Width", None, ""], T.normalized(F.col("a"), "en")) == ["full width", None, ""]
    with pytest.raises(ValueError):
        T.normalize("x", "fr")
    with pytest.raises(ValueError):
        T.fold(F.col("a"), "fr")


@SETTINGS
@given(st.lists(st.text(alphabet=st.characters(max_codepoint=0x6FF, include_characters="ﬁﻷﺎｆ１　"), max_size=20), min_size=1, max_size=20))
def test_column_and_python_forms_agree(spark, values):
    values = [v.replace("\x00", "").replace("İ", "I") for v in values]
    for lang in T.LANGS:
        assert one(spark, values, T.normalized(F.col("a"), lang)) == [T.normalize(v, lang) for v in values]
    assert one(spark, values, T.words(T.normalized(F.col("a"), "en"))) == [re.findall(r"[^\W]+", T.normalize(v, "en")) for v in values]


def test_f1_of_answers(spark):
    pairs = [("the Security Council", "Security Council"), ("Council", "Assembly"), ("25 November 1992", "25 November"), ("", ""), ("the", "Council"), ("x x y", "x x x z")]
    got = one(spark, pairs, T.token_f1(F.col("a_en_c"), F.col("b_en_c")))
    assert [round(x, 6) for x in got] == [1.0, 0.0, 0.8, 1.0, 0.0, round(4 / 7, 6)]
    assert one(spark, [("المنظمة", "منظمة"), ("وال", "x")], F.col("a_ar_c") == F.col("b_ar_c")) == [True, False]


def test_containment(spark):
    span = T.contains_span(F.col("a_en"), F.col("b_en"))
    assert one(spark, [("The Council decided today", "council decided"), ("Councils decided", "council"), ("x", "")], span) == [True, False, False]
    loose = T.contains_evidence(F.col("a_en"), F.col("b_en"), "en")
    assert one(spark, [("the SecretaryGeneral's report of 1999 was noted", "the Secretary-General's report of 1999"), ("ab c", "a bc")], loose) == [True, False]
    arabic = T.contains_evidence(F.col("a_ar"), F.col("b_ar"), "ar")
    assert one(spark, [("وإذ يؤكد القرار", "إذ يؤكد"), ("قرار آخر", "إذ يؤكد")], arabic) == [True, False]


def test_stems(spark):
    assert one(spark, ["والمنظمة", "معلمون", "كتاب", "كتب", "ولد"], stemming.stem_arabic(F.col("a_n"))) == ["منظم", "معلم", "كتاب", "كتب", "ولد"]
    words = {"resolutions": "resolut", "recommended": "recommend", "generously": "generous", "running": "run", "hopping": "hop", "hoped": "hope", "ponies": "poni", "ties": "tie", "gas": "gas", "skies": "sky", "happy": "happi", "national": "nation", "sensational": "sensat", "relativity": "relat", "knightly": "knight", "controlling": "control", "exceed": "exceed", "communities": "communiti", "adjustment": "adjust", "a": "a"}
    assert {w: stemming.porter2(w) for w in words} == words
    assert one(spark, ["resolutions", None], stemming.stem_english(F.col("a"))) == ["resolut", None]


def test_grouped_numbers(spark):
    assert one(spark, ["$1,974,200, and 2,000; 12,500.", "12,3456 in 1995", "1,234.5 or 7,00"], numbers.english_numbers(F.col("a"))) == [["1,974,200", "2,000", "12,500"], [], ["1,234"]]
    assert one(spark, ["75 000", "31 523 100 dollars", "٧٥ ٠٠٠", "in 1995", "2.9 million", "12,3456"], numbers.has_grouped(F.col("a"))) == [True, True, True, False, False, False]
    normal = F.col("b_n")
    cases = [("278,707", "707 278"), ("278,707", "٢٧٨ ٧٠٧"), ("278,707", "278,707"), ("278,707", "278707"), ("200,200", "200 200"), ("278,707", "1278 707")]
    assert one(spark, cases, numbers.written_as(F.col("a"), normal)) == ["reversed_space", "forward_space", "comma", "joined", "ambiguous", "not_found"]


def test_repair_of_reversed_groups(spark):
    cases = [("spent 278,707 dollars", "مبلغ 707 278 دولار"), ("1,234,567", "٥٦٧ ٢٣٤ ١"), ("200,200", "200 200"), ("50,000", "000 50 123"), ("50,000", "1000 50"), ("no number", "000 50")]
    got = one(spark, cases, numbers.repair(F.col("a"), F.col("b")))
    assert [(r["text"], r["n"]) for r in got] == [("مبلغ 278 707 دولار", 1), ("١ ٢٣٤ ٥٦٧", 1), ("200 200", 0), ("000 50 123", 0), ("1000 50", 0), ("000 50", 0)]


def test_symbols(spark):
    text = "see A/47/10 and S/2004/567, (A/55/432-S/2000/921). resolution 47/33, resolution 1325 (2000), resolution 7/19; x/Y/1"
    assert one(spark, [text], symbols.references(F.col("a"))) == [["A/47/10", "A/55/432", "A/RES/47/33", "S/2000/921", "S/2004/567", "S/RES/1325(2000)"]]
    assert one(spark, ["A/CN.4/452", "S/RES/1711(2006)", "A/ES-10/648 "], symbols.symbol_key(F.col("a"))) == ["a/cn_4/452", "s/res/1711_2006_", "a/es_10/648"]
    assert one(spark, ["1992/a/cn_4/452"], symbols.doc_key(F.col("a"))) == ["a/cn_4/452"]


def test_question_rules(spark):
    english = checks.refers_to_context(F.col("a"), T.normalized(F.col("a"), "en"), "en")
    assert one(spark, ["What does this passage say?", "According to the document, who spoke?", "In the document that the Assembly requested, who spoke?", "Who spoke in Geneva?"], english) == [True, True, False, False]
    arabic = checks.refers_to_context(F.col("a"), T.normalized(F.col("a"), "ar"), "ar")
    assert one(spark, ["ماذا ورد في هذا التقرير؟", "وفقا لنصوص الاتفاقية، من تكلم؟", "وفقا للوثيقة، من تكلم؟", "من تكلم؟"], arabic) == [True, False, True, False]
    assert one(spark, ["what of A/47/10", "resolution 47/33?", "in ٤٧/٣٣", "in 1995"], checks.names_document(T.normalized(F.col("a"), "en"))) == [True, True, True, False]
    parsed = one(spark, ['```json\n{"correct": true}\n```', "[1]", "", "{broken"], checks.parse_object(F.col("a"), "correct boolean"))
    assert [p and p["correct"] for p in parsed] == [True, None, None, None]
    assert one(spark, ["true", " True ", "no", None], checks.truthy(F.col("a"))) == [True, True, False, False]


def test_abstention(spark):
    assert one(spark, [("unknown.", "closed_book"), ("NOT_IN_CONTEXT", "rag:x"), ("UNKNOWN", "oracle"), (None, "rag")], T.abstains(F.col("a"), F.col("b"))) == [True, True, False, False]


def test_unicode_form_leaves_null(spark):
    assert one(spark, ["é", None, "abc"], T.unicode_form(F.col("a"), "NFC")) == [unicodedata.normalize("NFC", "é"), None, "abc"]
