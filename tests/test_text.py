"""Literal cases of the text functions."""

import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import arabic
from tessera.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def many(spark, values, f):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", f(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows, key=lambda r: r["i"])]


def test_fold_token(spark):
    given_ = "الباقة باقة والمتجر للشحن لله ال إلى كالعادة بالدفع هى".split()
    assert many(spark, given_, T.fold_token) == "باقه باقه متجر شحن لله ال الي عاده دفع هي".split()


def test_tokens(spark):
    assert one(spark, "x² ½ Ⅷ snake_case 3.5", T.tokens) == ["x²", "½", "ⅷ", "snake_case", "3", "5"]
    assert one(spark, None, T.tokens) == []


def test_normalize(spark):
    got = many(spark, ["ﻣﻨﺘﺠﺎت ﻻ", "١٢٣ / ۴۵", "a  b ‏", None, "  \n"], T.normalize)
    assert got == ["منتجات لا", "123 / 45", "a b", "", ""]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(blacklist_categories=["Cs"]), max_size=30), min_size=1, max_size=20))
def test_strip_and_words_equal_python(spark, values):
    values = [v.replace("\x00", "") for v in values]
    assert many(spark, values, T.strip) == [v.strip() for v in values]
    assert many(spark, values, T.words) == [v.split() for v in values]


def test_mirror(spark):
    assert one(spark, "(a)[b]<c>{d}", T.mirror) == ")a(]b[>c<}d{"
    assert one(spark, "(x]", lambda x: T.mirror(T.mirror(x))) == "(x]"


def test_arabic_ratio_and_labels(spark):
    assert one(spark, "abc", T.arabic_ratio) == 0.0
    assert one(spark, "12", T.arabic_ratio) == 0.0
    assert one(spark, "اب c", T.arabic_ratio) == pytest.approx(2 / 3)
    assert many(spark, ["اب", "ab", "اب ab"], T.lang_label) == ["ar", "en", "mixed"]
    assert many(spark, ["ab"], lambda x: T.lang_label(x, False)) == ["mixed"]


def test_confidence(spark):
    assert many(spark, ["abc", "باقة", "ةقاب نم", "متجر باقة غغ غغ غغ", "غغغ"], arabic.confidence) == ["n/a", "high", "low", "high", "low"]


def restated_word_order(line):
    letters = [c for c in line if c.isalpha()]
    ar = re.compile("[؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿]")
    tokens = line.split()
    if not letters or sum(bool(ar.match(c)) for c in letters) / len(letters) < 0.3 or len(tokens) < 2:
        return line
    out, run = [], []
    for t in reversed([t.translate(str.maketrans("()[]{}<>", ")(][}{><")) for t in tokens]):
        if ar.search(t):
            out, run = [*out, *run[::-1], t], []
        else:
            run.append(t)
    return " ".join(out + run[::-1])


def test_fix_word_order(spark):
    lines = ["زد باقة Pro Plan متجر", "abc def", "باقة", "(متجر) Pro Plan 12 باقة", "  متجر  باقة "]
    got = many(spark, lines, arabic.fix_word_order)
    assert [g["text"] for g in got] == [restated_word_order(x) for x in lines]
    assert got[0]["text"] == "متجر Pro Plan باقة زد" and got[0]["changed"] and not got[1]["changed"]


def test_fix_char_order(spark):
    got = many(spark, ["لا", "ةقاب رجتم X", "abc", None], arabic.fix_char_order)
    assert [g and g["text"] for g in got[:3]] == ["لا", "متجر باقة X", "abc"]
    assert [g["changed"] for g in got[:3]] == [False, True, False]


def test_headings(spark):
    values = ["", "A heading", "Ends.", "x" * 81, "a b c d e f g h i j k", "Ends: "]
    assert many(spark, values, T.is_heading) == [True, True, False, False, False, False]
    assert many(spark, ["", "A heading\nof two lines", "Ends؛"], T.is_block_heading) == [False, True, False]


def test_titles(spark):
    assert many(spark, ["0a1b2c_ff00aa-My__file-", "abcdef_", "plain"], T.file_title) == ["My file", "abcdef_", "plain"]
    df = spark.createDataFrame([("abc123", "Ends.\nA good heading\nx"), ("متجر", "Heading one"), ("My file", "Heading")], "t string, p string")
    got = [r[0] for r in df.select(T.title_or_first_heading(F.col("t"), F.col("p"))).collect()]
    assert got == ["A good heading", "متجر", "My file"]


def test_sentences_and_lines(spark):
    assert one(spark, "A b. C d! e؟ f\ng.", T.sentences) == ["A b.", "C d!", "e؟", "f", "g."]
    assert one(spark, "a\n\n", T.lines) == ["a", "", ""]


def test_boilerplate(spark):
    pattern = r"(share|last updated \w+ \d+, \d{4})"
    assert one(spark, "share\nText share here\n\nlast updated May 1, 2020\nend", lambda x: T.boilerplate(x, pattern)) == "Text here\nend"


def test_nfkc_is_unicodedata(spark):
    values = ["ﬁ", "Å", "½", "ｱ"]
    assert many(spark, values, T.nfkc) == [unicodedata.normalize("NFKC", v) for v in values]


def test_texts_in_their_normal_form_stay_out_of_python(spark):
    """Whatever may change is sent to Python: every code point by itself, and before and after a letter of Latin-1."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    pattern = re.compile(T.UNSTABLE.replace(r"\x{0}", r"\x00").replace(r"\x{9F}", r"\x9f").replace(r"\x{C0}", r"\xc0").replace(r"\x{FF}", r"\xff"))
    kept = [c for c in points if not pattern.match(c)]
    assert len(kept) == 0xA0 + 0x40 and all(unicodedata.normalize("NFKC", x + c + y) == x + c + y for c in kept for x in ("a", "é") for y in ("e", "ü", ""))
    values = ["plain", "é ü ß ÷", None, "e\u0301", "é\u0323", "½", "ﬁ"]
    df = spark.createDataFrame([(v,) for v in values], "x string").select(F.when(F.col("x").rlike(T.UNSTABLE), "x").alias("sent"))
    assert [r["sent"] for r in df.collect()] == [None, None, None, "x", "x", "x", "x"]


def test_prefixes_go_as_tokens_are_found(spark):
    """Folding is one search over the whole text; only texts with a token of stretches alone are folded token by token."""
    texts = ["الكتاب والكتاب بال لل ـ", "والأ والأب ـ_ إلى", "x ـــ y", "للمة 1ال ـالكتب", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = F.regexp_extract_all(F.lower(F.coalesce("t", F.lit(""))), F.lit(T.TOKEN), 0)
    assert [r[0] for r in df.select(T.tokens(F.col("t"))).collect()] == [r[0] for r in df.select(F.transform(found, T.fold_token)).collect()]
    plan = df.select(T.tokens(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(lower(" in plan


def test_words_are_searched_for_once(spark):
    df = spark.createDataFrame([("من في ةكت",), ("نم يف ىلع",), ("none",), (None,)], "t string")
    t = F.col("t")
    plan = df.select(arabic.judged(t).alias("j"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1 and "array_contains" not in plan
    rows = df.select(arabic.judged(t).alias("j"), arabic.lexicon_score(t).alias("score"), arabic.confidence(t).alias("confidence")).collect()
    assert [tuple(r["j"]) for r in rows[:3]] == [tuple(r)[1:] for r in rows[:3]] == [(1, "high"), (-1, "low"), (0, "n/a")]


def test_runs_end_with_a_letter(spark):
    """White space at the end of a run is no part of it, so that no run is searched again."""
    df = spark.createDataFrame([("ىلع نم \t.  نم ",), ("من في",)], "t string")
    fixed = df.select(arabic.fix_char_order(F.col("t")).alias("f"))
    assert [tuple(r["f"]) for r in fixed.collect()] == [("من على \t.  من ", True), ("من في", False)]
    assert fixed._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 2


def test_normalising_looks_at_the_ends_of_a_text(spark):
    texts = ["", " ", "a", " a", "a ", " a  b\t\tc‏", "٣ x ", "é\x1c", "\U0001d7d8 ", "﷼  a", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["n"] for r in df.orderBy("i").select(T.normalize(F.col("t")).alias("n")).collect()]
    assert got == ["", "", "a", "a", "a", "a b c", "3 x", "é", "0", "ریال a", ""]
