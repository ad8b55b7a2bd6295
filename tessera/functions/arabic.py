"""Repair of Arabic text whose words or characters an extractor left in visual order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as T

# Frequent words, by which two readings of a string are compared. Product names are left to the caller.
WORDS = (
    "من في على إلى الى عن مع أو او و ثم لا نعم هذا هذه ذلك التي الذي كل بعد قبل عند بين حتى أي غير بدون خلال حسب عبر لكن كما "
    "متجر المتجر متاجر تاجر التاجر التجار منتج المنتج منتجات طلب طلبات الطلبات سعر السعر أسعار الأسعار ريال شهر شهري شهريا سنة "
    "سنوي باقة الباقة باقات اشتراك الاشتراك خدمة خدمات الخدمات عميل العميل عملاء العملاء شحن الشحن توصيل دفع الدفع مدفوعات فاتورة "
    "ضريبة الضريبة مجاني مجانية تكلفة تكاليف قيمة عمولة خصم مبيعات المبيعات تسويق التسويق إعلانات الإعلانات نمو النمو تطبيق لوحة "
    "التحكم تقرير تقارير دعم الدعم حساب الحساب تفعيل مخزون المخزون فرع فروع نقاط البيع كاشير جهاز يوم أيام يومين أسبوع أسبوعين عمل "
    "مدة تنفيذ متوفر متوفرة يشمل تشمل السعودية مصر الإمارات الكويت عمان الرياض جدة"
).split()
#: Letters that stand only at the end of a word; at its start they tell of reversed characters.
FINAL_ONLY = "ةى"


def _found(x: Column, pattern: str) -> Column:
    return F.regexp_extract_all(T.strip_marks(x), F.lit(f"({pattern})"), 1)


def _score(found: Column, lexicon, final_only: str) -> Column:
    return _hits(found, lexicon) - F.size(F.filter(found, lambda t: F.substring(t, 1, 1).isin(*final_only)))


def _hits(found: Column, lexicon) -> Column:
    # literals, which Spark looks up in a set; an array would be searched for every word
    return F.size(F.filter(found, lambda t: t.isin(*lexicon))) if lexicon else F.size(found) * 0


def _confidence(found: Column, lexicon) -> Column:
    counts = F.struct(_hits(found, lexicon).alias("hits"), _hits(found, [w[::-1] for w in lexicon]).alias("backwards"), F.size(found).alias("n"))

    def judge(c: Column) -> Column:
        hits, n = c["hits"], c["n"]
        judged = F.when((hits >= 2) | ((hits >= 1) & (n <= 3)), "high").when(c["backwards"] > hits, "low").when(hits > 0, "high").otherwise("low")
        return F.when(n == 0, "n/a").otherwise(judged)

    return T.let(counts, judge)


def lexicon_score(x: Column, lexicon=WORDS, pattern: str = f"[{T.ARABIC}]+", final_only: str = FINAL_ONLY) -> Column:
    """Words of the lexicon, less words that begin with a letter that only ends words."""
    return T.let(_found(x, pattern), lambda found: _score(found, lexicon, final_only))


def confidence(x: Column, lexicon=WORDS) -> Column:
    return F.when(~T.has_arabic(x), "n/a").otherwise(T.let(_found(x, f"[{T.ARABIC}]+"), lambda found: _confidence(found, lexicon)))


def judged(x: Column, lexicon=WORDS) -> Column:
    """struct(score, confidence) from one search for words; see ``lexicon_score`` and ``confidence``."""
    both = lambda found: F.struct(_score(found, lexicon, FINAL_ONLY).alias("score"), _confidence(found, lexicon).alias("confidence"))
    none = F.struct(F.lit(0).alias("score"), F.lit("n/a").alias("confidence"))
    return F.when(~x.rlike(f"[{T.ARABIC}]"), none).otherwise(T.let(_found(x, f"[{T.ARABIC}]+"), both))


def fix_word_order(line: Column) -> Column:
    """Reverse the words of an Arabic line, mirror brackets, and turn runs of other words back. -> struct(text, changed)"""
    has = lambda t: t.rlike(f"[{T.ARABIC}]")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("run"))
    none = F.array().cast("array<string>")
    step = lambda a, t: F.when(
        has(t), F.struct(F.concat(a["out"], a["run"], F.array(t)).alias("out"), none.alias("run"))
    ).otherwise(F.struct(a["out"].alias("out"), F.concat(F.array(t), a["run"]).alias("run")))
    turned = F.transform(F.reverse(T.words(line)), T.mirror)
    fixed = F.aggregate(turned, start, step, lambda a: F.array_join(F.concat(a["out"], a["run"]), " "))
    keep = (T.arabic_ratio(line) < 0.3) | (F.size(T.words(line)) < 2)
    fixed = F.when(keep, line).otherwise(fixed)
    return F.struct(fixed.alias("text"), (fixed != line).alias("changed"))


#: Arabic letters with white space between them, or what is between such runs.
_RUN = rf"[{T.ARABIC}]++(?:{T.WS}++[{T.ARABIC}]++)*+|[^{T.ARABIC}]++"


def fix_char_order(x: Column, lexicon=WORDS) -> Column:
    """Reverse the characters of each Arabic run, if that makes more known words. -> struct(text, changed)

    White space at a run's end stays there. ``x`` is used inside of functions of elements, so it must be a column if a
    Python function makes it.
    """
    pieces = F.transform(F.regexp_extract_all(x, F.lit(_RUN), 0), lambda p: F.when(p.rlike(f"^[{T.ARABIC}]"), F.reverse(p)).otherwise(p))
    result = lambda text, changed: F.struct(text.alias("text"), F.lit(changed).alias("changed"))
    judged = T.let(F.array_join(pieces, ""), lambda out: F.when(lexicon_score(out, lexicon) > lexicon_score(x, lexicon), result(out, True)).otherwise(result(x, False)))
    return F.when(x.rlike(f"[{T.ARABIC}]"), judged).otherwise(result(x, False))
