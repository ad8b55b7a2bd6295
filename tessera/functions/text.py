"""Text functions as Column expressions. Only NFKC, which Spark lacks, is an Arrow function."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: A token is a run of letters, numbers, underscores and anything of the Arabic block.
TOKEN = r"[\p{L}\p{N}_\x{0600}-\x{06FF}]+"
#: White space as Python's str.strip and str.split see it.
WS = r"[\p{IsWhite_Space}\x1C-\x1F]"
ARABIC = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
# Digits, spellings that are folded, and prefixes that are dropped, in their order.
DIGITS = ("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
FOLDED = ("إأآاةىـ", "ااااهي")
PREFIXES = ("ال", "بال", "كال", "فال", "وال", "لل")
MIRROR = ("()[]{}<>", ")(][}{><")
TATWEEL = "ـ"


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once. An expression that a function of elements mentions is else evaluated for each of them."""
    return F.get(F.transform(F.array(x), f), 0)


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{WS}+|{WS}+$", "")


def words(x: Column) -> Column:
    """Pieces between runs of white space, like str.split()."""
    bare = strip(x)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{WS}+"))


def strip_marks(x: Column) -> Column:
    return F.regexp_replace(x, rf"[{TATWEEL}\p{{Mn}}]+", "")


#: What NFKC may change: a text of ASCII and of Latin-1's accented letters alone is in that form already.
UNSTABLE = r"[^\x{0}-\x{9F}\x{C0}-\x{FF}]"
#: Texts that a worker has as Python strings at once.
AT_ONCE = 256


@F.arrow_udf(StringType())
def _nfkc(x: pa.Array) -> pa.Array:
    one = lambda s: None if s is None else unicodedata.normalize("NFKC", s)
    parts = [pa.array([one(s) for s in x.slice(i, AT_ONCE).to_pylist()], pa.string()) for i in range(0, len(x), AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(ArrayType(ArrayType(StringType())))
def nfkc_lists(x: pa.Array) -> pa.Array:
    """NFKC of the strings in lists of lists."""
    one = lambda s: None if s is None else unicodedata.normalize("NFKC", s)
    some = lambda t: None if t is None else [None if r is None else [one(s) for s in r] for r in t]
    kind = pa.list_(pa.list_(pa.string()))
    parts = [pa.array([some(t) for t in x.slice(i, AT_ONCE).to_pylist()], kind) for i in range(0, len(x), AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def nfkc(x: Column) -> Column:
    """Only texts that may change are sent to Python."""
    return F.coalesce(_nfkc(F.when(x.rlike(UNSTABLE), x)), x)


def _spaced(x: Column) -> Column:
    # most texts have no such run, and few have white space at an end, for which a search looks at every character
    x = F.when(F.contains(x, F.lit("  ")) | F.contains(x, F.lit("\t")), F.regexp_replace(x, r"[ \t]{2,}", " ")).otherwise(x)
    return F.when(F.concat(F.left(x, F.lit(1)), F.right(x, F.lit(1))).rlike(WS), strip(x)).otherwise(x)


def tidy(x: Column) -> Column:
    """What normalising does besides NFKC."""
    return _spaced(F.translate(x, DIGITS[0] + "\u00a0\u200f\u200e", DIGITS[1] + " "))


def normalize(x: Column) -> Column:
    x = F.coalesce(x, F.lit(""))
    changed = _nfkc(F.when(x.rlike(UNSTABLE), x))
    # a text that NFKC leaves alone has no character that is translated either
    return F.when(changed.isNull(), _spaced(x)).otherwise(tidy(changed))


def collapse_ws(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n")


def fold_token(t: Column) -> Column:
    """Fold spellings, then drop the first prefix that leaves more than two characters."""
    t = F.translate(t, *FOLDED)
    out = t
    for p in reversed(PREFIXES):
        out = F.when((F.length(t) > len(p) + 2) & F.startswith(t, F.lit(p)), F.substring(t, len(p) + 1, 1 << 30)).otherwise(out)
    return out


#: A token, its prefix left out of the group if more than two characters follow: what ``fold_token`` does to one.
_BARE_TOKEN = rf"(?:(?:{'|'.join(PREFIXES)})(?={TOKEN[:-1]}{{3}}))?+({TOKEN})"
#: A token of stretches alone, which folding leaves empty.
_STRETCH = rf"{TATWEEL}(?<!{TOKEN[:-1]}{TATWEEL}){TATWEEL}*+(?!{TOKEN[:-1]})"


def tokens(x: Column) -> Column:
    low = F.lower(F.coalesce(x, F.lit("")))
    found = F.regexp_extract_all(low, F.lit(TOKEN), 0)
    # spellings are folded in the whole text, for all that is folded belongs to tokens, and prefixes go as tokens are found
    folded = F.regexp_extract_all(F.translate(low, *FOLDED), F.lit(_BARE_TOKEN), 1)
    # a text without Arabic letters has nothing to fold
    return F.when(~low.rlike(r"[\x{0620}-\x{064A}]"), found).when(low.rlike(_STRETCH), F.transform(found, fold_token)).otherwise(folded)


def letters(x: Column) -> Column:
    return F.regexp_replace(x, r"\P{L}", "")


def has_arabic(x: Column) -> Column:
    """Whether there is an Arabic character; the first look is for any from that block on, since a single range is quick."""
    return x.rlike(r"[^\x{0}-\x{5FF}]") & x.rlike(f"[{ARABIC}]")


def arabic_ratio(x: Column) -> Column:
    all_ = letters(x)
    own = F.regexp_replace(all_, f"[^{ARABIC}]", "")
    share = F.when(F.length(all_) == 0, F.lit(0.0)).otherwise(F.length(own) / F.length(all_))
    # most texts of other scripts are settled by one look for an Arabic character
    return F.when(has_arabic(x), share).otherwise(F.lit(0.0))


def lang_label(x: Column, three_way: bool = True) -> Column:
    """ar, en or mixed by the share of Arabic letters; sources other than extracted files know ar and mixed only."""

    def label(r: Column) -> Column:
        rest = F.when(r < 0.2, F.lit("en")).otherwise(F.lit("mixed")) if three_way else F.lit("mixed")
        return F.when(r > 0.6, F.lit("ar")).otherwise(rest)

    return let(arabic_ratio(x), label)


def mirror(x: Column) -> Column:
    return F.translate(x, *MIRROR)


def sentences(x: Column) -> Column:
    return F.split(x, r"(?<=[.؟!])(?U:\s+)|\n")


def lines(x: Column) -> Column:
    return F.split(x, "\n")


def content_key(x: Column) -> Column:
    return F.substring(F.sha2(x, 256), 1, 16)


def is_heading(line: Column, most_chars: int = 80, most_words: int = 10) -> Column:
    """A line of extracted prose that looks like a heading; an empty line does."""
    end = F.regexp_replace(line, f"{WS}+$", "").rlike(r"[.،:]$")
    return (F.length(line) <= most_chars) & ~end & (F.size(words(line)) <= most_words)


def is_block_heading(block: Column, most_chars: int = 80, most_words: int = 10) -> Column:
    """A block of a document that looks like a heading: stripped, not empty, and no semicolon at its end."""
    s = strip(block)
    return (F.length(s) > 0) & (F.length(s) <= most_chars) & ~s.rlike(r"[.،:؛]$") & (F.size(words(s)) <= most_words)


def is_table_line(line: Column) -> Column:
    return line.rlike(rf"^{WS}*\|")


def boilerplate(x: Column, pattern: str, sep: str = "\n") -> Column:
    """Drop lines that are boilerplate as a whole, then blank it inside the others, and collapse white space."""
    kept = F.filter(F.transform(F.split(x, sep), strip), lambda s: (s != "") & ~s.rlike(f"^(?:{pattern})$"))
    return strip(F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), pattern, " "), f"{WS}{{2,}}", " "))


def file_title(stem: Column) -> Column:
    """A readable title from a file name that carries hexadecimal upload ids."""
    # a fixed value: what such ids look like
    name = F.regexp_replace(stem, r"^(?:[0-9a-f]{6,}[_-]+)+", "")
    name = F.regexp_replace(F.regexp_replace(name, "_+", " "), r"^[ \-_]+|[ \-_]+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(name, f"{WS}{{2,}}", " "), F.lit("")), stem)


def page_context(x: Column) -> Column:
    """The first two headings of a page."""
    found = F.filter(lines(x), lambda s: (strip(s) != "") & is_heading(s))
    return F.array_join(F.slice(found, 1, 2), " — ")


def title_or_first_heading(title: Column, first_page: Column) -> Column:
    """The title, unless what it has of ASCII letters and digits is all hexadecimal; then the first good heading."""
    ascii_ = F.lower(F.regexp_replace(title, "[^0-9A-Za-z]", ""))
    heading = F.get(F.filter(lines(first_page), lambda s: is_heading(s) & (F.length(letters(s)) >= 3)), 0)
    found = F.when((ascii_ != "") & ascii_.rlike("^[0-9a-f]*$"), F.nullif(strip(heading), F.lit("")))
    return F.coalesce(found, title)
