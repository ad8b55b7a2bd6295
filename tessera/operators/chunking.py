"""Chunking: documents into token-bounded chunks with lineage."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.runtime import small_batches

TARGET_CHARS, LEAST_CHARS = 1800, 200
TARGET_TOKENS, MOST_TOKENS, LEAST_TOKENS = 450, 700, 40


def chunk_chars(x: Column, target: int = TARGET_CHARS, least: int = LEAST_CHARS) -> Column:
    """Pack lines until their characters reach ``target``; each further chunk begins with the page's heading.

    A heading is noted only where a chunk has no line yet. A rest of fewer than ``least`` characters joins the chunk
    before it, if there is one.
    """
    texts = "array<string>"
    start = F.struct(F.array().cast(texts).alias("out"), F.array().cast(texts).alias("cur"), F.lit("").alias("heading"), F.lit(0).alias("n"))

    def step(a, line):
        heading = F.when((F.size(a["cur"]) == 0) & T.is_heading(line), line).otherwise(a["heading"])
        cur = F.concat(a["cur"], F.array(line))
        n = a["n"] + F.length(line)
        full = n >= target
        after = F.when(heading != "", F.array(heading)).otherwise(F.array().cast(texts))
        out = F.when(full, F.concat(a["out"], F.array(F.array_join(cur, "\n")))).otherwise(a["out"])
        return F.struct(out.alias("out"), F.when(full, after).otherwise(cur).alias("cur"), heading.alias("heading"), F.when(full, F.length(heading)).otherwise(n).alias("n"))

    def finish(a):
        rest, out = F.array_join(a["cur"], "\n"), a["out"]
        n = F.size(out)
        joined = F.concat(F.slice(out, 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.element_at(out, -1), F.lit("\n"), rest)))
        return F.when(F.size(a["cur"]) == 0, out).when((a["n"] >= least) | (n == 0), F.concat(out, F.array(rest))).otherwise(joined)

    return F.aggregate(T.lines(x), start, step, finish)


def blocks(x: Column) -> Column:
    """Paragraphs between blank lines; a run of table lines is a block of its own."""
    texts = "array<string>"
    none = F.array().cast(texts)
    start = F.struct(none.alias("out"), none.alias("cur"), F.lit(False).alias("table"))

    def step(a, line):
        table, blank = T.is_table_line(line), T.strip(line) == ""
        flush = (F.size(a["cur"]) > 0) & ((table != a["table"]) | (~table & blank))
        out = F.when(flush, F.concat(a["out"], F.array(F.array_join(a["cur"], "\n")))).otherwise(a["out"])
        kept = F.when(flush, none).otherwise(a["cur"])
        cur = F.when(table | ~blank, F.concat(kept, F.array(line))).otherwise(kept)
        return F.struct(out.alias("out"), cur.alias("cur"), table.alias("table"))

    return F.aggregate(T.lines(x), start, step, lambda a: F.when(F.size(a["cur"]) > 0, F.concat(a["out"], F.array(F.array_join(a["cur"], "\n")))).otherwise(a["out"]))


#: Thousandths of a token for a character, and what a character of Arabic has more.
CHAR_UNITS, ARABIC_UNITS = 250, 45
GAP = "\n\n"
_SENTENCE, _TABLE, _ARABIC = re.compile(r"(?<=[.؟!])\s+|\n"), re.compile(r"\s*\|"), re.compile("[\u0600-\u06ff]")


@dataclass(frozen=True)
class Counter:
    """How a text is measured: ``counts`` of many texts, in parts of a token (``scale`` of them), and how one is cut.

    ``cut(text, limit)`` gives pieces of at most ``limit`` tokens. A count may depend on the white space before a text, but
    not on other text there, so that counts of blocks and sentences in a row add up. ``led(lead, texts, alone)`` counts texts
    behind white space, given their counts alone; without it they are counted anew. ``adds`` tells of a text whether its count
    is exactly that of its parts, all led by white space but the first, where none has white space of its own at an end.
    ``least`` is a number, quickly found, that a text's count does not fall below.
    """

    name: str
    counts: Callable[[list[str]], list[int]]
    cut: Callable[[str, int], list[str]]
    scale: int = 1
    led: Callable[[str, list[str], list[int]], list[int]] | None = None
    adds: Callable[[str], bool] | None = None
    least: Callable[[str], int] = lambda text: 0

    def tokens(self, texts: list[str]) -> list[int]:
        return [-(-n // self.scale) for n in self.counts(texts)]

    def behind(self, lead: str, texts: list[str], alone: list[int]) -> list[int]:
        return self.led(lead, texts, alone) if self.led else self.counts([lead + t for t in texts])


@lru_cache(1024)
def _once(counter: Counter, text: str) -> int:
    """The count of a text that comes again, such as a title."""
    return counter.counts([text])[0]


def _estimate(texts: list[str]) -> list[int]:
    return [CHAR_UNITS * len(t) + (0 if t.isascii() else ARABIC_UNITS * len(_ARABIC.findall(t))) for t in texts]


def _cut_chars(text: str, limit: int) -> list[str]:
    size = max(1, limit * 1000 // (CHAR_UNITS + ARABIC_UNITS))  # as many characters, were they all Arabic
    return [text[i : i + size] for i in range(0, len(text), size)]


#: An estimate by characters, which needs no vocabulary.
ESTIMATE = Counter("estimate", _estimate, _cut_chars, 1000)


def by_words() -> Counter:
    def cut(s: str, limit: int) -> list[str]:
        w = s.split()
        return [" ".join(w[i : i + limit]) for i in range(0, len(w), limit)]

    return Counter("words", lambda texts: [len(t.split()) for t in texts], cut)


@cache
def _tokenizer(path: str):
    # Spark runs a task on each core; threads of the library's own would only be in their way
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Pre-tokens that a worker remembers with their counts, and characters of the longest of them.
REMEMBERED, LONGEST = 1 << 18, 64
_HIGH, _SEPARATORS = re.compile("[\U00010000-\U0010ffff]"), re.compile("[\x1c-\x1f]")


@cache
def _pretokens() -> re.Pattern:
    """Pre-tokens of byte-level BPE, for characters below U+10000 (Python looks those up in a table)."""
    kinds = {"L": [], "N": []}
    for cp in range(0x10000):
        if (kind := unicodedata.category(chr(cp))[0]) in kinds:
            if kinds[kind] and kinds[kind][-1][1] == cp - 1:
                kinds[kind][-1][1] = cp
            else:
                kinds[kind].append([cp, cp])
    # a fixed value: white space of the Unicode property White_Space
    white = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    letter, number = ("".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in kinds[k]) for k in "LN")
    return re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{white}{letter}{number}]+|[{white}]+(?![^{white}])|[{white}]+")


def _low(m: re.Match) -> str:
    return {"L": "a", "N": "1"}.get(unicodedata.category(m[0])[0], "#")


def pretokens(text: str) -> list[str]:
    if text.isascii() or not _HIGH.search(text):
        return _pretokens().findall(text)
    # characters above that table are looked up one by one, and others of their kind take their places in the pattern
    return [text[m.start() : m.end()] for m in _pretokens().finditer(_HIGH.sub(_low, text))]


@cache
def _added(path: str) -> re.Pattern | None:
    """A pattern of the strings that are tokens of their own, if all else is byte-level BPE of pre-tokens; else None."""
    with open(path, encoding="utf-8") as f:
        x = json.load(f)
    split, model = x.get("pre_tokenizer") or {}, x["model"]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
    plain = plain and model.get("type") == "BPE" and not model.get("dropout") and not any(x.get(k) for k in ("normalizer", "truncation", "padding"))
    return re.compile("|".join(re.escape(a["content"]) for a in x["added_tokens"]) or r"(?!)") if plain else None


@cache
def _known(path: str) -> dict[str, int]:
    return {}


@dataclass(frozen=True)
class _Model:
    """A vocabulary's model alone, which takes single pre-tokens."""

    path: str


@cache
def _bytes_shown() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return {b: chr(b if b in shown else next(rest)) for b in range(256)}


def _lengths(of: str | _Model, texts: list[str]) -> list[int]:
    """Numbers of tokens as the library gives them, by a vocabulary or by its model."""
    if isinstance(of, str):
        return [len(e) for e in _tokenizer(of).encode_batch(texts, add_special_tokens=False)]
    # no pre-token has the byte FF, as none of UTF-8 has
    shown, model = b"\xff".join([t.encode() for t in texts]).decode("latin-1").translate(_bytes_shown()), _tokenizer(of.path).model
    return [len(model.tokenize(t)) for t in shown.split(_bytes_shown()[0xFF])]


def _sums_of(path: str, parts: list[list[str]]) -> list[int]:
    """Counts of lists of pre-tokens."""
    known = _known(path)
    if len(known) > REMEMBERED:
        known.clear()
    new = list(set(chain.from_iterable(parts)).difference(known))
    if new:
        known.update(zip(new, _lengths(_Model(path), new), strict=True))
    counts = [sum(map(known.__getitem__, some)) for some in parts]
    for p in new:
        if len(p) > LONGEST:
            del known[p]
    return counts


def _vocabulary_counts(path: str, texts: list[str]) -> list[int]:
    """Counts as the library gives them. Of byte-level BPE a text's count is the sum of its pre-tokens', and these repeat."""
    added = _added(path)
    if added is None:
        return _lengths(path, texts)
    whole = [i for i, t in enumerate(texts) if added.search(t)]
    parts = [pretokens(t) for t in texts]
    for i in whole:
        parts[i] = []
    counts = _sums_of(path, parts)
    if whole:
        for i, n in zip(whole, _lengths(path, [texts[i] for i in whole]), strict=True):
            counts[i] = n
    return counts


def _vocabulary_led(path: str, lead: str, texts: list[str], alone: list[int]) -> list[int]:
    """Counts of texts behind ``lead``. A gap of lines leaves the pre-tokens of most texts as they are."""
    added, anew = _added(path), range(len(texts))
    out = list(alone)
    if added is not None and lead == GAP:
        anew = [i for i, t in enumerate(texts) if not t or t[0].isspace() or added.search(lead + t)]
        a, b = _sums_of(path, [["a"], pretokens(lead + "a")])
        out = [n + b - a for n in alone]
    if anew:
        for i, n in zip(anew, _vocabulary_counts(path, [lead + texts[i] for i in anew]), strict=True):
            out[i] = n
    return out


def vocabulary(path: str) -> Counter:
    """Counts by a vocabulary of the tokenizers library, a file that every executor has."""

    def cut(s: str, limit: int) -> list[str]:
        lib = _tokenizer(path)
        ids = lib.encode(s, add_special_tokens=False).ids
        return [lib.decode(ids[i : i + limit]) for i in range(0, len(ids), limit)]

    def adds(text: str) -> bool:
        return _added(path) is not None and not _added(path).search(text)

    def least(text: str) -> int:
        # no pre-token holds two words, but for the four characters that are white space to Python alone
        return len(text.split()) if adds(text) and not _SEPARATORS.search(text) else 0

    return Counter("vocabulary", lambda texts: _vocabulary_counts(path, texts), cut, 1, lambda *a: _vocabulary_led(path, *a), adds, least)


@cache
def _ranks(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def bpe(path: str, pattern: str) -> Counter:
    """A byte-pair vocabulary as a file of ranks; pieces may cut a character, which then shows as U+FFFD."""

    def cut(s: str, limit: int) -> list[str]:
        ids = _ranks(path, pattern).encode_ordinary(s)
        return [_ranks(path, pattern).decode(ids[i : i + limit]) for i in range(0, len(ids), limit)]

    return Counter("bpe", lambda texts: [len(ids) for ids in _ranks(path, pattern).encode_ordinary_batch(texts, num_threads=1)], cut)


def _paragraphs(text: str) -> list[str]:
    """``blocks`` of one text."""
    out, cur, table = [], [], False
    for line in text.split("\n"):
        own, blank = _TABLE.match(line) is not None, not line.strip()
        if cur and (own != table or blank):
            out.append("\n".join(cur))
            cur = []
        if not blank:
            cur.append(line)
        table = own
    return [*out, "\n".join(cur)] if cur else out


def _is_heading(block: str, most_chars: int = 80, most_words: int = 10) -> bool:
    s = block.strip()
    return 0 < len(s) <= most_chars and s[-1] not in ".،:؛" and len(s.split()) <= most_words


class _Sums:
    """Texts in a row by their running totals: the furthest that fits a limit is found by a search."""

    def __init__(self, after: list[int]):
        self.upto = np.concatenate([[0], np.cumsum(after, dtype=np.int64)])

    def run(self, i: int, base: int, limit: int, stop: int) -> tuple[int, int]:
        """One past the last text that fits behind text i, which counts as ``base``, and the total."""
        end = int(np.searchsorted(self.upto, limit - base + self.upto[i + 1], side="right")) - 1
        end = min(max(end, i + 1), stop)
        return end, base + int(self.upto[end] - self.upto[i + 1])


def _inner(texts: list[str]) -> np.ndarray:
    """For each place, how many texts before it end with white space, so that counts don't add up behind them."""
    return np.concatenate([[0], np.cumsum([t[-1].isspace() for t in texts])])


def _pieces(block: str, hard: int, counter: Counter) -> list[tuple[str, int, bool]]:
    """A long block as pieces of whole sentences up to ``hard`` tokens; what is longer still is cut. With counts, and whether exact."""
    parts = [s for s in _SENTENCE.split(block) if s.strip()]
    # a sentence is counted without the space before it only where a piece begins
    sums, i, out, open_ = _Sums(counter.counts([" " + s for s in parts])), 0, [], _inner(parts)
    while i < len(parts):
        end, n = sums.run(i, counter.counts([parts[i]])[0], hard * counter.scale, len(parts))
        text = " ".join(parts[i:end])
        if n > hard * counter.scale:
            cut = counter.cut(text, hard)
            out += zip(cut, counter.counts(cut), [True] * len(cut), strict=True)
        else:
            out.append((text, n, open_[end - 1] == open_[i]))
        i = end
    return out


def split_text(text: str, title: str, counter: Counter, target: int = TARGET_TOKENS, most: int = MOST_TOKENS, least: int = LEAST_TOKENS) -> list[str]:
    """One document's chunks; see ``chunk_tokens``."""
    return [c for c, _ in _split(text, title, counter, target, most, least)]


def _split(text: str, title: str, counter: Counter, target: int, most: int, least: int) -> list[tuple[str, int | None]]:
    """The chunks with their counts, where these are known from their parts."""
    prefix = f"{title}{GAP}" if title else ""
    used = -(-_once(counter, prefix) // counter.scale) if prefix else 0
    # a title may leave no room; then each block or sentence stands alone, and what is cut has a token at least
    soft, hard = target - used, max(1, most - used)
    blocks_ = _paragraphs(text)
    if not blocks_:
        return []
    n = len(blocks_)
    # blocks that are surely cut are counted by their sentences only; what stands for their counts is never looked at
    sure = [len(b) > hard and counter.least(b) > hard * counter.scale and not _TABLE.match(b) for b in blocks_]
    some = [b for b, s in zip(blocks_, sure, strict=True) if not s]
    counts = counter.counts(some)
    both = iter(zip(counts, counter.behind(GAP, some, counts), strict=True))
    alone, after = (list(x) for x in zip(*[(hard * counter.scale + 1,) * 2 if s else next(both) for s in sure], strict=True))
    sums, open_ = _Sums(after), _inner(blocks_)
    long = np.array([s or (u > hard * counter.scale and not _TABLE.match(b)) for s, u, b in zip(sure, alone, blocks_, strict=True)])
    heads = np.maximum.accumulate(np.where([_is_heading(b) for b in blocks_] & ~long, np.arange(n), -1))
    stops = np.append(np.flatnonzero(long), n)
    bodies: list[tuple[str, int, bool]] = []
    i, full = 0, False
    while i < n:
        if long[i]:
            bodies += _pieces(blocks_[i], hard, counter)
            i, full = i + 1, False
            continue
        # a body that follows a full one begins with the last heading, unless its first block is that heading
        head = int(heads[i]) if full else -1
        led = head >= 0 and blocks_[head] != blocks_[i]
        end, u = sums.run(i, alone[head] + int(after[i]) if led else alone[i], soft * counter.scale, int(stops[np.searchsorted(stops, i)]))
        exact = open_[end - 1] == open_[i] and not (led and blocks_[head][-1].isspace())
        bodies.append((GAP.join([*([blocks_[head]] if led else []), *blocks_[i:end]]), u, exact))
        i, full = end, end < n and not long[end]
    gap = _once(counter, GAP)
    small = least * counter.scale - counter.scale  # at most so many parts are fewer than ``least`` tokens
    groups: list[list[str]] = []
    known: list[list[int | None]] = []
    first = 0
    for whole, u, exact in bodies:
        if not (body := whole.strip()):
            continue
        n = u if exact and len(body) == len(whole) else None
        if groups and (u <= small or (len(groups) == 1 and first <= small)):
            groups[-1].append(body)
            known[-1].append(n)
            first += gap + u if len(groups) == 1 else 0
        else:
            groups.append([body])
            known.append([n])
            first = u if len(groups) == 1 else first
    made = [GAP.join(g) for g in groups]
    named = [c if c.startswith(title) else prefix + c for c in made]
    if counter.adds is None:
        return [(c, None) for c in named]
    # the title and the bodies stand between gaps; see ``Counter.adds``
    own = _once(counter, title) if title and title.strip() == title else None
    between = _once(counter, GAP + "a") - _once(counter, "a")
    out: list[tuple[str, int | None]] = []
    for c, whole, counts in zip(named, made, known, strict=True):
        counts = counts if c is whole else [own, *counts]
        sure = None not in counts and counter.adds(c)
        out.append((c, sum(counts) + between * (len(counts) - 1) if sure else None))
    return out


def chunk_tokens(df: DataFrame, counter: Counter | None, text_col: str, title_col: str, out: str, target: int = TARGET_TOKENS, most: int = MOST_TOKENS, least: int = LEAST_TOKENS) -> DataFrame:
    """Add an array of chunks (text, tokens) of about ``target`` tokens that all begin with the title.

    Blocks in a row make a chunk. Tables stay whole; other blocks above ``most`` are cut, by sentences, and stand alone.
    A chunk of fewer than ``least`` tokens joins the one before it, and a small first one takes up the next. Where a chunk
    ends and what joins is decided by running totals of the blocks' counts, so time is linear in the text whatever its
    shape; ``tokens`` is the count of the finished chunk. Nulls are empty; an empty text has no chunk.
    """
    counter = counter or ESTIMATE

    @F.arrow_udf("array<struct<text:string,tokens:int>>")
    def cut(texts: pa.Array, titles: pa.Array) -> pa.Array:
        made = [_split(t or "", h or "", counter, target, most, least) for t, h in zip(texts.to_pylist(), titles.to_pylist(), strict=True)]
        flat = [c for some in made for c, _ in some]
        sizes = [-(-n // counter.scale) if n is not None else None for some in made for _, n in some]
        rest = [i for i, n in enumerate(sizes) if n is None]
        for i, n in zip(rest, counter.tokens([flat[i] for i in rest]), strict=True):
            sizes[i] = n
        ends = np.concatenate([[0], np.cumsum([len(some) for some in made])]).astype(np.int32)
        fields = pa.StructArray.from_arrays([pa.array(flat, pa.string()), pa.array(sizes, pa.int32())], ["text", "tokens"])
        return pa.ListArray.from_arrays(pa.array(ends), fields)

    small_batches(df.sparkSession)
    return df.withColumn(out, cut(F.col(text_col).cast("string"), F.col(title_col).cast("string")))


def chunks(df: DataFrame, counter: Counter | None = None, text_col: str = "text", title_col: str = "doc_title", id_col: str = "id") -> DataFrame:
    """One row per chunk: the document's columns, with text, chars, tokens, chunk_index, chunk_count, parent_id and a new id."""
    made = chunk_tokens(df, counter, text_col, title_col, "_chunks")
    return lineage(made, "_chunks", id_col, text_col).withColumn("counter", F.lit((counter or ESTIMATE).name))


def lineage(df: DataFrame, chunks_col: str, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Explode an array of chunks (strings, or structs with text and tokens) and say where each comes from."""
    structs = not dict(df.dtypes)[chunks_col].startswith("array<string")
    # not the bare column, for which Spark would add a filter on its size, and make the chunks for that as well (see ``runtime.keep``)
    some = F.when(F.size(chunks_col) > 0, F.col(chunks_col))
    out = df.withColumn("chunk_count", F.size(chunks_col)).select("*", F.posexplode(some).alias("chunk_index", "_chunk"))
    body = F.col("_chunk.text") if structs else F.col("_chunk")
    parent = F.col(id_col).cast("string")
    own = T.content_key(F.concat_ws(":", parent, F.col("chunk_index").cast("string")))
    out = out.withColumn("parent_id", parent).withColumn(text_col, body).withColumn("chars", F.length(body))
    if structs:
        out = out.withColumn("tokens", F.col("_chunk.tokens"))
    return out.withColumn(id_col, own).drop("_chunk", chunks_col)
