"""Document records of each kind of source."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import arabic, markup
from tessera.functions import text as T
from tessera.operators import urls
from tessera.operators.chunking import chunk_chars
from tessera.runtime import keep

#: Fields of a document, in order; sources without a field have null there.
DOCUMENT = (
    "id string, source_file string, doc_title string, page int, type string, wp_type string, lang string, audience string, country string, "
    "confidence string, curated boolean, competitive boolean, pricing_not_local boolean, modified string, content_hash string, chars int, text string"
)
COMPETITIVE = "/switchers"
# A bare price, currencies that are named, and (below) the lines of front matter.
BARE_PRICE = r"(?U)\b\d{2,5}\s*(?:تدفع|/\s*شهر|شهري|سنوي)"
LOCAL_CURRENCY = r"(جنيه|درهم|دينار|ريال عماني|\$|USD|EGP|AED|KWD|OMR)"
LEAST_BODY = 200
#: Bytes of strings that all pages share.
CHROME_BYTES = 8 << 20
FRONT_MATTER, FRONT_MATTER_SPACES = r"^([a-z_]+):\s*(\S+)\s*$", r"^([a-z_]+):\s*(\S.*?)\s*$"


def conform(df: DataFrame) -> DataFrame:
    """All fields of a document, null where ``df`` lacks them."""
    kinds = dict(f.strip().split(" ") for f in DOCUMENT.split(","))
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])


def union(*sources: DataFrame) -> DataFrame:
    """Documents of all sources, duplicates included, with source_ord in the order given."""
    out = None
    for i, s in enumerate(sources):
        s = conform(s).withColumn("source_ord", F.lit(i))
        out = s if out is None else out.unionByName(s)
    return out


def not_local(text: Column, country: Column, home: str = "SA", price: str = BARE_PRICE, currency: str = LOCAL_CURRENCY) -> Column:
    """A page of another market shows a price without naming its currency."""
    return (country != home) & text.rlike(price) & ~text.rlike(currency)


def _finish(df: DataFrame, three_way: bool = False) -> DataFrame:
    return df.withColumns({"lang": T.lang_label(F.col("text"), three_way), "chars": F.length("text")})


def prose_pages(lines: DataFrame) -> DataFrame:
    """(file, page, line_no, raw) -> file, page, text: lines normalised, in reading order, without empty ones and pages."""
    fixed = lines.withColumn("_l", T.normalize(F.col("raw"))).where("_l <> ''")
    fixed = fixed.select("file", "page", "line_no", arabic.fix_word_order(F.col("_l"))["text"].alias("_l"))
    grouped = fixed.groupBy("file", "page").agg(F.sort_array(F.collect_list(F.struct("line_no", "_l"))).alias("_a"))
    return grouped.select("file", "page", F.array_join(F.transform("_a", lambda s: s["_l"]), "\n").alias("text"))


#: Cells, with U+0001 between, that cleaning might change: other characters than printing ASCII, spaces in a row or at an end.
_UNCLEAN = r"[^\x{20}-\x{7E}\x{1}]|  |(?:^|\x{1}) | (?:$|\x{1})"


def table_markdown(cells: DataFrame) -> DataFrame:
    """(file, page, table_no, row_no, cells) -> file, page, table_no, text: tables of two rows or more as Markdown."""
    grouped = cells.groupBy("file", "page", "table_no").agg(F.sort_array(F.collect_list(F.struct("row_no", "cells"))).alias("rows"))
    return markdown(grouped)


def markdown(tables: DataFrame) -> DataFrame:
    """(file, page, table_no, rows (row_no, cells)) -> the same as ``table_markdown``, rows in the order given, without a shuffle."""
    start = F.col("rows").getField("cells")
    # NFKC for all cells of a table in one call, and only for tables that it may change
    shown = F.array_join(F.flatten(start), "\x01", "\x02")
    unclean = tables.withColumn("_unclean", F.coalesce(shown.rlike(_UNCLEAN), F.lit(True))).withColumn("_n", T.nfkc_lists(F.when(F.col("_unclean"), start)))
    clean = lambda c: T.strip(arabic.fix_char_order(F.replace(T.tidy(F.coalesce(c, F.lit(""))), F.lit("\n"), F.lit(" ")))["text"])
    number = F.col("rows").getField("row_no")
    cleaned = F.zip_with(number, F.transform("_n", lambda r: F.transform(r, clean)), lambda n, r: F.struct(n.alias("row_no"), r.alias("cells")))
    rows = F.when(F.col("_unclean"), cleaned).otherwise(F.col("rows"))
    kinds = ", ".join(f"{c} {tables.schema[c].dataType.simpleString()}" for c in ("file", "page", "table_no"))
    return unclean.select("file", "page", "table_no", rows.alias("rows")).mapInArrow(_rendered, f"{kinds}, text string")


def _rendered(batches):
    """Rows of tables as Markdown, by whole arrays."""
    show = lambda cells: pc.binary_join_element_wise("| ", pc.binary_join(cells, " | "), " |", "")
    lists = lambda sizes, of: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), of)
    for batch in batches:
        rows = batch.column(3)
        table = np.repeat(np.arange(len(rows)), pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False))
        cells = rows.flatten().field("cells")
        size = pc.fill_null(pc.list_value_length(cells), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        text = cells.flatten()
        said = np.append(0, np.cumsum(pc.fill_null(pc.not_equal(text, ""), False).to_numpy(zero_copy_only=False)))
        end = np.cumsum(size)
        full = said[end] > said[end - size]
        # only tables of two rows or more that have a word
        full &= (np.bincount(table[full], minlength=len(rows)) >= 2)[table]
        at = np.flatnonzero(full)
        if not len(at):
            continue
        own, first, begin = table[at], (end - size)[at], np.flatnonzero(np.append(True, table[at][1:] != table[at][:-1]))
        width = np.maximum.reduceat(size[at], begin)
        wide = np.repeat(width, np.diff(np.append(begin, len(at))))
        # the empty text, which stands last, fills a row up
        place = np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide, wide)
        take = np.where(place < np.repeat(size[at], wide), np.repeat(first, wide) + place, len(text))
        lines = show(lists(wide, pa.concat_arrays([text, pa.array([""], text.type)]).take(pa.array(take))))
        rules = show(lists(width, pa.array(["---"] * int(width.sum()), text.type)))
        # a rule stands behind the first line
        order = np.insert(np.arange(len(at)), begin + 1, len(at) + np.arange(len(begin)))
        whole = pc.binary_join(lists(np.diff(np.append(begin, len(at))) + 1, pa.concat_arrays([lines, rules]).take(pa.array(order))), "\n")
        keys = batch.select([0, 1, 2]).take(pa.array(own[begin]))
        yield pa.RecordBatch.from_arrays([*keys.columns, whole], names=["file", "page", "table_no", "text"])


def extracted(lines: DataFrame, cells: DataFrame) -> DataFrame:
    """Records of extracted files: prose chunks, and tables captioned by title and page headings. Titles come from names."""
    pages = prose_pages(lines)
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    first = pages.groupBy("file").agg(F.min_by("text", "page").alias("_first"))
    files = lines.select("file").union(cells.select("file")).distinct().join(first, "file", "left")
    titles = files.select("file", T.title_or_first_heading(T.file_title(stem), F.coalesce("_first", F.lit(""))).alias("doc_title"))
    prose = pages.select("file", "page", F.posexplode(chunk_chars(F.col("text"))).alias("part", "text")).withColumn("type", F.lit("prose"))
    context = pages.select("file", "page", T.page_context(F.col("text")).alias("_context"))
    tables = table_markdown(cells).join(context, ["file", "page"], "left").join(titles, "file")
    caption = F.array_join(F.filter(F.array("doc_title", F.coalesce("_context", F.lit(""))), lambda s: s != ""), " — ")
    body = F.when(caption != "", F.concat(caption, F.lit("\n\n"), F.col("text"))).otherwise(F.col("text"))
    tables = tables.select("file", "page", F.col("table_no").alias("part"), body.alias("text"), F.lit("table").alias("type"))
    out = prose.select("file", "page", "part", "text", "type").unionByName(tables).join(titles, "file")
    out = out.withColumns({"id": T.content_key(F.col("text")), "source_file": F.col("file"), "audience": F.lit("internal"), "confidence": arabic.confidence(F.col("text"))})
    return _finish(out, True)


def articles(items: DataFrame, scraped: DataFrame | None = None) -> DataFrame:
    """(id, link, modified, title, content, wp_type) with rendered HTML -> records.

    A body of fewer than LEAST_BODY characters is replaced by that of ``scraped`` (link, body), even an empty one, and
    records without a body go.
    """
    rows = items.where(~F.contains(F.col("link"), F.lit("/en/")))
    rows = rows.withColumns({"doc_title": markup.html_text(F.col("title")), "_body": markup.html_text(F.col("content"))})
    if scraped is not None:
        rows = rows.join(scraped.select("link", F.col("body").alias("_scraped")), "link", "left")
        rows = rows.withColumn("_body", F.when(F.length("_body") < LEAST_BODY, F.coalesce("_scraped", F.lit(""))).otherwise(F.col("_body")))
    rows = rows.where(T.strip(F.col("_body")) != "").withColumn("text", T.normalize(F.concat_ws("\n\n", "doc_title", "_body")))
    rows = rows.withColumns(
        {"id": T.content_key(F.col("link")), "source_file": F.col("link"), "type": F.lit("article"), "audience": F.lit("internal"), "confidence": F.lit("high"), "content_hash": T.content_key(F.col("text"))}
    )
    return _finish(rows)


def market_pages(
    pages: DataFrame,
    chrome: DataFrame | None = None,
    countries: Mapping[str, str] = urls.COUNTRIES,
    home: str = "SA",
    plans_title: str = "",
    plans_header: str = "",
    repeats_count: bool = False,
) -> DataFrame:
    """(url, html) -> records, and one more for the prices of home-market pages that carry plans.

    chrome: strings (text) that every page carries; they are not content. A page needs a text of LEAST_BODY characters: of
    its body, or, if ``repeats_count``, of its body before repeated lines and blocks are dropped.
    """
    rows = keep(page_text(pages, chrome, plans_header), F.col("_whole" if repeats_count else "_chars") >= LEAST_BODY)
    rows = rows.withColumns({"country": urls.country(F.col("url"), countries, home), "doc_title": markup.page_title(F.col("html"), F.col("url"))})
    page = F.struct(F.lit("").alias("suffix"), F.col("doc_title").alias("title"), F.col("body").alias("body"))
    price = F.when((F.col("country") == home) & (F.col("_plans") != ""), F.struct(F.lit("#pricing").alias("suffix"), F.lit(plans_title).alias("title"), F.col("_plans").alias("body")))
    rows = rows.withColumn("_r", F.explode(F.array_compact(F.array(page, price))))
    rows = rows.withColumns({"doc_title": F.col("_r.title"), "text": T.normalize(F.concat_ws("\n\n", "_r.title", "_r.body"))})
    rows = rows.withColumns(
        {
            "id": T.content_key(F.concat("url", "_r.suffix")),
            "source_file": F.col("url"),
            "type": F.lit("marketing"),
            "audience": F.lit("internal"),
            "confidence": F.lit("high"),
            "competitive": F.col("url").rlike(COMPETITIVE),
            "pricing_not_local": not_local(F.col("text"), F.col("country"), home),
            "content_hash": T.content_key(F.col("text")),
        }
    )
    return _finish(rows)


def page_text(pages: DataFrame, chrome: DataFrame | None = None, plans_header: str = "") -> DataFrame:
    """Add body (text of a page: markup, plans, payload strings that are not chrome), its length, that before repeats go, and _plans."""
    blob = markup.payload(F.col("html"))
    rows = pages.withColumn("_p", markup.plans(blob))
    sold = F.array_join(F.transform("_p", markup.plan_line), "\n")
    header = F.lit(plans_header + "\n") if plans_header else F.lit("")
    rows = rows.withColumn("_plans", F.when(F.size("_p") > 0, F.concat(header, sold)).otherwise(F.lit("")))
    rows = rows.withColumn("_lines", markup.body_lines(F.col("html")))
    rows = rows.withColumn("_lines", F.when(F.col("_plans") != "", F.concat("_lines", F.split("_plans", "\n"))).otherwise(F.col("_lines")))
    rows = rows.withColumn("_extra", F.array_except(markup.payload_strings(F.col("html")), F.col("_lines")))
    if chrome is not None:
        # one row with the strings of one page, which goes to all tasks; its size is checked
        size = chrome.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        if size > CHROME_BYTES:
            raise ValueError(f"chrome holds {size} bytes of strings; it should be those of one page")
        shared = chrome.agg(F.collect_set("text").alias("_chrome")).withColumn("_1", F.lit(1))
        rows = rows.withColumn("_1", F.lit(1)).join(F.broadcast(shared), "_1").drop("_1").withColumn("_extra", F.array_except("_extra", "_chrome")).drop("_chrome")
    whole = F.concat("_lines", "_extra")
    # each step in a column of its own, which is made once however often the next one mentions it
    rows = rows.withColumn("_all", whole).withColumn("_whole", F.length(F.array_join("_all", "\n"))).withColumn("_once", markup.drop_adjacent(F.col("_all")))
    rows = rows.withColumn("body", F.array_join(markup.collapse_blocks(F.col("_once")), "\n"))
    return rows.withColumn("_chars", F.length("body")).drop("_p", "_lines", "_extra", "_all", "_once")


def front_matter(raw: Column, allow_spaces: bool = False) -> Column:
    """Leading ``key: value`` lines, ended by a blank line -> struct(meta, body).

    A line that does not fit ends the reading and brings the whole text back as body; keys read before it stay.
    Without any key the body is the whole text. If no blank line comes, the last key's line stays in the body.
    """
    pattern = FRONT_MATTER_SPACES if allow_spaces else FRONT_MATTER
    split = F.split(F.regexp_replace(raw, r"(?:\r\n|[\n\r\x0B\x0C\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}])$", ""), r"\r\n|[\n\r\x0B\x0C\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]")
    keys = "map<string,string>"
    start = F.struct(F.create_map().cast(keys).alias("meta"), F.lit(0).alias("index"), F.lit(0).alias("at"), F.lit(False).alias("done"))

    def step(a, line):
        blank, fits = T.strip(line) == "", line.rlike(pattern)
        pair = F.create_map(F.regexp_extract(line, pattern, 1), F.regexp_extract(line, pattern, 2))
        old = F.map_filter(a["meta"], lambda k, v: k != F.regexp_extract(line, pattern, 1))
        meta = F.when(~blank & fits, F.map_concat(old, pair)).otherwise(a["meta"])
        index = F.when(blank, a["at"] + 1).when(fits, a["at"]).otherwise(F.lit(0))
        new = F.struct(meta.alias("meta"), index.alias("index"), (a["at"] + 1).alias("at"), (blank | ~fits).alias("done"))
        return F.when(a["done"], a).otherwise(new)

    read = F.aggregate(split, start, step)
    body = F.array_join(F.slice(split, read["index"] + 1, F.greatest(F.size(split), F.lit(1))), "\n")
    return F.struct(read["meta"].alias("meta"), F.when(F.size(F.map_keys(read["meta"])) > 0, body).otherwise(raw).alias("body"))


def curated(files: DataFrame, allow_spaces: bool = False, folder: str = "facts/") -> DataFrame:
    """(rel_path, raw) -> records; front matter may set title, audience and country. Blank files give none."""
    rows = files.withColumn("_raw", T.strip(F.col("raw"))).where("_raw <> ''").withColumn("_f", front_matter(F.col("_raw"), allow_spaces))
    meta = lambda k: F.col("_f.meta").getItem(k)
    stem = F.regexp_replace(F.substring_index("rel_path", "/", -1), r"(?<=.)\.[^.]*$", "")
    rows = rows.withColumn("doc_title", F.coalesce(meta("title"), F.translate(stem, "_-", "  ")))
    rows = rows.withColumn("text", T.normalize(F.concat_ws("\n\n", "doc_title", "_f.body")))
    rows = rows.withColumns(
        {
            "id": T.content_key(F.col("rel_path")),
            "source_file": F.concat(F.lit(folder), "rel_path"),
            "type": F.lit("curated"),
            "audience": F.coalesce(meta("audience"), F.lit("internal")),
            "country": meta("country"),
            "curated": F.lit(True),
            "confidence": F.lit("high"),
            "content_hash": T.content_key(F.col("text")),
        }
    )
    return _finish(rows)
