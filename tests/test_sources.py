"""Sources, records, chunking and markup on literals."""

import json
import random
import re
import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.functions import markup
from tessera.operators import chunking, records, urls
from tessera.plans import ask
from tessera.sources import files


def values(df, column):
    return [r[column] for r in df.collect()]


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "نص", None)], "id string, text string, page int")
    files.write_jsonl(records.conform(df), str(tmp_path / "o"))
    line = "".join(p.read_text() for p in (tmp_path / "o").glob("part*.json")).strip()
    assert json.loads(line)["page"] is None and "نص" in line
    assert values(files.read_jsonl(spark, str(tmp_path / "o")), "text") == ["نص"]


def test_front_matter(spark):
    cases = [
        ("country: SA\naudience: public\n\nbody\nmore", {"country": "SA", "audience": "public"}, "body\nmore"),
        ("title: two words\ncountry: SA\n\nbody", {}, "title: two words\ncountry: SA\n\nbody"),
        ("country: SA\nnot a key\nbody", {"country": "SA"}, "country: SA\nnot a key\nbody"),
        ("a: x\nb: y", {"a": "x", "b": "y"}, "b: y"),
        ("\nbody", {}, "\nbody"),
        ("a: x\na: y\n\nz", {"a": "y"}, "z"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, raw string").select("i", records.front_matter(F.col("raw")).alias("f"))
    got = {r["i"]: (r["f"]["meta"], r["f"]["body"]) for r in df.collect()}
    assert [got[i] for i in range(len(cases))] == [c[1:] for c in cases]
    wide = spark.createDataFrame([("title: two words\n\nb",)], "raw string").select(records.front_matter(F.col("raw"), True).alias("f")).first()["f"]
    assert wide["meta"] == {"title": "two words"} and wide["body"] == "b"


def test_curated_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b_c-d.md").write_text("country: KW\n\ntext ١٢")
    (tmp_path / "sub" / "a.TXT").write_text("plain")
    (tmp_path / "x.pdf").write_text("no")
    (tmp_path / "blank.md").write_text(" \n")
    got = {r["source_file"]: r for r in records.curated(files.read_curated(spark, str(tmp_path))).collect()}
    assert set(got) == {"facts/b_c-d.md", "facts/sub/a.TXT"}
    r = got["facts/b_c-d.md"]
    assert (r["doc_title"], r["country"], r["audience"], r["curated"]) == ("b c d", "KW", "internal", True) and r["text"] == "b c d\n\ntext 12"
    assert files.read_curated(spark, str(tmp_path / "none")).count() == 0


def test_markdown_tables(spark):
    cells = [("f.pdf", 1, 0, 0, ["a", "b"]), ("f.pdf", 1, 0, 1, ["1"]), ("f.pdf", 1, 0, 2, [None, ""]), ("f.pdf", 1, 1, 0, ["x"])]
    df = spark.createDataFrame(cells, "file string, page int, table_no int, row_no int, cells array<string>")
    assert values(records.table_markdown(df), "text") == ["| a | b |\n| --- | --- |\n| 1 |  |"]
    lines = spark.createDataFrame([("f.pdf", 1, i, t) for i, t in enumerate(["Prices", "", "a long line. " * 3])], "file string, page int, line_no int, raw string")
    got = {r["type"]: r for r in records.extracted(lines, df).collect()}
    # a name of hexadecimal letters alone gives way to the first heading
    assert got["prose"]["doc_title"] == "Prices"
    assert got["table"]["text"].startswith("Prices — Prices\n\n| a | b |") and got["prose"]["confidence"] == "n/a" and got["prose"]["lang"] == "en"


def test_articles_replace_short_bodies(spark):
    items = [("https://h/a", "2024", "<b>T</b>", "short", "posts"), ("https://h/b", "2024", "U", "x" * 250, "faqs"), ("https://h/en/c", "", "V", "x" * 250, "faqs")]
    df = spark.createDataFrame(items, "link string, modified string, title string, content string, wp_type string")
    scraped = spark.createDataFrame([("https://h/a", "")], "link string, body string")
    assert values(records.articles(df, scraped), "link") == ["https://h/b"]
    assert sorted(values(records.articles(df), "text")) == ["T\n\nshort", "U\n\n" + "x" * 250]


def test_select_text(spark):
    html = '<div class="panel-content inner">Share<p>Body  share text</p><br>end</div><div class="post-desc">other</div>'
    df = spark.createDataFrame([(html,), ('<div class="post-desc x">y</div>',), ("<p>z</p>",)], "h string")
    assert values(df.select(markup.select_text([".panel-content.inner", ".post-desc"], "(Share|share)")(F.col("h")).alias("t")), "t") == ["Body text\nend", "y", ""]


def push(s):
    return f"<script>self.__next_f.push([1, {json.dumps(s, ensure_ascii=False)}])</script>"


def plan(name, lang, **fields):
    body = ",".join(f'"{k}":"{v}"' for k, v in fields.items())
    return f'{{{body},"packageName":"{name}","languages_id":{{"name":"{lang}"}}}}' + " " * 2600


def test_payload_and_plans(spark):
    blob = plan("النمو", "ar", packagePriceMonthly="99", packagePriceAnnual="990") + plan("Growth", "en", packagePriceMonthly="99") + plan("حرة", "ar", packagePriceAnnual="مجاناً")
    html = "<html><head><title>A | B</title></head><body><p>" + "word " * 60 + "</p>" + push(blob) + push("a|كلمات عربية كثيرة هنا|b") + push("|كلمات الموقع المشتركة|") + "</body></html>"
    pages = spark.createDataFrame([("https://s/ar/pricing/", html), ("https://s/ar/kuwait/", html)], "url string, html string")
    chrome = spark.createDataFrame([("كلمات الموقع المشتركة",)], "text string")
    got = {(r["url"], r["doc_title"]): r for r in records.market_pages(pages, chrome, plans_title="Prices", plans_header="All plans:").collect()}
    assert set(got) == {("https://s/ar/pricing/", "A"), ("https://s/ar/pricing/", "Prices"), ("https://s/ar/kuwait/", "A")}
    prices = got["https://s/ar/pricing/", "Prices"]["text"].split("\n")
    assert prices[2:] == ["All plans:", "سعر باقة النمو (تكلفة الاشتراك): 99 ريال شهرياً وعند الدفع السنوي 990", "سعر باقة حرة (تكلفة الاشتراك): مجاناً"]
    with pytest.raises(ValueError, match="of one page"):
        records.page_text(pages, chrome.select(F.repeat("text", 300_000).alias("text")))
    page = got["https://s/ar/kuwait/", "A"]
    assert page["country"] == "KW" and "كلمات عربية كثيرة هنا" in page["text"] and "المشتركة" not in page["text"]


def test_a_page_is_measured_with_or_without_its_repeats(spark):
    html = "<h1>T</h1><body>" + "<p>one line of forty characters, about that</p>" * 6 + "</body>"
    pages = spark.createDataFrame([("https://s/a", html)], "url string, html string")
    assert records.market_pages(pages).count() == 0
    (got,) = records.market_pages(pages, repeats_count=True).collect()
    assert got["text"] == "T\n\nT\none line of forty characters, about that" and got["chars"] == len(got["text"])


def test_plans_of_any_nesting():
    """Fields come from the plan, what it holds and what holds it; never from a neighbour."""
    read = lambda blob: [{k: v for k, v in p.items() if v} for p in markup.read_plans(blob)]
    ar, en = ',"languages_id":{"name":"ar"}', ',"languages_id":{"name":"en"}'
    around = '{"packagePriceMonthly":"99","translations":[{"packageName":"X"%s},{"packageName":"Y"%s}]}' % (ar, en)
    assert read(around) == [{"packageName": "X", "packagePriceMonthly": "99"}]
    assert read('{"packageName":"X","packagePriceMonthly":"99","more":[{"a":[{"languages_id":{"id":1,"name":"ar"}}]}]}') == [{"packageName": "X", "packagePriceMonthly": "99"}]
    assert read('[{"totalCost":"1","names":[{"packageName":"A"%s}]},{"names":[{"packageName":"B"%s}],"billingCycle":"b"},{"packageName":"C","totalCost":"3"%s}]' % (ar, ar, ar)) == [
        {"packageName": "A", "totalCost": "1"}, {"packageName": "B", "billingCycle": "b"}, {"packageName": "C", "totalCost": "3"},
    ]
    # nearest first: the plan, what it holds, what is around it; a blank or null is no answer; other objects around lend too
    assert read('{"billingCycle":"far","totalCost":"far","o":{"packageDescription":"beside"},"l":[{"totalCost":"near","p":{"packageName":"N","billingCycle":" ","in":{"billingCycle":"held"},"totalCost":null%s}}]}' % ar) == [
        {"packageName": "N", "billingCycle": "held", "totalCost": "near", "packageDescription": "beside"}
    ]
    # the first of each name; numbers aren't fields; no language, another one, or a blank name give nothing
    twice = '{"packageName":"T","totalCost":"1"%s}{"packageName":"T","totalCost":"2"%s}' % (ar, ar)
    assert read(twice) == [{"packageName": "T", "totalCost": "1"}]
    assert read('{"packageName":"T","totalCost":5%s}' % ar) == [{"packageName": "T"}]
    assert read('{"packageName":"T"}') == read('{"packageName":"T"%s}' % en) == read('{"packageName":" "%s}' % ar) == read("") == []
    # text around objects, stray brackets and quotes, a stream that breaks off
    assert read('3:"]}text "quoted\n}}{"packageName":"a \\" {\\u0041"%s,"totalCost":"9","l":[{"' % ar) == [{"packageName": 'a " {A', "totalCost": "9"}]


@pytest.mark.parametrize("piece", ['{"packageName":"a",', '{"a":[', '" \\"', '\\"', '{"packageName":"a","languages_id":{"name":"ar"}},', "}]", '{"o":{"totalCost":"1"},"l":[{"packageName":"a"}'])
def test_plans_take_linear_time(piece):
    def took(n):
        began = time.process_time()
        markup.read_plans(piece * n)
        return time.process_time() - began

    small = min(took(5_000) for _ in range(3))
    assert took(40_000) < 8 * small * 2.5 + 0.2


def test_bare_price(spark):
    df = spark.createDataFrame([("990 شهري",), ("كلمة990 شهري",), ("١٢٣ شهري",), ("990 شهري USD",)], "t string")
    assert values(df.select(records.not_local(F.col("t"), F.lit("KW")).alias("x")), "x") == [True, False, True, False]


def test_main_before_body(spark):
    long = "m" * 250
    cases = [f"<body><header>h</header><main><nav>n</nav><header>keep</header>{long}</main><p>out</p></body>", "<body><header>h</header><main></main><p>in &amp;lt; x</p></body>"]
    df = spark.createDataFrame([(c,) for c in cases], "h string").select(markup.body_lines(F.col("h")).alias("l"))
    assert values(df, "l") == [["keep", long], ["in &lt; x"]]


def test_collapse(spark):
    df = spark.createDataFrame([(list("AABA"),), (list("ABABAB"),), (list("ABCABCD"),)], "l array<string>")
    got = df.select(markup.collapse_blocks(markup.drop_adjacent(F.col("l"))).alias("x"))
    assert values(got, "x") == [list("ABA"), list("ABAB"), list("ABCD")]
    # the longest block first, then on by one line: the repeat after it is seen from the next place
    longer = spark.createDataFrame([(list("ABCABCABC"),), (list("XABABABAB"),), (None,), ([],)], "l array<string>").select(markup.collapse_blocks(F.col("l")).alias("x"))
    assert values(longer, "x") == [list("ABCABC"), list("XABAB"), None, []]


def test_collapse_of_many_rows_keeps_to_each(spark):
    """Rows of a batch share a dictionary and go by slices; nulls stay, of lines too."""
    rows = [(i, None if i % 7 == 0 else [] if i % 7 == 1 else [str(i), "b", str(i), "b", *([None, "x"] * 2), "c"]) for i in range(700)]
    df = spark.createDataFrame(rows, "i int, l array<string>").coalesce(1)
    got = {r["i"]: r["x"] for r in df.select("i", markup._collapse(F.col("l")).alias("x")).collect()}
    assert got == {i: x and [str(i), "b", None, "x", "c"] for i, x in rows}


def test_collapse_is_linear_and_exact():
    def restated(x):
        i = 0
        while i < len(x):
            for n in range(12, 1, -1):
                if x[i : i + n] == x[i + n : i + 2 * n] and len(x[i + n : i + 2 * n]) == n:
                    x = x[: i + n] + x[i + 2 * n :]
                    break
            i += 1
        return x

    rnd = random.Random(6)
    for _ in range(500):
        unit = [rnd.randrange(3) for _ in range(rnd.randrange(1, 14))]
        codes = [c for _ in range(rnd.randrange(6)) for c in (unit if rnd.random() < 0.7 else [rnd.randrange(3)])]
        assert [codes[i] for i in markup._kept(codes)] == restated(codes)

    def took(n):
        began = time.process_time()
        markup._kept([1, 2, 3, 1, 2, 3, 4] * n)
        return time.process_time() - began

    assert took(16_000) < 8 * min(took(2_000) for _ in range(3)) * 2.5 + 0.2


def test_urls(spark):
    df = spark.createDataFrame([("https://s/ar/kuwait/",), ("https://s/ar/pricing",), ("https://s/ar/testing/",)], "url string")
    assert values(df.select(urls.country(F.col("url")).alias("c")), "c") == ["KW", "SA", "SA"]
    assert values(df.where(urls.wanted(F.col("url"))).select(urls.canonical(F.col("url")).alias("u")), "u") == ["https://s/ar/kuwait/", "https://s/ar/pricing/"]
    xml = spark.createDataFrame([("<loc>https://s/ar/a</loc><loc>https://s/en/b</loc><loc>https://s/ar/a/</loc>",)], "xml string")
    found, source = urls.page_urls(xml, lambda: df)
    assert values(found, "url") == ["https://s/ar/a/"] and source == "sitemap"
    found, source = urls.page_urls(xml.where("false"), lambda: df)
    assert source == "link crawl" and found.count() == 2


def test_crawl(spark):
    link = lambda *x: "".join(f'<a href="{p}">' for p in x)
    pages = spark.createDataFrame([("s/a", link("/b", "/c")), ("s/b", link("/d", "/a")), ("s/d", link("/e"))], "url string, html string")
    got = {r["url"]: r["hop"] for r in urls.crawl(pages, ["s/a"], "s").collect()}
    assert got == {"s/a": 0, "s/b": 1, "s/c": 1, "s/d": 2}


def test_fetch_isolates_failures(spark):
    def get(url):
        if url == "bad":
            raise RuntimeError("HTTP 404")
        return "<p>x</p>"

    pages = files.fetch(spark.createDataFrame([("ok",), ("bad",)], "url string"), get)
    rows = spark.createDataFrame([("ok",)], "source_file string")
    assert {r["url"]: r["state"] for r in files.fetch_report(pages, rows).collect()} == {"ok": "ok", "bad": "error"}


def test_listing(spark):
    def get_page(kind, page):
        return [{"link": f"{kind}/{page}", "title": "t"}] if page < 3 else None

    got = files.read_listing(spark, ["posts", "faqs"], get_page)
    assert sorted(values(got, "link")) == ["faqs/1", "faqs/2", "posts/1", "posts/2"]


def restated_chunk_chars(text, target, least):
    chunks, cur, heading = [], [], ""
    for line in text.split("\n"):
        if not cur and len(line) <= 80 and not line.rstrip().endswith((".", "،", ":")) and len(line.split()) <= 10:
            heading = line
        cur.append(line)
        if sum(map(len, cur)) >= target:
            chunks.append("\n".join(cur))
            cur = [heading] if heading else []
    if cur and (sum(map(len, cur)) >= least or not chunks):
        chunks.append("\n".join(cur))
    elif cur:
        chunks[-1] += "\n" + "\n".join(cur)
    return chunks


def test_chunk_chars(spark):
    docs = ["", "Head\n" + "x" * 50 + ".\n" + "y" * 50 + ".\nshort", "a.\n" * 30, "H1\nlong line number one.\nH2\nlong line number two.\n" * 4]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, t string").select("i", chunking.chunk_chars(F.col("t"), 60, 20).alias("c"))
    assert {r["i"]: r["c"] for r in df.collect()} == {i: restated_chunk_chars(d, 60, 20) for i, d in enumerate(docs)}


def test_blocks(spark):
    df = spark.createDataFrame([("a\nb\n\n | x |\n| y |\nc\n\n\n|z|",)], "t string").select(chunking.blocks(F.col("t")).alias("b"))
    assert values(df, "b") == [["a\nb", " | x |\n| y |", "c", "|z|"]]


def packed(spark, texts, title, counter=None):
    df = spark.createDataFrame([("d", title, "\n\n".join(texts))], "id string, doc_title string, text string")
    return [r["text"] for r in chunking.chunks(df, counter).orderBy("chunk_index").collect()]


def test_chunks_by_words(spark):
    count = chunking.by_words()
    table = "| " + "c " * 900
    got = packed(spark, ["Heading one", "w " * 300, "v " * 300, table, "u " * 1500, "tail"], "Title", count)
    assert all(c.startswith("Title") for c in got) and any(table.strip() in c for c in got)
    # the table stays whole; the long block is cut at 699 words beside the title's one, and the small tail joins it
    assert [len(c.split()) for c in got if "u u" in c] == [700, 700, 104]
    assert got[1] == "Title\n\nHeading one\n\n" + ("v " * 300).strip()
    assert packed(spark, [], "T", count) == []
    assert packed(spark, ["Only", "body " * 60], None, count) == ["Only\n\n" + ("body " * 60).strip()]


def test_chunks_by_the_estimate(spark):
    tokens = lambda t: -(-(250 * len(t) + 45 * len(re.findall("[\u0600-\u06ff]", t))) // 1000)
    sentence = "متجر " * 40 + "words and more. "
    texts = ["Heading", sentence * 3, sentence * 4, "Next heading", sentence * 40, "x" * 9000, "small"]
    got = packed(spark, texts, "Title")
    assert all(c.startswith("Title\n\n") for c in got) and max(map(tokens, got)) <= chunking.MOST_TOKENS + chunking.LEAST_TOKENS
    bare = lambda t: re.sub(r"\s+", "", t)
    whole = bare("".join(c.removeprefix("Title\n\n") for c in got))
    for t in ("Heading", "Nextheading"):
        whole = whole.replace(t, "")
    assert whole == bare("".join(texts)).replace("Heading", "").replace("Nextheading", "")
    assert got[-1].endswith("small") and "x" * 2000 in "".join(got)


def restated_chunk_tokens(text, title, count, cut, target, most, least):
    """The rules block by block, with every candidate joined and counted anew."""
    prefix = f"{title}\n\n" if title else ""
    soft, hard = target - count(prefix), max(1, most - count(prefix))
    table = lambda b: re.match(r"\s*\|", b)
    heads = lambda b: 0 < len(b.strip()) <= 80 and not b.strip().endswith((".", "،", ":", "؛")) and len(b.split()) <= 10
    blocks, cur, was = [], [], False
    for line in [*text.split("\n"), ""]:
        own = bool(table(line))
        if cur and (own != was or not line.strip()):
            blocks.append("\n".join(cur))
            cur = []
        cur += [line] if line.strip() else []
        was = own
    chunks, cur, heading = [], [], ""
    for b in blocks:
        if count(b) > hard and not table(b):
            chunks += ["\n\n".join(cur)] if cur else []
            cur, held = [], []
            for s in filter(str.strip, re.split(r"(?<=[.؟!])\s+|\n", b)):
                if held and count(" ".join([*held, s])) > hard:
                    chunks += cut(" ".join(held), hard) if count(" ".join(held)) > hard else [" ".join(held)]
                    held = []
                held.append(s)
            chunks += cut(" ".join(held), hard) if count(" ".join(held)) > hard else [" ".join(held)]
            continue
        heading = b if heads(b) else heading
        if cur and count("\n\n".join([*cur, b])) > soft:
            chunks.append("\n\n".join(cur))
            cur = [heading] if heading and heading != b else []
        cur.append(b)
    chunks += ["\n\n".join(cur)] if cur else []
    out = []
    for c in filter(None, map(str.strip, chunks)):
        if out and count(c) < least:
            out[-1] += "\n\n" + c
        else:
            out.append(c)
    while len(out) > 1 and count(out[0]) < least:
        out[:2] = ["\n\n".join(out[:2])]
    return [c if c.startswith(title) else prefix + c for c in out]


def random_texts(n):
    rnd = random.Random(2)
    sentence = lambda: " ".join(rnd.choice(["a", "bb", "متجر", "word", "c|d"]) for _ in range(rnd.choice([1, 3, 9, 40]))) + rnd.choice([".", "؟", "!", "", ":"])
    block = lambda: rnd.choice([" ", "\n"]).join(sentence() for _ in range(rnd.choice([1, 1, 2, 12])))
    table = lambda: "\n".join("| x " * rnd.choice([1, 30]) + "|" for _ in range(rnd.choice([1, 4])))
    return [rnd.choice(["", "\n"]).join(rnd.choice([block, block, block, table])() + rnd.choice(["\n", "\n\n", "\n \n\n"]) for _ in range(rnd.choice([0, 1, 5, 30]))) for _ in range(n)]


def test_running_totals_give_what_counting_anew_gives():
    count = chunking.by_words()
    for i, text in enumerate(random_texts(400)):
        for title in ("", "T", "two words here"):
            args = (30 + i % 20, 50, 1 + i % 12)
            assert chunking.split_text(text, title, count, *args) == restated_chunk_tokens(text, title, lambda t: count.tokens([t])[0], count.cut, *args)


def test_chunks_by_a_vocabulary(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, texts = Tokenizer.from_file(path), [t * 8 for t in random_texts(60)]
    df = spark.createDataFrame([(str(i), "A title", t) for i, t in enumerate([*texts, None])], "id string, doc_title string, text string")
    got = chunking.chunks(df, chunking.vocabulary(path)).collect()
    assert all(r["tokens"] == len(lib.encode(r["text"], add_special_tokens=False).ids) and r["counter"] == "vocabulary" for r in got)
    n = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    split = chunking.vocabulary(path)
    for i in range(0, 60, 4):
        mine = [r["text"] for r in sorted((r for r in got if r["parent_id"] == str(i)), key=lambda r: r["chunk_index"])]
        assert mine == chunking.split_text(texts[i], "A title", split)
        # counts of parts in a row add up but for white space before a cut, so chunks stay within a few tokens of the limit
        assert all(r["tokens"] <= chunking.MOST_TOKENS + chunking.LEAST_TOKENS + 16 for r in got if "|" not in r["text"])
        whole = restated_chunk_tokens(texts[i], "A title", n, split.cut, 450, 700, 40)
        assert abs(len(mine) - len(whole)) <= 1 + len(whole) // 20


@pytest.mark.parametrize("text", ["word\n\n", "some words in a sentence. ", "x", "| t |\n\n", "A heading\n\n" + "w " * 300 + "\n\n"])
def test_chunking_takes_linear_time(text):
    def took(n):
        began = time.process_time()
        chunking.split_text(text * n, "Title", chunking.ESTIMATE)
        return time.process_time() - began

    n = 200_000 // len(text)
    assert took(8 * n) < 8 * min(took(n) for _ in range(3)) * 2.5 + 0.3


def test_chunks_and_answers(spark):
    docs = spark.createDataFrame([("d1", "facts/a", "Alpha", "alpha words here.\n\nmore alpha"), ("d2", "facts/b", "Beta", "beta only")], "id string, source_file string, doc_title string, text string")
    corpus = ask.build_corpus(docs)
    assert sorted(values(corpus, "ord")) == [0, 1] and set(values(corpus, "chunk_count")) == {1}
    questions = spark.createDataFrame([(0, "alpha"), (1, "zeta")], "query_id long, question string")
    got = {r["query_id"]: r for r in ask.ask(corpus, questions, lambda prompt: "Yes [1]\n[[ANSWERED]]").collect()}
    assert got[0]["answer"] == "Yes [1]" and got[0]["citations"][0]["url"] == "facts/a"
    assert not got[1]["answered"]
    # a vector for each question, made once for each text; blank questions aren't asked, and an empty corpus is an error
    vectors = corpus.select("ord", F.when(F.col("doc_title") == "Beta", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).cast("array<float>").alias("embedding"))
    more = spark.createDataFrame([(0, "zeta"), (1, "zeta"), (2, "  "), (3, None)], "query_id long, question string")
    got = {r["query_id"]: r for r in ask.ask(corpus, more, lambda prompt: "See [1]\n[[ANSWERED]]", vectors, embed_fn=lambda texts: [[1.0, 0.0] for _ in texts]).collect()}
    assert [got[i]["answered"] for i in range(4)] == [True, True, False, False] and got[1]["citations"][0]["title"] == "Beta"
    with pytest.raises(ValueError, match="empty"):
        ask.ask(corpus.limit(0), more, lambda prompt: "")


def test_stream_keeps_new_texts(spark, tmp_path):
    from tessera.streaming.ingest import follow

    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for i, texts in enumerate((["a", "b"], ["b", "c"])):
        (src / f"{i}.json").write_text("".join(json.dumps({"id": t, "text": t}) + "\n" for t in texts))
        follow(spark, str(src), out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(values(spark.read.parquet(out), "text")) == ["a", "b", "c"]


def test_vocabulary_counts_are_the_librarys():
    import random

    path = public_tokenizers.path("byte_bpe_50k.json")
    pick, drawn = list("abc AB  \n\t\r'sdmtrevl.,!-_12٠²½Ⅷé́ـضن中😀𝒜𝟙\x85\xa0\u3000\x1c\x00ǅªʰ") + ["'re", "'ll", "<|endoftext|>", "\n\n", " the"], random.Random(1)
    texts = ["", " ", "x" * 500 + " " + "y" * 70] + ["".join(drawn.choice(pick) for _ in range(drawn.randrange(40))) for _ in range(3000)]
    calls, library = [], chunking._lengths
    try:
        chunking._lengths = lambda p, t: calls.append(len(t)) or library(p, t)
        for i in range(0, len(texts), 500):
            assert chunking._vocabulary_counts(path, texts[i : i + 500]) == library(path, texts[i : i + 500])
        calls.clear()
        chunking._vocabulary_counts(path, ["the same words again", "the same words"])
        chunking._vocabulary_counts(path, ["the same words again"] * 100)
        assert sum(calls) == 4  # each pre-token once
    finally:
        chunking._lengths = library


def test_counts_of_chunks_are_those_of_their_parts():
    """What is added up equals what the library counts, also behind white space, with odd ends and special strings."""
    import random

    path = public_tokenizers.path("byte_bpe_50k.json")
    pick, drawn = list("abc AB  \r'sdt.,!-12²Ⅷé́中😀𝒜𝟙\x85\xa0　\x1c") + [". ", "\n", "\n", "\n\n", "'re", "<|endoftext|>", " the words here", "| t |\n", "W" * 70], random.Random(2)
    make = lambda n: "".join(drawn.choice(pick) for _ in range(drawn.randrange(n)))
    texts, count = [make(30) for _ in range(2000)], chunking.vocabulary(path)
    alone = count.counts(texts)
    for lead in (" ", chunking.GAP):
        assert count.behind(lead, texts, alone) == chunking._lengths(path, [lead + t for t in texts])
    sure = 0
    for i in range(300):
        title = ("", "T", "two words ", "it's", " x", "<|endoftext|>")[i % 6]
        made = chunking._split(make(600), title, count, 30 + i % 20, 50, 1 + i % 12)
        assert [n for _, n in made if n is not None] == [k for k, (_, n) in zip(chunking._lengths(path, [c for c, _ in made]), made, strict=True) if n is not None]
        sure += sum(n is not None for _, n in made)
    assert sure > 300


def test_counting_a_text_makes_its_pre_tokens_once():
    path, calls = public_tokenizers.path("byte_bpe_50k.json"), []
    real = chunking.pretokens
    try:
        chunking.pretokens = lambda t: calls.append(len(t)) or real(t)
        text = "\n\n".join(f"Paragraph {i} of some words" for i in range(200))
        assert len(chunking._split(text, "Title", chunking.vocabulary(path), 450, 700, 40)) > 2
        assert sum(calls) < len(text) * 1.1
    finally:
        chunking.pretokens = real


def test_documents_are_chunked_once_and_by_all_tasks(spark):
    from tessera import catalog

    plan = catalog.QUERIES["chunk_vocabulary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("Repartition") and "Filter" not in plan
