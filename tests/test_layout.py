"""Words with places become lines and cells; SQL functions give what Columns give."""

from pyspark.sql import functions as F

from tessera import catalog
from tessera.functions import sql
from tessera.functions import text as T
from tessera.operators import chunking, layout, records

WORDS = "file string, page int, x0 double, x1 double, y double, word string"


def line(page, y, *words):
    return [("f.pdf", page, float(x), float(x + 8 * len(w)), float(y), w) for x, w in words]


def read(spark, rows, **kw):
    df = layout.placed(spark.createDataFrame(rows, WORDS).repartition(3), **kw)
    lines = {(r["page"], r["line_no"]): r["raw"] for r in layout.prose(df).collect()}
    cells = {(r["page"], r["table_no"], r["row_no"]): r["cells"] for r in layout.tables(df).collect()}
    return lines, cells, df


def test_lines_and_tables(spark):
    rows = line(1, 50, (10, "A"), (24, "title"))
    rows += line(1, 80, (10, "Plan"), (100, "Price"), (200, "Note")) + line(1, 91, (10, "Free"), (104, "0"), (202, "for"), (228, "all")) + line(1, 102, (10, "Pro"), (40, "plan"), (210, "x"))
    rows += line(1, 140, (10, "after"), (52, "the"), (78, "table")) + line(1, 151, (10, "next"), (44, "line"))
    rows += line(1, 200, (10, "k"), (100, "v")) + line(1, 209, (10, "l"), (100, "w")) + line(2, 20, (5, "other"), (47, "page"))
    rows[3] = (*rows[3][:4], rows[3][4] + 2.0, rows[3][5])  # a little lower than its line
    lines, cells, df = read(spark, rows)
    assert lines == {(1, 0): "A title", (1, 1): "after the table", (1, 2): "next line", (2, 0): "other page"}
    assert list(cells.values()) and {k[:2] for k in cells} == {(1, 0), (1, 1)}
    assert [cells[k] for k in sorted(cells)] == [["Plan", "Price", "Note"], ["Free", "0", "for all"], ["Pro plan", "", "x"], ["k", "v"], ["l", "w"]]
    markdown = {r["table_no"]: r["text"] for r in records.table_markdown(layout.tables(df)).collect()}
    assert markdown[0] == "| Plan | Price | Note |\n| --- | --- | --- |\n| Free | 0 | for all |\n| Pro plan |  | x |"
    got = {(r["type"], r["text"]) for r in records.extracted(layout.prose(df), layout.tables(df)).collect()}
    assert ("prose", "other page") in got and any(t == "table" and "| k | v |" in x for t, x in got)


def test_odd_words(spark):
    rows = [("f", 1, None, 1.0, 1.0, "gone"), ("f", 1, 1.0, 2.0, None, "gone"), ("f", 1, 1.0, 2.0, 5.0, " "), ("f", 1, 1.0, 2.0, 5.0, None), ("f", 1, 3.0, 4.0, 5.0, "twice"), ("f", 1, 3.0, 4.0, 5.0, "twice")]
    assert read(spark, rows)[:2] == ({(1, 0): "twice twice"}, {})
    assert read(spark, [])[:2] == ({}, {})
    # gaps are settings
    assert read(spark, line(1, 1, (0, "a"), (30, "b")), column_gap=50.0)[0] == {(1, 0): "a b"}


def test_sql_functions_are_the_columns(spark):
    from tests.test_queries import ODD

    sql.register(spark)
    texts = [*ODD, "Heading\n" + "long line of words. " * 60 + "\nx" * 500 + "\nend", "a\n" * 2000, "Head:\n\nNext head\n" + "y" * 1900 + "\ntail"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    t = F.col("text")
    same = df.select(
        F.expr("tessera_token_list(text)").eqNullSafe(T.tokens(t)).alias("tokens"), F.expr("tessera_chunk_list(text)").eqNullSafe(chunking.chunk_chars(t)).alias("chunks"), F.expr("tessera_is_heading(text)").eqNullSafe(T.is_heading(t)).alias("heading")
    )
    assert same.distinct().collect() == [(True, True, True)]
    rows = spark.sql("SELECT d.i, t.place, t.token FROM {df} d, LATERAL tessera_tokens(d.text) t WHERE d.i = 0 ORDER BY place", df=df).collect()
    assert [r["token"] for r in rows] == ["من", "متجر", "الي", "عميل"]


def test_sql_over_a_table_shuffles_no_text(spark):
    """A table function behind LATERAL is a join by the text, which goes along with each of its tokens."""
    for name in ("sql_tokens", "sql_chunks"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan
    df = spark.createDataFrame([(0, None), (1, ""), (2, "A b a"), (2, "A b a")], "doc_id int, text string")
    listed = "SELECT doc_id, place, token FROM (SELECT doc_id, tessera_token_list(text) AS l FROM {df}) LATERAL VIEW OUTER posexplode(l) AS place, token WHERE place IS NOT NULL"
    assert sorted(map(tuple, spark.sql(listed, df=df).collect())) == sorted([(2, 0, "a"), (2, 1, "b"), (2, 2, "a")] * 2)


def test_pages_are_read_in_one_shuffle(spark, monkeypatch):
    """The same lines and tables as from placed words, over pages of odd words, many pages or one of many batches."""
    import random

    rnd = random.Random(3)
    edge = [0.0, -0.0, 5.0, 40.0, 41.5, 90.0, float("nan"), float("inf")]
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([1, 2, None]), rnd.choice(edge), rnd.choice([*edge, 60.0]), float(rnd.randrange(0, 400, 7)), rnd.choice(["x", "yy", "é", "y y", " ", "ـ", "متجر"])) for _ in range(900)]
    df = spark.createDataFrame(rows, WORDS).repartition(3)
    for held in (layout.PAGE_WORDS, 8):
        monkeypatch.setattr(layout, "PAGE_WORDS", held)
        on = layout.placed(df)
        shown = lambda t: sorted(map(str, t.collect()))
        assert shown(layout.page_lines(df)) == shown(layout.prose(on))
        assert shown(layout.page_tables(df).selectExpr("file", "page", "table_no", "inline(rows)")) == shown(layout.tables(on))
        assert shown(records.markdown(layout.page_tables(df))) == shown(records.table_markdown(layout.tables(on)))
    plan = records.markdown(layout.page_tables(df.sparkSession.createDataFrame(rows, WORDS)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Window" not in plan


def test_tables_are_cleaned(spark):
    rows = [("f", 1, 0, i, c) for i, c in enumerate([["ﬁ ", "a  b"], [None, " "], [], None, ["x\ny", "z", "w"], [" ", "ok"]])]
    df = spark.createDataFrame(rows, "file string, page int, table_no int, row_no int, cells array<string>")
    assert records.table_markdown(df).collect()[0]["text"] == "| fi | a b |  |\n| --- | --- | --- |\n| x y | z | w |\n|  | ok |  |"
