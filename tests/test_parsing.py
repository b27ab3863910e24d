from pyspark.sql import functions as F

from marlspark.functions import parsing as P
from marlspark.operators.scan import html_text


def test_search_results():
    page = '<a class="result__a" href="//d.com/l/?uddg=https%3A%2F%2Fx.org%2Fa&amp;r=1">A <b>title</b></a><a class="result__snippet">some &amp; text</a><a rel="n" class="result__a" href="https://y.org">B</a>'
    assert P.search_results(page) == [("A title", "https://x.org/a", "some & text"), ("B", "https://y.org", "")]


def test_entrypoint_limits(spark):
    cases = ["a\nb\n", "a\nb", "", None, "a\r\nb\u2028c\n\n", "\n".join("l%d" % k for k in range(300)), "x" * 10 + "\n" + "y" * 30_000 + "\n", "ä" * 20_000, "z" + "€" * 9_000, "\n" + "y" * 30_000, "a \n" * 200 + "more"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "k int, t string").repartition(1)
    got = {r["k"]: tuple(r["e"]) for r in rows.select("k", P.truncated_entrypoint(F.col("t")).alias("e")).collect()}
    assert [got[k] for k in range(5)] == [("a\nb\n", False), ("a\nb", False), ("", False), ("", False), ("a\nb\nc\n", False)]
    text, cut = got[5]
    assert cut and text.startswith("l0\n") and "\nl199\n\n> WARNING: MEMORY.md is 300 lines (limit: 200). " in text and "l200" not in text and text.endswith("topic notes.\n")
    text, cut = got[6]
    assert cut and text.startswith("x" * 10 + "\n\n> WARNING: MEMORY.md is 30012 bytes (limit: 25000). ")
    assert got[7][0].startswith("ä" * 12_500 + "\n\n> WARNING")  # no line end to cut at, and no half a character
    assert got[8][0].startswith("z" + "€" * 8_333 + "\n\n> WARNING")  # 24,999 bytes and 1 more fit
    assert got[9][0].startswith("\n" + "y" * 24_999 + "\n\n> WARNING")
    assert got[10][0].startswith("a \n" * 199 + "a\n\n> WARNING: MEMORY.md is 201 lines")


def test_file_names():
    cases = {"a/b/../we?ird:name.txt ": "we_ird_name.txt", "...": "", "": "", "a b/": "a_b", "é½x": "1_2x", "-_.a._-": "a", "日本": "", "n" * 300: "n" * 128}
    assert {k: P.filename(k) for k in cases} == cases


def test_mentions():
    payload = '{"mentions": [{"key": "@1", "name": " Ann ", "id": {"open_id": "o", "union_id": "n"}}, 5], "c": [[{"tag": "at", "user_id": 1, "user_name": "B"}], {"d": {"tag": "at", "user_id": "1", "name": "B"}}, {"tag": "at"}]}'
    assert P.mentions(payload) == [("@1", "Ann", "o", "", "n"), ("", "B", "", "1", "")]
    assert P.mentions("{", '[{"open_id": "x"}]') == [("", "", "x", "", "")] and P.mentions("[]") == []


def test_text_previews():
    assert P.text_preview(b"plain  \n text") == "plain text" and P.text_preview(b"") == "" and P.text_preview(b"\0\1\2a") is None and P.text_preview(b"\xff") is None
    assert P.text_preview(b"x" * 901) == "x" * 897 + "..." and P.text_preview(b"x" * 900) == "x" * 900


def test_plain_text_of_pages(spark):
    pages = {
        "<p>a <b>b</b>\tc</p><script>var x = '<p>';</script><style>p{}</style> &amp;lt; &copy;<br>d": "a b c < © d",
        "": "",
        None: "",
        "x<!-- <p>no</p> -->y <a title='1 > 0' href=\"?a>b\">link</a>&nbsp;<i> &nbsp; </i>2 < 3": "x y link 2 < 3",
        "<SCRIPT type=a>if (a</b) {}</Script >t<script>never over": "t",
        "<!doctype html><?pi?>one\r\n two \n\n three &#x41;&eacute;&notin;&unknown;": "one\n two\n\n three Aé∉&unknown;",
        "a\x1eb": "a b",
    }
    rows = spark.createDataFrame([(k, h) for k, h in enumerate(pages)], "k int, html string")
    got = {r["k"]: r["text"] for r in html_text(rows, "html").collect()}
    assert [got[k] for k in range(len(pages))] == list(pages.values())


def test_references_that_lack_their_semicolon(spark, tmp_path):
    """Where a title was cut within a reference, x22's SQL keeps what is left of it; browsers decode it."""
    import duckdb

    from marlspark.operators.scan import unescape_closed
    from marlspark.plans import catalog

    assert unescape_closed("&amp;&amp &#65;&#x41;&#65 &notin;&notit; &eacute &unknown; &amp;lt;") == "&&amp AA&#65 ∉&notit; &eacute &unknown; &lt;"
    pages = [(1, "<title>a&amp;&amp;&amp</title><p>b &copy; c&quo</p>"), (2, "<p>x &quot</p><p>&lt;y&am</p>"), (3, "<p>&copy;&middot;</p>")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = dict(catalog.QUERIES["x22_html_text"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == dict(con.execute(catalog.ORACLES["x22_html_text"]).fetchall())
    rows = spark.createDataFrame(pages, "page_id long, html string")
    assert [r["text"] for r in html_text(rows, "html").orderBy("page_id").collect()] == ["a&&& b © c&quo", 'x " <y&am', "©·"]
