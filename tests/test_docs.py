"""Document trees, Markdown, HTML, slugs, graph and images."""

import pytest
from pyspark.sql import functions as F

from quillbase.functions import expr
from quillbase.operators import docs
from quillbase.plans import catalogue
from quillbase.sources import files

DOC = "https://docs.google.com/document/d/ID1/edit"


def paragraph(*elements, style=None, bullet=False):
    return {"paragraph": {"bullet": {"listId": "l"} if bullet else None, "paragraphStyle": {"namedStyleType": style}, "elements": list(elements)}}


def run(text, url=None):
    return {"textRun": {"content": text, "textStyle": {"link": {"url": url} if url else None}}, "inlineObjectElement": None}


def image(key):
    return {"textRun": None, "inlineObjectElement": {"inlineObjectId": key}}


def tree(spark, *content, objects=None):
    row = {"id": 1, "tree": {"body": {"content": list(content)}, "inlineObjects": objects}}
    return spark.createDataFrame([row], f"id long, tree {docs.TREE}")


def test_markdown(spark):
    objects = {"i": {"inlineObjectProperties": {"embeddedObject": {"imageProperties": {"contentUri": "http://x/y.png"}}}}}
    df = tree(
        spark,
        paragraph(run("One"), style="HEADING_1"), paragraph(run("Four"), style="HEADING_4"), paragraph(run("item"), style="HEADING_2", bullet=True), {"paragraph": None},
        paragraph(run(" My Page! ", DOC), run(" and "), run("out", "http://e.com")), paragraph(run("!!", DOC)), paragraph(image("i"), image("none")), paragraph(run(f"see [Raw Link]({DOC})")), paragraph(),
        objects=objects,
    )
    text = docs.to_markdown(df, "id", "tree").first().markdown
    assert text == "# One\nFour\n* item\n[My Page!](/p/my-page/) and [out](http://e.com)\n[!!](/p/ID1/)\n\n![image](http://x/y.png)\n\nsee [Raw Link](/p/raw-link/)\n\n"
    assert docs.to_markdown(tree(spark), "id", "tree").first().markdown == ""
    assert [(r.pos, r.dst, r.slug) for r in docs.link_edges(df, "id", "tree").orderBy("pos").collect()] == [(0, "ID1", "my-page"), (1, "ID1", "ID1"), (2, "ID1", "raw-link")]


def test_html(spark):
    text = "# A & B\n* x\n* [y](/p/y/)\n\nplain\nmore\n\n![image](u.png)\n"
    html = docs.to_html(spark.createDataFrame([(1, text), (2, "")], "id long, markdown string"), "id").orderBy("id").collect()
    assert html[0].html == '<h1>A &amp; B</h1>\n<ul>\n<li>x</li>\n<li><a href="/p/y/">y</a></li>\n</ul>\n<p>plain\nmore</p>\n<p><img src="u.png" alt="image" /></p>\n'
    assert html[1].html == ""


def test_images(spark):
    page = '<p><img alt="" src="data:image/png;base64,aGVsbG8="><img src="http://k/z.png"><img src="data:image/gif;base64,!!"></p>'
    pages = spark.createDataFrame([(1, page), (2, "none")], "id long, html string")
    assets = docs.data_images(pages, "id")
    name = assets.first().name
    assert assets.count() == 1 and name == "2cf24dba5fb0a30e.png"
    out = {r.id: r.html for r in docs.localize_images(pages, "id", assets).collect()}
    assert f'src="/static/images/{name}"' in out[1] and 'src="http://k/z.png"' in out[1] and out[2] == "none"


def test_page_parts(spark):
    row = spark.range(1).select(
        docs.navigation(F.lit(True), F.lit("x")).alias("root"), docs.navigation(F.lit(False), F.lit("May 1, 2024")).alias("dated"), docs.navigation(F.lit(False), F.lit(None).cast("string")).alias("bare"),
        docs.fill_template("{{NAV}}|{{CONTENT}}|{{LAST_UPDATED}}", F.lit("c"), F.lit("n"), F.lit("u")).alias("page"),
    ).first()
    back = '<nav class="top"><a href="/" class="back" aria-label="Back to home">&larr; back</a>'
    assert row.root == "" and row.dated == back + '<span class="created">Created: May 1, 2024</span></nav>' and row.bare == back + "</nav>" and row.page == "n|c|u"


def test_expressions(spark):
    def one(column):
        return spark.range(1).select(column.alias("v")).first().v

    number = lambda x: one(expr.finite_number(F.lit(x).cast("string")))
    assert [number(x) for x in ("1.5", " -2 ", ".5", "1e3", "1d", "NaN", "Infinity", "", None, "1e999", "0x10")] == [1.5, -2.0, 0.5, 1000.0, None, None, None, None, None, None, None]
    assert one(expr.hex_text(F.lit(bytearray(b"\x0a\xff")))) == "0x0aff" and one(expr.hex_text(F.lit(None).cast("binary"))) is None
    assert one(expr.slugify(F.lit("  Hé llo--W_1 "))) == "h-llo-w-1"
    assert one(expr.slug_or(F.lit("!!"), F.lit("id"))) == "id"
    assert one(expr.doc_id(F.lit("HTTPS://docs.google.com/document/u/0/d/aB_-9/x"))) == "aB_-9" and one(expr.doc_id(F.lit("http://x"))) is None
    assert one(expr.html_escape(F.lit("<a href='x'>&\""))) == "&lt;a href=&#39;x&#39;&gt;&amp;&quot;"
    assert one(expr.fmt_usd(F.lit(-1234.5))) == "-$1,234.50" and one(expr.fmt_usd(F.lit(None).cast("double"))) == "—"
    assert one(expr.fmt_pct(F.lit(3.0))) == "+3.00%" and one(expr.fmt_bps(F.lit(None).cast("double"))) == "—"
    assert one(expr.countdown(F.lit(3_725_999))) == "01:02:05" and one(expr.countdown(F.lit(-5))) == "00:00:00"
    assert one(expr.iso_ms(F.lit(1_000).cast("long"))) == "1970-01-01T00:00:01.000Z"
    assert one(expr.spread_bps(F.lit(99.0), F.lit(101.0))) == 200.0 and one(expr.spread_bps(F.lit(2.0), F.lit(2.0))) is None
    assert one(expr.decode_base64(F.lit("!!"))) is None and one(expr.media_extension(F.lit("text/x"))) == ".bin"
    assert one(expr.percent_change(F.lit(1.0), F.lit(0.0))) is None


def test_created(spark):
    pages = spark.createDataFrame([("a", "<p>1</p>", "r"), ("b", None, "s"), ("c", "<p>3</p>", "t")], "slug string, html string, file string")
    dated = docs.with_created(pages, spark.createDataFrame([("r", "2020"), ("r", "2021"), ("x", "2")], "file string, created string"), "file")
    assert sorted((r.slug, r.created) for r in dated.collect()) == [("a", "2020"), ("b", None), ("c", None)]


def test_extensions(spark):
    rows = [("image/png", "x"), ("text/x", "http://k/a.JPEG"), (None, "http://k/b.svg"), ("image/webp", "http://k/c.png?x=1"), ("x", "http://k.gif/d"), ("x", None)]
    got = spark.createDataFrame(rows, "mime string, url string").select(expr.media_extension(F.col("mime"), F.col("url")).alias("e")).collect()
    assert [r.e for r in got] == [".png", ".jpg", ".svg", ".bin", ".bin", ".bin"]


def site(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file()}


def test_site_on_disk(spark, tmp_path):
    folder = tmp_path / "dist"
    pages = spark.createDataFrame([(True, None, "<p>root</p>"), (False, "a", "<p>é</p>"), (False, "b", None), (False, "c", "")], "is_root boolean, slug string, html string")
    assets = spark.createDataFrame([("u1", "n.png", bytearray(b"\x89PNG\n\x00")), ("u2", "n.png", bytearray(b"\x89PNG\n\x00"))], "uri string, name string, data binary")
    assert files.write_files(docs.site_files(pages, assets), str(folder)) == 4
    want = {"index.html": b"<p>root</p>", "p/a/index.html": "<p>é</p>".encode(), "p/c/index.html": b"", "static/images/n.png": b"\x89PNG\n\x00"}
    assert site(folder) == want and [p.name for p in tmp_path.iterdir()] == ["dist"]

    # a task that fails, a path that is no path and a repeated one leave the old site whole
    bad = spark.createDataFrame([("x.html", "1"), ("y.html", "boom")], "path string, data string")
    with pytest.raises(Exception, match="boom"):
        files.write_files(bad.withColumn("data", F.when(F.col("data") == "boom", F.raise_error(F.lit("boom"))).otherwise(F.col("data"))), str(folder))
    for rows in ([("../x", "1")], [("/x", "1")], [("", "1")], [(None, "1")], [("x", "1"), ("x", "2")]):
        with pytest.raises(ValueError):
            files.write_files(spark.createDataFrame(rows, "path string, data string"), str(folder))
    assert site(folder) == want and [p.name for p in tmp_path.iterdir()] == ["dist"]

    # added files leave what is there; a new site takes the place of all
    more = spark.createDataFrame([("index.html", "new"), ("z/z.txt", "z")], "path string, data string")
    assert files.write_files(more, str(folder), add=True) == 1 and site(folder) == want | {"z/z.txt": b"z"}
    assert files.write_files(more, str(folder)) == 2 and site(folder) == {"index.html": b"new", "z/z.txt": b"z"}
    assert files.write_files(more.limit(0), str(folder)) == 0 and site(folder) == {}


def test_files_read_by_their_paths(spark, tmp_path):
    """Files are opened at the paths that were written: folders aren't listed, so names that listings skip are there too, and added files spare them."""
    folder = str(tmp_path / "dist")
    rows = {"index.html": b"a", ".well-known/x": b"", "_headers": b"\x00b", "p/c d/\u00e9%20.html": b"c" * 100}
    made, n = files.put_files(spark.createDataFrame([(k, bytearray(v)) for k, v in rows.items()], "path string, data binary"), folder)
    back = files.read_files(made, folder)
    assert n == 4 and {r.path: bytes(r.data) for r in back.collect()} == rows
    more = spark.createDataFrame([("_headers", "new"), ("n", "n"), ("p/q", "q")], "path string, data string")
    made, n = files.put_files(more, folder, add=True)
    assert n == 2 and sorted(r.path for r in made.collect()) == ["n", "p/q"] and site(tmp_path / "dist") == rows | {"n": b"n", "p/q": b"q"}
    with pytest.raises(Exception, match="gone"):
        files.read_files(spark.createDataFrame([("gone",)], "path string"), folder).collect()


def test_site_on_disk_lists_nothing(spark, sf_dir):
    """The driver holds no row for each file: the site's files are opened by tasks, as many as their paths need."""
    out = catalogue.QUERIES["site_on_disk"](spark, sf_dir)
    assert "binaryFile" not in out._jdf.queryExecution().toString() and out.rdd.getNumPartitions() <= 16 and out.count() > 300
