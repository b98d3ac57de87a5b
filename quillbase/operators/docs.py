"""Document trees to Markdown and pages, links, images."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbase.functions import markdown
from quillbase.functions.expr import DOC_ADDRESS, content_name, decode_base64, doc_id, media_extension, slug_or

RUN = "struct<content:string,textStyle:struct<link:struct<url:string>>>"
ELEMENT = f"struct<textRun:{RUN},inlineObjectElement:struct<inlineObjectId:string>>"
PARAGRAPH = f"struct<bullet:struct<listId:string>,paragraphStyle:struct<namedStyleType:string>,elements:array<{ELEMENT}>>"
OBJECT = "struct<inlineObjectProperties:struct<embeddedObject:struct<imageProperties:struct<contentUri:string>>>>"
BODY = f"struct<content:array<struct<paragraph:{PARAGRAPH}>>>"
TREE = f"struct<body:{BODY},inlineObjects:map<string,{OBJECT}>>"
#: A Markdown link to an online document.
_MD_LINK = rf"\[([^\]]+)\]\(\s*({DOC_ADDRESS}[^)]*)\s*\)"


def _route(url: Column, text: Column) -> Column:
    target = doc_id(url)
    return F.when(target.isNotNull(), F.concat(F.lit("/p/"), slug_or(text, target), F.lit("/"))).otherwise(url)


def paragraph_prefix(paragraph: Column) -> Column:
    """The Markdown mark of a paragraph: a bullet wins over a heading of level 1 to 3."""
    style = paragraph["paragraphStyle"]["namedStyleType"]
    out = F.when(paragraph["bullet"].isNotNull(), "* ")
    for level in (1, 2, 3):
        out = out.when(style == f"HEADING_{level}", "#" * level + " ")
    return out.otherwise("")


def element_text(element: Column, objects: Column) -> Column:
    """A text run, as a link if it has one, or an image; empty for anything else."""
    run, url = element["textRun"], element["textRun"]["textStyle"]["link"]["url"]
    text = F.coalesce(run["content"], F.lit(""))
    label = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    said = F.when(url.isNotNull(), F.concat(F.lit("["), label, F.lit("]("), _route(url, label), F.lit(")"))).otherwise(text)
    uri = F.try_element_at(objects, element["inlineObjectElement"]["inlineObjectId"])["inlineObjectProperties"]["embeddedObject"]["imageProperties"]["contentUri"]
    image = F.coalesce(F.concat(F.lit("\n![image]("), uri, F.lit(")\n")), F.lit(""))
    return F.when(run.isNotNull(), said).otherwise(image)


def rewrite_links(text: Column) -> Column:
    """Links to online documents left in Markdown text become internal routes, by splitting at each one and joining again."""
    found = F.regexp_extract_all(text, F.lit(_MD_LINK), F.lit(0))
    rest = F.split(text, _MD_LINK)
    routed = F.transform(found, lambda m: F.concat(F.lit("["), F.regexp_extract(m, _MD_LINK, 1), F.lit("]("), _route(F.regexp_extract(m, _MD_LINK, 2), F.regexp_extract(m, _MD_LINK, 1)), F.lit(")")))
    return F.array_join(F.flatten(F.zip_with(rest, F.concat(routed, F.array(F.lit(""))), lambda x, y: F.array(x, y))), "")


def _raw_markdown(tree: str) -> Column:
    objects = F.coalesce(F.col(tree)["inlineObjects"], F.create_map().cast(f"map<string,{OBJECT}>"))
    held = F.filter(F.coalesce(F.col(tree)["body"]["content"], F.array().cast(f"array<struct<paragraph:{PARAGRAPH}>>")), lambda c: c["paragraph"].isNotNull())
    each = lambda c: F.concat(
        paragraph_prefix(c["paragraph"]), F.array_join(F.transform(F.coalesce(c["paragraph"]["elements"], F.array().cast(f"array<{ELEMENT}>")), lambda e: element_text(e, objects)), ""), F.lit("\n")
    )
    return F.array_join(F.transform(held, each), "")


def to_markdown(docs: DataFrame, key: str, tree: str) -> DataFrame:
    """``markdown`` of each document tree of type ``TREE``: paragraphs only, in order."""
    return docs.select(key, rewrite_links(_raw_markdown(tree)).alias("markdown"))


def link_edges(docs: DataFrame, key: str, tree: str) -> DataFrame:
    """(src, pos, dst, slug): links of text runs to online documents, in order, then those that stand as Markdown in the text."""
    rows = docs.select(key, F.posexplode(F.col(tree)["body"]["content"]).alias("p", "c")).select(key, "p", F.posexplode(F.col("c.paragraph.elements")).alias("q", "e"))
    label = F.regexp_replace(F.coalesce("e.textRun.content", F.lit("")), r"^\s+|\s+$", "")
    runs = rows.select(F.col(key).alias("src"), F.lit(0).alias("kind"), "p", "q", doc_id(F.col("e.textRun.textStyle.link.url")).alias("dst"), label.alias("label")).where("dst IS NOT NULL")
    left = docs.select(key, F.posexplode(F.regexp_extract_all(_raw_markdown(tree), F.lit(_MD_LINK), F.lit(0))).alias("p", "m"))
    left = left.select(F.col(key).alias("src"), F.lit(1).alias("kind"), "p", F.lit(0).alias("q"), F.regexp_extract("m", _MD_LINK, 3).alias("dst"), F.regexp_extract("m", _MD_LINK, 1).alias("label"))
    order = Window.partitionBy("src").orderBy("kind", "p", "q")
    return runs.unionByName(left).select("src", (F.row_number().over(order) - 1).alias("pos"), "dst", slug_or(F.col("label"), F.col("dst")).alias("slug"))


def to_html(docs: DataFrame, key: str, text: str = "markdown") -> DataFrame:
    """``html`` of Markdown texts, with tables and footnotes; null for null. Whole Arrow batches are rendered in tasks."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([part[0], pa.array(map(markdown.to_html, part[1].to_pylist()), pa.string())], names=[key, "html"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, html string")


def page_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, href, text): anchors of raw pages in order."""
    anchor = r'<a href="([^"]*)">([^<]*)</a>'
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(anchor), F.lit(0))).alias("pos", "a"))
    return rows.select(key, "pos", F.regexp_extract("a", anchor, 1).alias("href"), F.regexp_extract("a", anchor, 2).alias("text"))


IMG = r'<img[^>]*\ssrc="([^"]+)"'
IMAGES = "/static/images/"


def data_images(html: DataFrame, key: str) -> DataFrame:
    """(uri, name, data): distinct inline images of pages, named by content."""
    uris = html.select(F.explode(F.regexp_extract_all("html", F.lit(IMG), F.lit(1))).alias("uri")).where("uri LIKE 'data:%'").distinct()
    parts = uris.select("uri", F.regexp_extract("uri", r"^data:([^;,]*)", 1).alias("mime"), decode_base64(F.regexp_extract("uri", r"base64,(.*)$", 1)).alias("data"))
    return parts.where("data IS NOT NULL").select("uri", content_name(F.col("data"), media_extension(F.col("mime"))).alias("name"), "data")


def fetched_images(fetched: DataFrame) -> DataFrame:
    """(uri, name, data) of landed images (uri, mime, data), named by content; an unknown type takes the address's extension."""
    return fetched.where("data IS NOT NULL").select("uri", content_name(F.col("data"), media_extension(F.col("mime"), F.col("uri"))).alias("name"), "data")


def localize_images(html: DataFrame, key: str, assets: DataFrame, folder: str = IMAGES) -> DataFrame:
    """``html`` with the address of each image that ``assets`` (uri, name) knows replaced by its local one."""
    rows = html.select(key, "html", F.explode_outer(F.array_distinct(F.regexp_extract_all("html", F.lit(IMG), F.lit(1)))).alias("uri"))
    named = rows.join(assets.select("uri", "name"), "uri", "left").groupBy(key).agg(F.first("html").alias("html"), F.collect_list(F.when(F.col("name").isNotNull(), F.struct("uri", "name"))).alias("swaps"))
    quote = lambda x: F.concat(F.lit('src="'), x, F.lit('"'))
    swapped = F.aggregate("swaps", F.col("html"), lambda h, s: F.replace(h, quote(s["uri"]), quote(F.concat(F.lit(folder), s["name"]))))
    return named.select(key, swapped.alias("html"))


# The fragment above a page.
BACK, CREATED = '<a href="/" class="back" aria-label="Back to home">&larr; back</a>', '<span class="created">Created: '


def navigation(is_root: Column, created: Column) -> Column:
    """Nothing for the root, else a link back and, if known, the date of creation."""
    dated = F.coalesce(F.concat(F.lit(CREATED), F.nullif(created, F.lit("")), F.lit("</span>")), F.lit(""))
    return F.when(is_root, "").otherwise(F.concat(F.lit(f'<nav class="top">{BACK}'), dated, F.lit("</nav>")))


def with_created(pages: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Pages with the time of creation that the metadata (key, created) know, null where they know none."""
    known = metadata.groupBy(F.col(key).alias("_key")).agg(F.min("created").alias("created"))
    return pages.join(known, F.col(key) == F.col("_key"), "left").drop("_key")


def page_path(is_root: Column, slug: Column) -> Column:
    """The file of a page: index.html for the root, else p/<slug>/index.html."""
    return F.when(is_root, "index.html").otherwise(F.concat(F.lit("p/"), slug, F.lit("/index.html")))


def site_files(pages: DataFrame, assets: DataFrame, folder: str = IMAGES) -> DataFrame:
    """(path, data) for ``sources.files.write_files``: each of ``pages`` (is_root, slug, html) and each image of ``assets`` (name, data) once,
    though several addresses may have the same content."""
    images = assets.groupBy("name").agg(F.first("data").alias("data")).select(F.concat(F.lit(folder.strip("/") + "/"), "name").alias("path"), "data")
    return pages.select(page_path(F.col("is_root"), F.col("slug")).alias("path"), F.col("html").cast("binary").alias("data")).unionByName(images)


def fill_template(template: str, content: Column, nav: Column, updated: Column) -> Column:
    """The page template with its three placeholders filled."""
    page = F.lit(template)
    for mark, value in (("{{CONTENT}}", content), ("{{NAV}}", nav), ("{{LAST_UPDATED}}", updated)):
        page = F.replace(page, F.lit(mark), value)
    return page
