"""Article HTML to ordered, styled document blocks and edit requests: D1-D12.

Everything happens in the row of the parsed article: the h1-h6/p/div elements
in document order, nested ones too (D1), the text and class filter (D2), the
image marks (D3), the n-th mark's image ``images[n]`` (D4) and whether it is
admitted (D5, from the article's ``admitted`` array), style and length rule
(D6) and the running insert offsets (D7). One ``inline`` then makes block rows,
and another their edit requests (D8). Block text is never shuffled or joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import words as W
from ..functions.columns import prefix_scan
from ..functions.markup import clean_html
from ..functions.sqlexpr import lit as sql_lit
from ..functions.text import contains_any, py_strip
from .articles import with_outcomes
from .dom import node_text, subtree

HEADINGS = [f"h{i}" for i in range(1, 7)]
_FAILED_HEAD, _FAILED_TAIL = W.IMAGE_FAILED_TEXT.split("{url}")


def _is_mark(text: Column) -> Column:
    """D3."""
    return contains_any(text, W.PLACEHOLDER_MARKS)


def element_structs() -> Column:
    """All h1-h6/p/div elements in document order, nested ones included."""
    nodes, text = F.col("nodes"), F.col("page_text")
    return F.transform(
        F.filter(nodes, lambda n: n["tag"].isin(*W.BLOCK_TAGS)),
        lambda n: F.struct(n["node_id"].alias("seq"), n["tag"].alias("tag"),
                           F.array_join(n["classes"], " ").alias("cls"),
                           (F.size(n["classes"]) > 0).alias("has_cls"),
                           py_strip(node_text(text, n)).alias("text")))


def with_elements(art_dom: DataFrame) -> DataFrame:
    """D1-D4 in the row: ``elements``, an array of (seq, tag, text, is_mark, mark_no, image_url, admitted).

    ``art_dom``: ``page_id, images, admitted, page_text, nodes`` (parsed article content).
    ``image_url`` is the n-th image for the n-th mark, NULL if none is left.
    """
    marked = F.transform(element_structs(), lambda e: F.struct(
        e["seq"].alias("seq"), e["tag"].alias("tag"), e["text"].alias("text"), e["cls"].alias("cls"),
        e["has_cls"].alias("has_cls"), _is_mark(e["text"]).alias("is_mark")))
    kept = F.filter("_marked", lambda e: (F.length(e["text"]) >= W.BLOCK_MIN_CHARS)
                    & ~(e["has_cls"] & contains_any(e["cls"], W.BLOCK_SKIP_CLASS_PARTS)))
    numbers = F.map_from_entries(F.transform(
        F.filter("_kept", lambda e: e["is_mark"]), lambda e, i: F.struct(e["seq"], (i + 1).cast("int"))))

    def element(e):
        no = F.element_at(F.col("_no"), e["seq"])
        return F.struct(e["seq"].alias("seq"), e["tag"].alias("tag"), e["text"].alias("text"),
                        e["is_mark"].alias("is_mark"), no.alias("mark_no"),
                        F.get("images", no - 1).alias("image_url"),
                        F.coalesce(F.get("admitted", no - 1), F.lit(False)).alias("admitted"))

    return (art_dom.withColumn("_marked", F.coalesce(marked, F.array())).withColumn("_kept", kept)
            .withColumn("_no", numbers).withColumn("elements", F.transform("_kept", element))
            .drop("_marked", "_kept", "_no"))


def article_elements(art_dom: DataFrame) -> DataFrame:
    """D1-D4 as rows: page_id, seq (document position), tag, text, is_mark, mark_no, image_url."""
    return with_elements(art_dom).select("page_id", F.inline("elements")).drop("admitted")


def _starts(widths: Column) -> Column:
    """Where each of a row of pieces starts in the document."""
    ends = prefix_scan(widths, F.lit(W.DOC_START_INDEX), F.lit(0), lambda a, b: (a + b).cast("int"))
    return F.slice(ends, 1, F.size(widths))


def with_blocks(art_dom: DataFrame) -> DataFrame:
    """D4-D7 in the row: ``blocks``, an array of (seq, kind, tag, style, text, image_url, start_index, end_index).

    Marks with an image become image blocks, or a fallback text when the image
    is not admitted; marks without one go; headings stay; p/div stay when long
    enough. Each block is appended at the document end: text plus two
    newlines, or an image plus one newline; ``end_index`` ends the styled text.

    An article whose markup cannot be parsed (``parse_error``) is one block of
    kind ``text``: its cleaned-up text (H1), without style or newlines. The
    column ``content`` must then be there.
    """
    def block(e):
        is_img, failed = e["is_mark"] & e["admitted"], e["is_mark"] & ~e["admitted"]
        heading = e["tag"].isin(*HEADINGS)
        kind = (F.when(is_img, F.lit("image")).when(failed, F.lit("paragraph")).when(heading, F.lit("heading"))
                .when(F.length(e["text"]) > W.PARAGRAPH_MIN_CHARS, F.lit("paragraph")))
        style = (F.when(is_img, F.lit(None).cast("string")).when(failed, F.lit("NORMAL_TEXT"))
                 .when(heading, F.concat(F.lit("HEADING_"), F.substring(e["tag"], 2, 1))).otherwise(F.lit("NORMAL_TEXT")))
        text = (F.when(is_img, F.lit(None).cast("string"))
                .when(failed, F.concat(F.lit(_FAILED_HEAD), e["image_url"], F.lit(_FAILED_TAIL))).otherwise(e["text"]))
        return F.struct(e["seq"].alias("seq"), kind.alias("kind"), e["tag"].alias("tag"), style.alias("style"),
                        text.alias("text"), F.when(e["is_mark"], e["image_url"]).alias("image_url"))

    made = F.filter(F.transform(F.filter("elements", lambda e: ~e["is_mark"] | e["image_url"].isNotNull()), block),
                    lambda b: b["kind"].isNotNull())
    rows = with_elements(art_dom).withColumn("_made", made)
    if "parse_error" in art_dom.columns and "content" in art_dom.columns:
        plain = F.array(F.struct(F.lit(0).alias("seq"), F.lit("text").alias("kind"), F.lit(None).cast("string").alias("tag"),
                                 F.lit(None).cast("string").alias("style"), clean_html(F.col("content")).alias("text"),
                                 F.lit(None).cast("string").alias("image_url")))
        rows = rows.withColumn("_made", F.when(F.col("parse_error").isNotNull(), plain).otherwise(F.col("_made")))
    # The widths, then where each block starts
    widths = F.expr("transform(_made, b -> CASE b.kind WHEN 'image' THEN 2 WHEN 'text' THEN length(b.text) "
                    "ELSE length(b.text) + 2 END)")
    starts = _starts(widths)
    placed = F.zip_with("_made", "_starts", lambda b, s: F.struct(
        *[b[c].alias(c) for c in ("seq", "kind", "tag", "style", "text", "image_url")], s.alias("start_index"),
        F.when(b["kind"] != "image", s + F.length(b["text"])).alias("end_index")))
    return (rows.withColumn("_starts", starts).withColumn("blocks", placed).drop("_made", "_starts", "elements"))


def article_blocks(art_dom: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """D1-D7 as rows: page_id, carried columns, and the fields of ``blocks``."""
    return with_blocks(art_dom).select("page_id", *(carry or []), F.inline("blocks"))


def document_edits(offsets: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The ordered edit list ``(page_id, seq, op_no, op, start_index, end_index, text, style)``."""
    s = F.col("start_index")

    def op(no, name, start, end, text, style):
        return F.struct(F.lit(no).alias("op_no"), F.lit(name).alias("op"), start.cast("int").alias("start_index"),
                        end.cast("int").alias("end_index"), text.cast("string").alias("text"),
                        style.cast("string").alias("style"))

    none = F.lit(None)
    text_ops = F.array(op(0, "insertText", s, none, F.concat(F.col("text"), F.lit("\n\n")), none),
                       op(1, "updateParagraphStyle", s, F.col("end_index"), none, F.col("style")))
    img_ops = F.array(op(0, "insertInlineImage", s, none, F.col("image_url"),
                         F.lit(f"{W.IMAGE_WIDTH_PT}x{W.IMAGE_HEIGHT_PT}pt")),
                      op(1, "insertText", s + 1, none, F.lit("\n"), none))
    plain_ops = F.array(op(0, "insertText", s, none, F.col("text"), none))
    ops = F.when(F.col("kind") == "image", img_ops).when(F.col("kind") == "text", plain_ops).otherwise(text_ops)
    return offsets.select("page_id", "seq", *(carry or []), F.inline(ops))


def article_stats(articles: DataFrame, outcomes: DataFrame | None = None) -> DataFrame:
    """Content length and image count per article; of one whose document could not be written, the error alone."""
    told = with_outcomes(articles, outcomes)
    fine = F.col("failure").isNull()
    return told.select("page_id", fine.alias("success"), F.when(fine, F.length("content")).alias("content_length"),
                       F.when(fine, F.size("images")).alias("images_processed"), F.col("failure").alias("error"))


# ---------------------------------------------------------------- D11

def list_blocks(art_dom: DataFrame) -> DataFrame:
    """D11 (the list-aware variant): top-level elements; text under 5 dropped;
    ul/ol give one bullet line per non-empty li then a blank line; li one
    bullet line; headings their style; everything else NORMAL_TEXT. Each line has
    the index where it is inserted, and the end of its style range if it has one."""
    nodes, text = F.col("nodes"), F.col("page_text")
    style_of = F.create_map(*[x for tag, st in W.LIST_STYLES for x in (F.lit(tag), F.lit(st))])

    def line(t, st):
        return F.struct(t.alias("text"), st.alias("style"))

    def lines(e):
        t = py_strip(node_text(text, e))
        lis = F.filter(subtree(nodes, e), lambda n: n["tag"] == "li")
        li_lines = F.transform(F.filter(F.transform(lis, lambda n: py_strip(node_text(text, n))), lambda s: s != ""),
                               lambda s: line(F.concat(F.lit(W.LIST_BULLET), s, F.lit("\n")), F.lit("NORMAL_TEXT")))
        return (F.when(F.length(t) < W.LIST_MIN_CHARS, F.array().cast("array<struct<text:string,style:string>>"))
                 .when(e["tag"].isin("ul", "ol"), F.concat(li_lines, F.array(line(F.lit("\n"), F.lit("NORMAL_TEXT")))))
                 .when(e["tag"] == "li", F.array(line(F.concat(F.lit(W.LIST_BULLET), t, F.lit("\n")),
                                                      F.lit("NORMAL_TEXT"))))
                 .otherwise(F.array(line(F.concat(t, F.lit("\n\n")),
                                         F.coalesce(style_of[e["tag"]], F.lit("NORMAL_TEXT"))))))

    top = F.filter(nodes, lambda n: n["parent_id"] == 0)
    per = F.flatten(F.transform(top, lambda e: F.transform(
        lines(e), lambda x: F.struct(e["node_id"].alias("seq"), x["text"].alias("text"), x["style"].alias("style")))))
    found = art_dom.select("page_id", F.coalesce(per, F.array()).alias("_lines"))
    # every line is appended at the document end; a style other than the normal one covers the line's text
    starts = _starts(F.transform("_lines", lambda x: F.length(x["text"])))
    placed = F.zip_with("_lines", "_starts", lambda x, s: F.struct(
        x["seq"].alias("seq"), x["text"].alias("text"), x["style"].alias("style"), s.alias("start_index"),
        F.when(x["style"] != "NORMAL_TEXT", s + F.length(x["text"])).alias("end_index")))
    return found.withColumn("_starts", starts).select("page_id", F.posexplode(placed).alias("line_no", "l")).select(
        "page_id", "line_no", "l.*")


# ---------------------------------------------------------------- D12

def fill_marks(articles: DataFrame, out: str = "filled") -> DataFrame:
    """``content`` with its marks filled by ``images``, as a new column.

    The patterns take turns. The marks that a pattern finds are replaced one
    after another, each time in the whole text; every one of them uses up an
    image, also where an equal mark was replaced before. Once the images are
    used up, marks become empty text. Without images nothing changes.
    """
    df = articles.withColumn("_fill", F.struct(F.col("content").alias("text"), F.lit(0).alias("used")))
    for pattern in W.FILL_MARK_PATTERNS:
        found = f"regexp_extract_all(_fill.text, {sql_lit('(?is)' + pattern)}, 0)"
        image = ("CASE WHEN acc.used < size(images) THEN concat('[画像', acc.used + 1, ': ', images[acc.used], ']') "
                 "ELSE '' END")
        df = df.withColumn("_fill", F.expr(
            f"aggregate({found}, _fill, (acc, mark) -> named_struct('text', replace(acc.text, mark, {image}), "
            "'used', least(acc.used + 1, size(images))))"))
    none = F.size(F.coalesce("images", F.array().cast("array<string>"))) == 0
    return df.withColumn(out, F.when(none, F.col("content")).otherwise(F.col("_fill.text"))).drop("_fill")
