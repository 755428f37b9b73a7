"""Operators over whole documents: what repeats across pages, how blocks join to text, and the chunks of a document."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from .page import PAGE, not_blank

DOC = ["doc_id"]


def header_footer_spans(spans: DataFrame, n_lines: int = 2, share: float = 0.6) -> DataFrame:
    """doc_id, pnum, span_id, text of spans in the first or last lines of pages whose text stands there on more than a share
    of the pages; short texts and documents of fewer than three pages have none.

    Lines count if they aren't blank, in the order of extraction; first and last lines are judged apart."""
    line = spans.groupBy(*PAGE, "block_no", "line_no").agg(F.max(not_blank(F.col("text"))).alias("some")).filter("some")
    up, down = (W.partitionBy(*PAGE).orderBy(*[f(c) for c in ("block_no", "line_no")]) for f in (F.asc, F.desc))
    ends = line.withColumn("first", F.row_number().over(up) <= n_lines).withColumn("last", F.row_number().over(down) <= n_lines).filter("first or last")
    pages = spans.groupBy(*DOC).agg(F.count_distinct("pnum").alias("n_pages")).filter("n_pages >= 3")
    edge = spans.filter(F.length("text") > 4).join(ends.drop("some"), [*PAGE, "block_no", "line_no"])
    every = edge.select(*PAGE, "span_id", "text", F.explode(F.array_compact(F.array(F.when(F.col("first"), "first"), F.when(F.col("last"), "last")))).alias("side"))
    common = every.groupBy(*DOC, "side", "text").agg(F.count(F.lit(1)).alias("n")).join(pages, DOC).filter(F.col("n") > F.col("n_pages") * share)
    return every.join(common.select(*DOC, "side", "text"), [*DOC, "side", "text"], "left_semi").select(*PAGE, "span_id", "text").distinct()


def code_blocks(spans: DataFrame, lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, pnum, block_no of Text blocks that look like code: several short lines, mostly indented or comments, in a type
    clearly smaller and tighter than the document's."""
    nonblank = not_blank(F.col("text"))
    sizes = spans.filter(nonblank).groupBy(*DOC).agg(F.avg("font_size").alias("doc_size"))
    heights = lines.filter(nonblank).groupBy(*DOC).agg(F.median(F.col("y1") - F.col("y0")).alias("doc_height"))
    block = W.partitionBy(*PAGE, "block_no")
    l = lines.withColumn("indented", F.col("x0") > F.min("x0").over(block))
    comment = F.col("text").rlike(r"""^(//|#|'|--|/\*|\"\"\"|<!--|%|\(\*)""")
    of_lines = l.groupBy(*PAGE, "block_no").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.regexp_count("text", F.lit(r"[\p{L}\p{N}_]"))).alias("alnum"),
        (F.count_if("indented") + F.count_if(comment)).alias("marked"),
        F.avg(F.col("y1") - F.col("y0")).alias("height"),
    )
    of_spans = spans.groupBy(*PAGE, "block_no").agg(F.avg("font_size").alias("size"))
    b = blocks.filter("block_type = 'Text'").select(*PAGE, "block_no").join(of_lines, [*PAGE, "block_no"]).join(of_spans, [*PAGE, "block_no"]).join(sizes, DOC, "left").join(heights, DOC, "left")
    shape = (F.col("n") > 3) & (F.col("alnum") > 0) & (F.col("alnum") / F.greatest(F.col("n") - 1, F.lit(1)) < 80) & (F.col("marked") > F.col("n") * 0.7)
    type_ = F.col("doc_size").isNull() | ((F.col("size") <= F.col("doc_size") * 0.8) & (F.col("height") < F.col("doc_height") * 0.8))
    return b.filter(shape & type_).select(*PAGE, "block_no")


def font_style(spans: DataFrame, min_weight: int = 600) -> DataFrame:
    """Spans with bold and italic: by the font's name outside of headings, by weight everywhere. A document whose spans are
    all in headings has neither. Needs block_type."""
    body = ~F.col("block_type").isin(*T.HEADING_TYPES)
    any_ = F.max(body).over(W.partitionBy(*DOC))
    name = F.lower("font")
    bold = any_ & ((body & name.contains("bold")) | (F.col("font_weight") >= min_weight))
    return spans.withColumn("bold", bold).withColumn("italic", any_ & body & name.contains("ital"))


def merge_spans(spans: DataFrame) -> DataFrame:
    """Lines of merged blocks: (doc_id, pnum, block_no, sub_no, line_no, part, block_type, text, fonts, image_name, table_data).

    A picture span stands alone as an Image block and splits its line and block; a Table block that no table span begins is
    Text. The last merged block of a page goes if it is one line of digits. Needs block_type, is_image, is_table,
    table_data and formatted texts; spans of a table block but the first are left out."""
    block = W.partitionBy(*PAGE, "block_no")
    order = block.orderBy("line_no", "span_no")
    s = spans.withColumn("lead_table", F.first(F.col("is_table")).over(order)).withColumn("i", F.row_number().over(order))
    s = s.withColumn("block_type", F.when((F.col("block_type") == "Table") & ~F.col("lead_table"), "Text").otherwise(F.col("block_type")))
    s = s.filter((F.col("block_type") != "Table") | (F.col("i") == 1))
    # a new part begins at a picture, and after one
    begins = F.col("is_image") | F.coalesce(F.lag("is_image").over(order), F.lit(False))
    s = s.withColumn("sub_no", F.sum(begins.cast("int")).over(order)).withColumn("block_type", F.when(F.col("is_image"), "Image").otherwise(F.col("block_type")))
    pieces = F.sort_array(F.collect_list(F.struct("span_no", "text", F.lower("font").alias("font"))))
    l = s.groupBy(*PAGE, "block_no", "sub_no", "line_no", "block_type").agg(
        F.array_join(F.transform(pieces, lambda x: x["text"]), "").alias("text"),
        F.transform(pieces, lambda x: x["font"]).alias("fonts"),
        F.max(F.when(F.col("is_image"), F.col("span_id"))).alias("image_name"),
        F.max(F.when(F.col("block_type") == "Table", F.col("table_data"))).alias("table_data"),
    )
    l = l.filter("text <> '' or block_type in ('Image', 'Table')")
    page = W.partitionBy(*PAGE)
    last = F.max(F.struct("block_no", "sub_no")).over(page)
    n = F.count(F.lit(1)).over(W.partitionBy(*PAGE, "block_no", "sub_no"))
    l = l.withColumn("last", last).withColumn("n", n)
    number = (F.struct("block_no", "sub_no") == F.col("last")) & (F.col("n") == 1) & F.col("text").rlike(r"^\p{Nd}+\z")
    return l.filter(~number).drop("last", "n")


def same_table(a: Column, b: Column) -> Column:
    """Whether two unquoted CSV texts have rows of the same width; the first rows tell."""
    width = lambda t: F.size(F.split(F.element_at(F.split(t, "\n", -1), 1), ",", -1))
    return width(a) == width(b)


def merge_lines(lines: DataFrame, order: list[str] | None = None, flush_at_images: bool = False) -> DataFrame:
    """Blocks of a document's text: (doc_id, index, block_type, text, image_name, table_data).

    `order` are the columns that order a document's merged lines. Neighbouring blocks of one type join, across pages too;
    tables join if they are of one width. A picture comes out at its place and ends no block, so that it stands before
    the block around it (`flush_at_images` ends blocks there instead)."""
    order = order or ["pnum", "block_no", "sub_no", "line_no"]
    doc = W.partitionBy(*DOC).orderBy(*order)
    w = W.partitionBy(*DOC).orderBy("seq")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    image, table = F.col("block_type") == "Image", F.col("block_type") == "Table"
    r = lines.withColumn("seq", F.row_number().over(doc)).withColumn("gap", F.sum(image.cast("int")).over(w) if flush_at_images else F.lit(0))
    # lines continue if they are as high as the line before and begin where it does; tables have no lines
    shape = F.struct((F.col("y1") - F.col("y0")).alias("height"), F.col("x0").alias("left"))
    was = F.struct("block_type", "gap", "table_data")
    r = r.withColumn("shape", F.when(~image & ~table, shape)).withColumn("was", F.last(F.when(~image, was), True).over(before)).withColumn("above", F.last("shape", True).over(before))
    continues = F.coalesce((F.col("shape.height") == F.col("above.height")) & (F.col("shape.left") == F.col("above.left")), F.lit(False))
    new = F.coalesce((F.col("block_type") != F.col("was.block_type")) | (F.col("gap") != F.col("was.gap")) | (table & ~same_table(F.col("was.table_data"), F.col("table_data"))), F.lit(True))
    # a block is known by its first line, a picture by itself
    begin = F.when(image, F.col("seq")).otherwise(F.last(F.when(~image & new, F.col("seq")), True).over(w))
    r = r.select(*DOC, "seq", "block_type", "text", "image_name", "table_data", continues.alias("continues"), begin.alias("begin"))
    items = F.sort_array(F.collect_list(F.struct("seq", "text", "continues", "table_data")))
    g = r.groupBy(*DOC, "begin", "block_type").agg(items.alias("items"), F.min("image_name").alias("image_name"))

    # What joins two lines depends on the end of the text so far, which is the last line that isn't blank: each such line,
    # with the blank ones behind it, meets the next one, so that a block takes time by its lines alone.
    prose = ~image & ~table
    n = F.size("items")
    g = g.withColumn("starts", F.when(prose, F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | not_blank(F.get("items", i)["text"]))).otherwise(F.array().cast("array<int>")))

    def put(acc: Column, x: Column) -> Column:
        return F.when(acc == "", x["text"]).otherwise(T.join_lines(acc, x["text"], F.col("block_type"), x["continues"]))

    def unit(start: Column, k: Column) -> Column:
        end = F.coalesce(F.get("starts", k + 1), n)
        first = F.get("items", start)
        tail = F.when(end - start == 1, first["text"]).otherwise(F.aggregate(F.slice("items", start + 1, end - start), F.lit(""), put))
        return F.struct(first["text"].alias("text"), first["continues"].alias("continues"), tail.alias("tail"))

    g = g.withColumn("units", F.transform("starts", unit))

    def meet(x: Column, k: Column) -> Column:
        """The tail before a line with what parts them, and how much white space before the line goes."""
        a = F.get("units", k - 1)["tail"]

        def parted(joined: Column) -> Column:
            own = F.when(joined.endswith(x["text"]), x["text"]).otherwise(T.lstrip(x["text"]))
            return F.struct(F.left(joined, F.length(joined) - F.length(own)).alias("done"), (F.length(x["text"]) - F.length(own)).alias("cut"))

        # the one-element array binds the joined text to a variable, so that it is made once
        one = F.transform(F.array(T.join_lines(a, x["text"], F.col("block_type"), x["continues"])), parted)[0]
        return F.when((k == 0) | (a == ""), F.struct(F.lit("").alias("done"), F.lit(0).alias("cut"))).otherwise(one)

    g = g.withColumn("met", F.transform("units", meet))
    cut = lambda t, k: F.when(F.get("met", k)["cut"] > 0, F.substring(t, F.get("met", k)["cut"] + 1, F.length(t))).otherwise(t)
    done = F.transform("met", lambda x, k: F.when(k == 0, x["done"]).otherwise(cut(x["done"], k - 1)))
    last = F.size("units") - 1
    joined = F.concat(F.array_join(done, ""), cut(F.get("units", last)["tail"], last))
    text = F.when(table, F.array_join(F.transform("items", lambda x: x["text"]), "\n")).otherwise(joined)
    g = g.select(*DOC, "begin", "block_type", F.when(image, F.get("items", F.lit(0))["text"]).otherwise(T.block_surround(text, F.col("block_type"))).alias("text"), F.when(image, F.col("image_name")).alias("image_name"), F.when(table, F.array_join(F.transform("items", lambda x: x["table_data"]), "\n")).alias("table_data"))
    # a block comes out where the next one begins
    behind = W.partitionBy(*DOC).orderBy(F.desc("begin")).rowsBetween(W.unboundedPreceding, -1)
    out = F.coalesce(F.last(F.when(~image, F.col("begin")), True).over(behind), F.lit(2**31 - 1))
    g = g.withColumn("at", F.col("begin") if flush_at_images else F.when(image, F.col("begin")).otherwise(out))
    index = F.row_number().over(W.partitionBy(*DOC).orderBy("at")) - 1
    return g.select(*DOC, "block_type", "text", "image_name", "table_data", index.alias("index"))


def title_key(c: Column) -> Column:
    """A heading without its marks and without digits at its ends."""
    bare = T.strip(F.when(T.strip(c).startswith("#"), F.regexp_replace(c, "#+", "")).otherwise(c))
    return T.strip(F.regexp_replace(F.regexp_replace(bare, r"^\p{Nd}+", ""), r"\p{Nd}+\z", ""))


def indel_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths, in percent; 100 for two empty texts. Bits are rows."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & masks.get(ch, 0)
        s = (s + u | s - u) & full
    return 200.0 * (len(a) - s.bit_count()) / (len(a) + len(b))


def _edits(length: Column, similar: float) -> Column:
    """How many letters may be put in or left out between a title of this length and a similar one that isn't shorter."""
    longer = F.floor(length * F.lit((200.0 - similar) / similar) + 1e-9)
    return F.floor((length + longer) * F.lit(1.0 - similar / 100.0) + 1e-9).cast("int")


def _pairs_by_length(titles: DataFrame, similar: float) -> DataFrame:
    """The same by classes of lengths: similar texts are in the same class or in neighbouring ones."""
    apart = max((200.0 - similar) / similar, 1.0) * 1.000001
    kind = F.floor(F.log(F.greatest(F.length("t"), F.lit(1)).cast("double")) / F.log(F.lit(apart)))
    a = titles.select(*DOC, "t", F.explode(F.array(kind - 1, kind, kind + 1)).alias("kind"))
    b = titles.select(*DOC, F.col("t").alias("u"), kind.alias("kind"))
    nt, nu = F.length("t"), F.length("u")
    order = (nt < nu) | ((nt == nu) & (F.col("t") < F.col("u")))
    return a.join(b, [*DOC, "kind"]).filter(order & (2 * nt * 100 >= similar * (nt + nu))).select(*DOC, "t", "u")


def similar_pairs(titles: DataFrame, similar: float = 90.0) -> DataFrame:
    """doc_id, t, u: pairs of different titles of a document that may be similar, the shorter one first, each once.

    A title is cut into one segment more than letters may differ, so that a similar one holds a segment unchanged. With
    at most k letters put in or left out before the k-th segment, and the rest of them behind it, only few places are
    right for it. Segments are an index, which all substrings of their lengths in longer titles look up. Below 70 %
    segments could be empty, and titles of similar lengths all meet."""
    if similar < 70:
        return _pairs_by_length(titles, similar)
    apart = F.lit((200.0 - similar) / similar + 1e-9)
    d = titles.select(*DOC, "t", F.char_length("t").alias("n")).filter("n > 0")
    m = _edits(F.col("n"), similar) + 1
    q = F.floor(F.col("n") / m).cast("int")
    short = m - (F.col("n") - q * m)  # so many segments have q letters, the others one more
    index = d.select(*DOC, "t", F.col("n").alias("nt"), (m - 1).alias("edits"), F.explode(F.sequence(F.lit(0), m - 1)).alias("i"), q.alias("q"), short.alias("short"))
    start = F.col("i") * F.col("q") + F.greatest(F.col("i") - F.col("short"), F.lit(0))
    length = F.col("q") + (F.col("i") >= F.col("short")).cast("int")
    index = index.select(*DOC, "t", "nt", "edits", "i", start.alias("start"), F.substring("t", start + 1, length).alias("segment"))
    # the lengths that segments of titles have which this one may be similar to
    lengths = F.transform(F.sequence(F.greatest(F.ceil(F.col("n") / apart).cast("int"), F.lit(1)), F.col("n")), lambda x: F.floor(x / (_edits(x, similar) + 1)).cast("int"))
    every = F.array_distinct(F.concat(lengths, F.transform(lengths, lambda x: x + 1)))
    probe = d.select(*DOC, F.col("t").alias("u"), F.col("n").alias("nu"), F.explode(every).alias("size")).filter(F.col("size") <= F.col("nu"))
    probe = probe.select(*DOC, "u", "nu", "size", F.explode(F.sequence(F.lit(1), F.col("nu") - F.col("size") + 1)).alias("at"))
    probe = probe.select(*DOC, "u", "nu", (F.col("at") - 1).alias("at"), F.substring("u", F.col("at"), F.col("size")).alias("segment"))
    moved, more = F.col("at") - F.col("start"), F.col("nu") - F.col("nt")
    fits = (F.abs(moved) <= F.col("i")) & (F.abs(moved - more) <= F.col("edits") - F.col("i"))
    order = (F.col("nt") < F.col("nu")) | ((F.col("nt") == F.col("nu")) & (F.col("t") < F.col("u")))
    return index.join(probe, [*DOC, "segment"]).filter(order & fits & (F.col("nu") <= F.col("nt") * apart)).select(*DOC, "t", "u").distinct()


def common_titles(blocks: DataFrame, similar: float = 90.0, overlap: float = 0.05, exact: bool = False) -> DataFrame:
    """doc_id, index of headings that at least three others, and a share of all, resemble.

    Equal headings are one with a count first, so that a heading that stands on every page makes no pairs; different ones
    meet if they share a segment at a fitting place (`exact`: equal ones only)."""
    t = blocks.filter(F.col("block_type").isin(*T.HEADING_TYPES)).select(*DOC, "index", title_key(F.col("text")).alias("t"))
    n = t.groupBy(*DOC).agg(F.count(F.lit(1)).alias("titles"))
    c = t.groupBy(*DOC, "t").agg(F.count(F.lit(1)).alias("c"))
    if exact:
        total = c.select(*DOC, "t", (F.col("c") - 1).alias("others"))
    else:

        def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([indel_ratio(p, q) for p, q in zip(x, y)], dtype="float64")

        near = similar_pairs(c, similar).filter(F.pandas_udf(ratio, "double")("t", "u") >= similar)
        both = near.select(*DOC, "t", "u").unionByName(near.select(*DOC, F.col("u").alias("t"), F.col("t").alias("u")))
        more = both.join(c.select(*DOC, F.col("t").alias("u"), "c"), [*DOC, "u"]).groupBy(*DOC, "t").agg(F.sum("c").alias("more"))
        total = c.join(more, [*DOC, "t"], "left").select(*DOC, "t", (F.col("c") - 1 + F.coalesce("more", F.lit(0))).alias("others"))
    bad = total.join(n, DOC).filter(F.col("others") >= F.greatest(F.lit(3.0), F.col("titles") * overlap))
    return t.join(bad, [*DOC, "t"], "left_semi").select(*DOC, "index")


def full_text(blocks: DataFrame) -> DataFrame:
    """doc_id, text: a document's blocks, a blank line after Text and a line end after others."""
    w = W.partitionBy(*DOC).orderBy("index")
    sep = F.when(F.row_number().over(w) == 1, "").when(F.lag("block_type").over(w) == "Text", "\n\n").otherwise("\n")
    b = blocks.withColumn("piece", F.concat(sep, "text"))
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("index", "piece"))), lambda x: x["piece"])
    return b.groupBy(*DOC).agg(F.array_join(pieces, "").alias("text"))


# Chunk types by block type. The spelling of the section header is the observed one; it never occurs.
CHUNK_TYPES = {"Table": "table_csv", "Image": "image", "Title": "markdown_title", "Section-Header": "markdown_section_header"}


def chunk_id(doc: Column, index: Column) -> Column:
    return F.sha2(F.concat_ws("|", doc.cast("string"), index.cast("string")), 256)


def build_chunks(blocks: DataFrame, section_headers: bool = False) -> DataFrame:
    """One chunk per block: (doc_id, index, chunk_id, chunk_type, content, image_name, table_content)."""
    types = dict(CHUNK_TYPES) | ({"Section-header": "markdown_section_header"} if section_headers else {})
    kind = F.lit("markdown")
    for k, v in types.items():
        kind = F.when(F.col("block_type") == k, v).otherwise(kind)
    return blocks.select(*DOC, "index", chunk_id(F.col("doc_id"), F.col("index")).alias("chunk_id"), kind.alias("chunk_type"), F.col("text").alias("content"), "image_name", F.col("table_data").alias("table_content"))


def build_documents(chunks: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """doc_id, num_chunks, child_chunk_ids (in order), and the summary where texts (doc_id, text) are given."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct("index", "chunk_id"))), lambda x: x["chunk_id"])
    out = chunks.groupBy(*DOC).agg(F.count(F.lit(1)).cast("int").alias("num_chunks"), ids.alias("child_chunk_ids"))
    return out if texts is None else out.join(texts.select(*DOC, F.col("text").alias("summary")), DOC, "left")


def flatten_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks without those that have children, which stand in their place: (doc_id, place, chunk_id). One level."""
    top = chunks.filter("parent_chunk_id is null").select(*DOC, "index", "chunk_id")
    kids = chunks.filter("parent_chunk_id is not null").select(F.col("parent_chunk_id").alias("pid"), F.col("index").alias("kid"), F.col("chunk_id").alias("kid_id"))
    both = top.join(kids, F.col("chunk_id") == F.col("pid"), "left")
    order = W.partitionBy(*DOC).orderBy("index", "kid")
    return both.select(*DOC, (F.row_number().over(order) - 1).alias("place"), F.coalesce("kid_id", "chunk_id").alias("chunk_id"))


def page_text(spans: DataFrame) -> DataFrame:
    """doc_id, pnum, text: a page's text, lines parted by line ends."""
    order = F.struct("block_no", "line_no", "span_no", "text")
    line = F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["text"]), "")
    l = spans.groupBy(*PAGE, "block_no", "line_no").agg(line.alias("t"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_no", "line_no", "t"))), lambda x: x["t"]), "\n")
    return l.groupBy(*PAGE).agg(text.alias("text"))


def most_common_font(spans: DataFrame) -> DataFrame:
    """doc_id, pnum, block_no, line_no, font: a line's most frequent font, the first of equals."""
    f = spans.groupBy(*PAGE, "block_no", "line_no", "font").agg(F.count(F.lit(1)).alias("n"), F.min("span_no").alias("at"))
    return f.groupBy(*PAGE, "block_no", "line_no").agg(F.max(F.struct("n", (-F.col("at")).alias("at"), "font"))["font"].alias("font"))


# Which pages need recognition


def line_coverage(detected: DataFrame, lines: DataFrame, overlap: float = 0.5, share: float = 0.4) -> DataFrame:
    """doc_id, pnum, found, total, covered: how many detected lines (in page units) are mostly covered by text lines."""
    from ..functions import geometry as G

    # lines that nothing covers stay in the join, so that they needn't be made again
    b = lines.select(F.col("doc_id").alias("b_doc"), F.col("pnum").alias("b_page"), *[F.col(c).alias("b" + c) for c in ("x0", "y0", "x1", "y1")])
    on = (F.col("doc_id") == F.col("b_doc")) & (F.col("pnum") == F.col("b_page")) & G.intersects(G.box(), G.box("b"))
    d = detected.join(b, on, "left").groupBy(*PAGE, "line_idx").agg(F.sum(F.when(F.col("b_page").isNotNull(), G.intersection_pct(G.box(), G.box("b")))).alias("pct"))
    out = d.groupBy(*PAGE).agg(F.count_if(F.coalesce("pct", F.lit(0.0)) > overlap).alias("found"), F.count(F.lit(1)).alias("total"))
    return out.withColumn("covered", F.col("found") / F.col("total") > share)


def no_text(pages: DataFrame) -> DataFrame:
    """doc_id, no_text: documents all of whose pages are blank."""
    return pages.groupBy(*DOC).agg((~F.max(not_blank(F.col("text")))).alias("no_text"))


def ocr_needed(pages: DataFrame, coverage: DataFrame, every: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, pnum, needed, and columns of the pages to keep: pages with detected lines whose text is missing, bad or covers
    too few of them."""
    # what the document needs to know of its pages is read off them once
    blank, bad = ~not_blank(F.col("text")), (F.length("text") > 0) & T.bad_ocr(F.col("text"))
    p = pages.filter(F.col("doc_id").isNotNull()).select(*PAGE, *keep, blank.alias("blank"), bad.alias("bad"))
    p = p.withColumn("no_text", F.min("blank").over(W.partitionBy(*DOC))).join(coverage, PAGE, "left")
    return p.select(*PAGE, *keep, F.coalesce((F.col("total") > 0) & (F.col("no_text") | F.col("bad") | ~F.col("covered") | F.lit(every)), F.lit(False)).alias("needed"))


def ocr_replace(pages: DataFrame, needed: DataFrame, recognised: DataFrame) -> DataFrame:
    """Pages with recognised text where it was needed and isn't bad: (doc_id, pnum, text, asked, replaced)."""
    r = recognised.select(*PAGE, F.col("text").alias("new"))
    return ocr_replaced(pages.join(needed, PAGE, "left").join(r, PAGE, "left"))


def ocr_replaced(pages: DataFrame) -> DataFrame:
    """The same for pages that have `needed` and the recognised text, `new`, beside their text."""
    j = pages.withColumn("asked", F.coalesce("needed", F.lit(False)))
    good = F.col("asked") & F.col("new").isNotNull() & ~F.coalesce(T.bad_ocr(F.col("new")), F.lit(True))
    return j.select(*PAGE, F.when(good, F.col("new")).otherwise(F.col("text")).alias("text"), "asked", good.alias("replaced"))


def ocr_stats(replaced: DataFrame, engine: str = "model") -> DataFrame:
    """doc_id, ocr_pages, ocr_success, ocr_failed, ocr_engine."""
    out = replaced.groupBy(*DOC).agg(F.count_if("asked").alias("ocr_pages"), F.count_if("replaced").alias("ocr_success"))
    return out.withColumn("ocr_failed", F.col("ocr_pages") - F.col("ocr_success")).withColumn("ocr_engine", F.when(F.col("ocr_pages") > 0, engine).otherwise("none"))
