"""Page-local operators over the stage tables. Joins are by page, so that an overlap test never meets two pages.

Tables: spans(doc_id, pnum, block_no, line_no, span_no, span_id, text, font, font_size, font_weight, x0..y1),
lines and blocks (envelopes of the same), boxes(doc_id, pnum, box_idx, label, x0..y1 in image units)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geometry as G
from ..functions import text as T

PAGE = ["doc_id", "pnum"]
XY = ("x0", "y0", "x1", "y1")


def to_page(boxes: DataFrame, image: tuple[float, ...], page: tuple[float, ...]) -> DataFrame:
    """Boxes of an image in the units of its page."""
    moved = G.rescale(G.box(), G.literal(*image), G.literal(*page))
    return boxes.withColumns(dict(zip(XY, moved)))


def _as(boxes: DataFrame, *keep: str) -> DataFrame:
    return boxes.select(*PAGE, *keep, *[F.col(c).alias("b" + c) for c in XY])


def not_blank(c: Column) -> Column:
    return T.strip(c) != ""


def align_spans(spans: DataFrame) -> DataFrame:
    """Spans that aren't blank, with the envelopes of their lines (l*) and blocks (b*) drawn anew."""
    kept = spans.filter(not_blank(F.col("text")))
    line, block = W.partitionBy(*PAGE, "block_no", "line_no"), W.partitionBy(*PAGE, "block_no")
    for p, w in (("l", line), ("b", block)):
        kept = kept.withColumns({f"{p}{c}": (F.min if c[1] == "0" else F.max)(c).over(w) for c in XY})
    return kept


def align_chars(chars: DataFrame) -> DataFrame:
    """Envelopes of spans over their characters that aren't blank; spans without such go."""
    return chars.filter(not_blank(F.col("ch"))).groupBy(*PAGE, "block_no", "line_no", "span_no").agg(*G.closure(), F.count(F.lit(1)).alias("n_chars"))


def watermark_texts(spans: DataFrame, threshold: float | int = 0.4, least_spans: int = 10) -> DataFrame:
    """doc_id, pnum, mark, freq: texts that occur on a page more often than the threshold. A whole number is a count; a
    fraction is one of the page's number of different texts. Pages of few spans have none."""
    freq = spans.groupBy(*PAGE, T.strip(F.col("text")).alias("mark")).agg(F.count(F.lit(1)).alias("freq"))
    page = W.partitionBy(*PAGE)
    f = freq.withColumn("n", F.sum("freq").over(page)).withColumn("k", F.count(F.lit(1)).over(page))
    limit = F.lit(threshold) if isinstance(threshold, int) else F.lit(threshold) * F.col("k")
    return f.filter((F.col("n") >= least_spans) & (F.col("freq") > limit)).select(*PAGE, "mark", "freq")


def remove_watermarks(spans: DataFrame, threshold: float | int = 0.4, least_spans: int = 10) -> DataFrame:
    marks = watermark_texts(spans, threshold, least_spans).select(*PAGE, "mark")
    return spans.withColumn("mark", T.strip(F.col("text"))).join(marks, [*PAGE, "mark"], "left_anti").drop("mark")


def _best_box(things: DataFrame, keys: list[str], boxes: DataFrame, value: str) -> DataFrame:
    """Things with the value of the box that covers most of each; the earliest box wins ties, and the page's first box is
    taken where none covers any.

    Everything is dealt by page once: the join, the choice and the fallback need no other shuffle. Only boxes that meet a
    thing go into the choice; the others could win only by being the first."""
    b = boxes.select(F.col("doc_id").alias("b_doc"), F.col("pnum").alias("b_page"), F.col("box_idx").alias("b_idx"), F.col(value).alias("b_value"), *[F.col(c).alias("b" + c) for c in XY])
    on = (F.col("doc_id") == F.col("b_doc")) & (F.col("pnum") == F.col("b_page")) & G.intersects(G.box(), G.box("b"))
    pct = G.intersection_pct(G.box(), G.box("b"))
    best = F.max(F.when(pct > 0, F.struct(pct.alias("pct"), (-F.col("b_idx")).alias("i"), F.col("b_value").alias("v"))))
    rest = [F.first(c).alias(c) for c in things.columns if c not in keys]
    got = things.join(b, on, "left").groupBy(*keys).agg(*rest, best.alias("b_best"))
    first = boxes.groupBy(*PAGE).agg(F.min(F.struct("box_idx", value)).alias("m")).select(*PAGE, F.col(f"m.{value}").alias("b_first"))
    return got.join(first, PAGE, "left").withColumn(value, F.coalesce("b_best.v", "b_first")).drop("b_best", "b_first")


def annotate_blocks(blocks: DataFrame, boxes: DataFrame) -> DataFrame:
    """Blocks with the label of their layout box as block_type; Text on pages without boxes."""
    got = _best_box(blocks, [*PAGE, "block_no"], boxes, "label")
    return got.withColumn("block_type", F.coalesce("label", F.lit("Text"))).drop("label")


def group_key(y0: Column, tolerance: float = 1.25) -> Column:
    return G.half_even(y0 / tolerance) * tolerance


def reading_order(blocks: DataFrame, boxes: DataFrame) -> DataFrame:
    """Blocks with their place in reading order: by the position of their order box, then from top to bottom and left to
    right. On pages without order boxes they keep their order."""
    got = _best_box(blocks, [*PAGE, "block_no"], boxes, "position")
    key = F.coalesce("position", F.col("block_no"))
    order = W.partitionBy(*PAGE).orderBy(key, group_key(F.col("y0")), "x0", "block_no")
    return got.withColumn("place", F.row_number().over(order) - 1)


def sort_blocks(blocks: DataFrame, by: list[str], tolerance: float = 1.25) -> DataFrame:
    """Place of each block within `by`: rows of about the same height, from left to right."""
    order = W.partitionBy(*by).orderBy(group_key(F.col("y0"), tolerance), "x0", "block_no")
    return blocks.withColumn("place", F.row_number().over(order) - 1)


def sort_table_blocks(blocks: DataFrame, by: list[str], tolerance: float = 5) -> DataFrame:
    order = W.partitionBy(*by).orderBy(G.half_even((F.col("y0") + F.col("y1")) / 2 / tolerance), "x0", "block_no")
    return blocks.withColumn("place", F.row_number().over(order) - 1)


def nearest_block(boxes: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, pnum, box_idx, block_no: the block whose top left corner is nearest; the first of equals; 0 without any."""
    b = blocks.select(*PAGE, "block_no", F.col("x0").alias("kx"), F.col("y0").alias("ky"))
    dist = F.sqrt((F.col("ky") - F.col("y0")) ** 2 + (F.col("kx") - F.col("x0")) ** 2)
    near = boxes.join(b, PAGE, "left").groupBy(*PAGE, "box_idx").agg(F.min(F.when(F.col("block_no").isNotNull(), F.struct(dist.alias("d"), "block_no"))).alias("m"))
    return near.select(*PAGE, "box_idx", F.coalesce(F.col("m.block_no"), F.lit(0)).alias("block_no"))


def covered_lines(lines: DataFrame, boxes: DataFrame, share: float = 0.7) -> DataFrame:
    """Lines of which a box covers more than the share, once for every such box."""
    both = lines.join(_as(boxes, "box_idx", "label"), PAGE).filter(G.intersects(G.box(), G.box("b")))
    return both.filter(G.intersection_pct(G.box(), G.box("b")) > share)


def insert_points(boxes: DataFrame, lines: DataFrame, blocks: DataFrame, share: float = 0.7, **more: Column) -> DataFrame:
    """doc_id, pnum, box_idx, label, block_no, line_no, n_lines: where a region's replacement goes. That is the first line
    that it covers, else the beginning of the nearest block. `more` are further aggregates of the covered lines."""
    hit = covered_lines(lines, boxes, share).groupBy(*PAGE, "box_idx").agg(F.min(F.struct("block_no", "line_no")).alias("m"), F.count(F.lit(1)).alias("n_lines"), *[c.alias(k) for k, c in more.items()])
    near = nearest_block(boxes, blocks).withColumnRenamed("block_no", "near")
    out = boxes.join(hit, [*PAGE, "box_idx"], "left").join(near, [*PAGE, "box_idx"])
    return out.select(*PAGE, "box_idx", "label", F.coalesce(F.col("m.block_no"), F.col("near")).alias("block_no"), F.coalesce(F.col("m.line_no"), F.lit(0)).alias("line_no"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), *more)


def image_spans(boxes: DataFrame, lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """One span for each picture region: its file name, markdown and place."""
    regions = boxes.filter(F.col("label").isin("Figure", "Picture"))
    at = insert_points(regions, lines, blocks)
    n = F.row_number().over(W.partitionBy(*PAGE).orderBy("box_idx")) - 1
    name = F.concat(F.col("pnum"), F.lit("_image_"), n, F.lit(".png"))
    return at.withColumn("image_name", name).withColumn("text", F.concat(F.lit("\n\n!["), "image_name", F.lit("]("), "image_name", F.lit(")\n\n"))).drop("n_lines")


def equation_regions(boxes: DataFrame, lines: DataFrame, blocks: DataFrame, count=F.octet_length, limit: int = 384) -> DataFrame:
    """Formula regions with their place, source text, the numbers of the lines that they cover (`covers`, null without any),
    token count, and whether they are short enough to be replaced."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_no", "line_no", "text"))), lambda x: x["text"]), " ")
    at = insert_points(boxes.filter("label = 'Formula'"), lines, blocks, source=text, covers=F.collect_set("line_no"))
    out = at.withColumn("source", F.coalesce("source", F.lit("")))
    return out.withColumn("tokens", count(F.col("source"))).withColumn("replaced", F.col("tokens") < limit).drop("label")


def batch_limits(regions: DataFrame, by: list[str], order: list[str], batch: int = 6, most: int = 384, buffer: int = 256) -> DataFrame:
    """Regions with max_length, the number of tokens that their model batch may give: the batch's longest source, at most
    `most`, and a buffer."""
    i = F.floor((F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1) / batch)
    out = regions.withColumn("batch", i)
    longest = F.max("tokens").over(W.partitionBy(*by, "batch"))
    return out.withColumn("max_length", F.least(longest, F.lit(most)) + buffer).drop("batch")


def unless_run_on(output: Column, max_length: Column, count=F.octet_length) -> Column:
    """A model's output, empty if it was cut off by its limit."""
    return F.when(count(output) >= max_length - 1, "").otherwise(output)


def accept_equations(regions: DataFrame, predicted: str = "predicted", count=F.octet_length, limit: int = 384) -> DataFrame:
    """Regions with their final text: the prediction, unless it ran on, is much shorter than the source, or is blank."""
    p = F.col(predicted)
    ok = (count(p) < limit) & (F.length(p) > F.length("source") * 0.7) & not_blank(p)
    return regions.withColumn("accepted", ok).withColumn("text", F.replace(F.when(ok, p).otherwise(F.col("source")), F.lit("\n"), F.lit(" ")))


def insert_equations(lines: DataFrame, accepted: DataFrame) -> DataFrame:
    """Lines of a page with formula lines in their places: (doc_id, pnum, seq, block_no, kind, text).

    A formula stands before the line at its place; covered lines are expected to be gone."""
    a = lines.select(*PAGE, "block_no", "line_no", F.lit(1).alias("rank"), F.lit(0).alias("box_idx"), F.lit("line").alias("kind"), "text")
    b = accepted.select(*PAGE, "block_no", "line_no", F.lit(0).alias("rank"), "box_idx", F.lit("Formula").alias("kind"), "text")
    order = W.partitionBy(*PAGE).orderBy("block_no", "line_no", "rank", "box_idx")
    return a.unionByName(b).withColumn("seq", F.row_number().over(order) - 1).drop("rank", "line_no", "box_idx")


def split_headings(lines: DataFrame, boxes: DataFrame, share: float = 0.7) -> DataFrame:
    """Lines of Text blocks in new blocks: a line that a heading box covers is a block of its own with the box's label
    (the first such box); what stands between such lines stays together. Other blocks stay. Needs block_type."""
    # a page's headings come to its lines as an array, so that lines are taken once
    heads = _as(boxes.filter(F.col("label").isin(*T.HEADING_TYPES)), "box_idx", "label").groupBy(*PAGE).agg(F.collect_list(F.struct("box_idx", "label", *["b" + c for c in XY])).alias("heads"))
    box = lambda h: tuple(h["b" + c] for c in XY)
    covers = F.filter("heads", lambda h: G.intersects(G.box(), box(h)) & (G.intersection_pct(G.box(), box(h)) > share))
    first = F.when(F.col("block_type") == "Text", F.array_min(covers)["label"])
    l = lines.join(heads, PAGE, "left").select(*lines.columns, first.alias("head"))
    w = W.partitionBy(*PAGE, "block_no").orderBy("line_no")
    begins = F.col("head").isNotNull() | F.lag("head").over(w).isNotNull()
    part = F.sum(begins.cast("int")).over(w)
    out = l.withColumn("part", part).withColumn("block_type", F.coalesce("head", "block_type")).drop("head")
    return out.withColumn("new_block_no", F.dense_rank().over(W.partitionBy(*PAGE).orderBy("block_no", "part")) - 1).drop("part")


def code_indent(lines: DataFrame) -> DataFrame:
    """Text of code blocks, indented by the width of their first character; of several blank lines in a row one stays.

    lines need first_width, the character width of their first span that isn't empty (null if all are)."""
    block = W.partitionBy(*PAGE, "block_no")
    run = block.orderBy("line_no")
    left = F.least(F.min("x0").over(block), F.lit(1000.0))
    width = F.first("first_width", ignorenulls=True).over(run.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    blank = ~not_blank(F.col("text"))
    l = lines.withColumn("left", left).withColumn("width", width).withColumn("blank", blank).withColumn("before", F.lag("blank").over(run))
    l = l.filter(~(F.col("blank") & F.coalesce("before", F.lit(False))))
    prefix = F.when(F.coalesce("width", F.lit(0.0)) == 0, "").otherwise(F.repeat(F.lit(" "), ((F.col("x0") - F.col("left")) / F.col("width")).cast("int")))
    text = F.transform(F.sort_array(F.collect_list(F.struct("line_no", F.concat(prefix, "text", F.lit("\n")).alias("t")))), lambda x: x["t"])
    return l.groupBy(*PAGE, "block_no").agg(F.array_join(text, "").alias("text"))


def emphasis(spans: DataFrame) -> DataFrame:
    """Span texts with markdown emphasis: longer than three characters, neither first nor last of their line, and the next
    span of weight (longer than two, or the last) without the same style. Italics come before bold."""
    line = W.partitionBy(*PAGE, "block_no", "line_no").orderBy("span_no")
    after = line.rowsBetween(1, W.unboundedFollowing)
    heavy = F.length(T.strip(F.col("text"))) > 2
    out = spans
    for style in ("bold", "italic"):
        following = F.coalesce(F.first(F.when(heavy, F.col(style)), ignorenulls=True).over(after), F.last(style).over(after), F.lit(False))
        out = out.withColumn(f"next_{style}", following)
    out = out.withColumn("n", F.count(F.lit(1)).over(W.partitionBy(*PAGE, "block_no", "line_no"))).withColumn("i", F.row_number().over(line) - 1)
    fit = (F.length("text") > 3) & (F.col("i") > 0) & (F.col("i") < F.col("n") - 1)
    marked = F.when(fit & F.col("italic") & ~F.col("next_italic"), T.surround_text(F.col("text"), "*")).when(fit & F.col("bold") & ~F.col("next_bold"), T.surround_text(F.col("text"), "**")).otherwise(F.col("text"))
    return out.withColumn("text", marked).drop("next_bold", "next_italic", "n", "i")


def split_block(lines: DataFrame, at: Column) -> DataFrame:
    """Lines with the part (0 or 1) of their block that they go to; a place before the first or after the last line
    leaves the block whole. `at` counts from the block's first line."""
    w = W.partitionBy(*PAGE, "block_no")
    i = F.row_number().over(w.orderBy("line_no")) - 1
    n = F.count(F.lit(1)).over(w)
    return lines.withColumn("part", F.when((at <= 0) | (at >= n) | (i < at), 0).otherwise(1))


def filter_spans(spans: DataFrame, bad: DataFrame, types: tuple[str, ...] = ("Page-footer", "Page-header", "Picture"), by_id_only: bool = False) -> DataFrame:
    """Spans that aren't named in `bad` (doc_id, pnum, span_id) and aren't in a block of the named types. Ids repeat on
    other pages; with `by_id_only` they count on all pages of the document."""
    keys = ["doc_id", "span_id"] if by_id_only else [*PAGE, "span_id"]
    return spans.join(bad.select(*keys).distinct(), keys, "left_anti").filter(~F.col("block_type").isin(*types))


def normalize_extract(spans: DataFrame) -> DataFrame:
    """An extractor's spans in page form: text cleaned, font name with its flags, ids by page, lines of negative area gone.

    Needs lx0..ly1 (line box), font_name, flags, rotation, page_width, page_height; turned pages swap their sides."""
    number = F.row_number().over(W.partitionBy(*PAGE).orderBy("block_no", "line_no", "span_no")) - 1
    out = spans.withColumn("span_id", F.concat_ws("_", F.col("pnum").cast("string"), number.cast("string")))
    out = out.filter((F.col("lx1") - F.col("lx0")) * (F.col("ly1") - F.col("ly0")) >= 0)
    turned = F.col("rotation").isin(90, 270)
    return out.withColumns({"text": T.span_text(F.col("text")), "font": F.concat_ws("_", "font_name", T.font_flags(F.col("flags"))), "page_width": F.when(turned, F.col("page_height")).otherwise(F.col("page_width")), "page_height": F.when(turned, F.col("page_width")).otherwise(F.col("page_height"))})


def page_range(pages: DataFrame, start: int = 0, most: int | None = None) -> DataFrame:
    """Pages from `start`, at most so many; beyond the last page there are none."""
    out = pages.filter(F.col("pnum") >= start)
    return out if not most else out.filter(F.col("pnum") < start + most)
