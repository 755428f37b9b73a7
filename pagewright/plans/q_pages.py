"""Queries of the page operators over synthetic layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import page as P
from ..operators import tables as TB
from ..session import scratch
from . import synthetic as S
from .q_geometry import WITH
from .registry import query

KEY = ["doc_id", "pnum"]
XY = ("x0", "y0", "x1", "y1")
NL = "\n"


def _page_boxes(blocks):
    return P.to_page(S.layout_boxes(blocks), S.IMAGE_BOX, S.PAGE_BOX)


_BLANK = "bl as (select * replace (case when (line_no * 3 + span_no + block_no) % 17 = 0 then '  ' else text end as text) from spans)"


def _blank(spans):
    return spans.withColumn("text", F.when((F.col("line_no") * 3 + F.col("span_no") + F.col("block_no")) % 17 == 0, "  ").otherwise(F.col("text")))


@query(WITH + f", {_BLANK}, k as (select * from bl where trim(text) <> '')\nselect doc_id, pnum, span_id, min(x0) over l lx0, max(y1) over l ly1, min(x0) over b bx0, min(y0) over b by0, max(x1) over b bx1, max(y1) over b by1 from k window l as (partition by doc_id, pnum, block_no, line_no), b as (partition by doc_id, pnum, block_no)")
def align_spans(spark, sf_dir):
    return P.align_spans(_blank(S.spans(spark, sf_dir))).select(*KEY, "span_id", "lx0", "ly1", "bx0", "by0", "bx1", "by1")


@query(WITH + ", c as (select doc_id, pnum, block_no, line_no, span_no, unnest(range(0, length(text))) i, text, x0, y0, y1 from spans), d as (select *, text[i + 1] ch, x0 + 3 * i a from c)\nselect doc_id, pnum, line_no, span_no, min(a) x0, max(a + 3) x1, count(*) n_chars from d where ch <> ' ' group by all")
def align_chars(spark, sf_dir):
    return P.align_chars(_chars(S.spans(spark, sf_dir))).select(*KEY, "line_no", "span_no", "x0", "x1", "n_chars")


def _chars(spans):
    """One row per character, three units wide."""
    c = spans.filter("text <> ''").select(*KEY, "block_no", "line_no", "span_no", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1)).alias("char_no"), F.col("x0").alias("sx"), "y0", "y1")
    return c.select(*KEY, "block_no", "line_no", "span_no", "char_no", F.col("text").substr(F.col("char_no") + 1, F.lit(1)).alias("ch"), (F.col("sx") + 3 * F.col("char_no")).alias("x0"), "y0", (F.col("sx") + 3 * F.col("char_no") + 3).alias("x1"), "y1")


_MARKED = """wm as (select doc_id, pnum, 900 block_no, 0 line_no, unnest(range(0, 30)) span_no, ' DRAFT' as text from (select distinct doc_id, pnum from spans where doc_id % 4 = 0)),
mk as (select doc_id, pnum, block_no, line_no, cast(span_no as int) span_no, text from spans union all select doc_id, pnum, block_no, line_no, cast(span_no as int), text from wm)"""


def _marked(spans):
    """A stamp thirty times on the pages of every fourth document."""
    pages = spans.filter("doc_id % 4 = 0").select(*KEY).distinct()
    stamp = pages.select(*KEY, F.lit(900).alias("block_no"), F.lit(0).alias("line_no"), F.explode(F.sequence(F.lit(0), F.lit(29))).alias("span_no"), F.lit(" DRAFT").alias("text"))
    return spans.select(*KEY, "block_no", "line_no", "span_no", "text").unionByName(stamp)


def _sql_marks(cond):
    return f"f as (select doc_id, pnum, trim(text) mark, count(*) freq from mk group by all), k as (select *, sum(freq) over p n, count(*) over p k from f window p as (partition by doc_id, pnum)), w as (select doc_id, pnum, mark, freq from k where n >= 10 and {cond})"


@query(WITH + f", {_MARKED}, {_sql_marks('freq > 0.4::double * k')}\nselect * from w")
def watermark_texts(spark, sf_dir):
    return P.watermark_texts(_marked(S.spans(spark, sf_dir)))


@query(WITH + f", {_MARKED}, {_sql_marks('freq > 20')}\nselect m.doc_id, m.pnum, m.block_no, m.line_no, m.span_no, m.text from mk m anti join w on m.doc_id = w.doc_id and m.pnum = w.pnum and trim(m.text) = w.mark")
def watermark_removed(spark, sf_dir):
    return P.remove_watermarks(_marked(S.spans(spark, sf_dir)), 20)


_BEST = """met as (select a.doc_id, a.pnum, a.block_no, b.box_idx, b.{v}, {pct} pct from blocks a join {boxes} b using (doc_id, pnum)),
rnk as (select *, row_number() over (partition by doc_id, pnum, block_no order by pct desc, box_idx) r from met),
best as (select a.*, rnk.{v} from blocks a left join rnk on rnk.doc_id = a.doc_id and rnk.pnum = a.pnum and rnk.block_no = a.block_no and rnk.r = 1)"""
_TYPED = _BEST.format(v="label", pct=S.sql_pct("a", "b"), boxes="pboxes") + ",\ntyped as (select * exclude (label), coalesce(label, 'Text') as block_type from best)"


@query(WITH + f", {_TYPED}\nselect doc_id, pnum, block_no, block_type from typed")
def annotate_blocks(spark, sf_dir):
    b = S.block_table(spark, sf_dir)
    return P.annotate_blocks(b, _page_boxes(b)).select(*KEY, "block_no", "block_type")


_ORDER = "ob as (select *, case when pnum % 2 = 1 then 1000 - box_idx else box_idx end as position from pboxes where box_idx < 1000)"


def _order_boxes(boxes):
    return boxes.filter("box_idx < 1000").withColumn("position", F.when(F.col("pnum") % 2 == 1, 1000 - F.col("box_idx")).otherwise(F.col("box_idx")))


@query(WITH + f", {_ORDER}, {_BEST.format(v='position', pct=S.sql_pct('a', 'b'), boxes='ob')}\nselect doc_id, pnum, block_no, cast(row_number() over (partition by doc_id, pnum order by coalesce(position, block_no), round_even(y0 / 1.25::double, 0) * 1.25::double, x0, block_no) - 1 as int) as place from best")
def reading_order(spark, sf_dir):
    b = S.block_table(spark, sf_dir)
    return P.reading_order(b, _order_boxes(_page_boxes(b))).select(*KEY, "block_no", "place")


@query(WITH + "select doc_id, pnum, span_id, cast(row_number() over (partition by doc_id, pnum order by round_even((y0 + span_no) / 1.25::double, 0) * 1.25::double, x0, line_no, span_no) - 1 as int) as place from spans")
def sort_block_group(spark, sf_dir):
    s = S.spans(spark, sf_dir).withColumn("y0", F.col("y0") + F.col("span_no")).withColumn("block_no", F.struct("line_no", "span_no"))
    return P.sort_blocks(s, KEY).select(*KEY, "span_id", "place")


@query(WITH + "select doc_id, pnum, span_id, cast(row_number() over (partition by doc_id, pnum order by round_even((y0 + y1) / 2 / 5, 0), x0, line_no, span_no) - 1 as int) as place from spans")
def sort_table_blocks(spark, sf_dir):
    s = S.spans(spark, sf_dir).withColumn("block_no", F.struct("line_no", "span_no"))
    return P.sort_table_blocks(s, KEY).select(*KEY, "span_id", "place")


@query(WITH + ", n as (select b.doc_id, b.pnum, b.box_idx, a.block_no, row_number() over (partition by b.doc_id, b.pnum, b.box_idx order by sqrt((a.y0 - b.y0 - 20) ** 2 + (a.x0 - b.x0) ** 2), a.block_no) r from pboxes b join blocks a using (doc_id, pnum))\nselect doc_id, pnum, box_idx, block_no from n where r = 1")
def nearest_block(spark, sf_dir):
    b = S.block_table(spark, sf_dir)
    return P.nearest_block(_page_boxes(b).withColumn("y0", F.col("y0") + 20), b)


@query(WITH + "select doc_id, pnum, block_no, line_no, case when cut <= 0 or cut >= n or i < cut then 0 else 1 end as part from (select doc_id, pnum, block_no, line_no, row_number() over w - 1 i, count(*) over (partition by doc_id, pnum, block_no) n, block_no % 4 as cut from lines window w as (partition by doc_id, pnum, block_no order by line_no))")
def split_block(spark, sf_dir):
    return P.split_block(S.line_table(spark, sf_dir), F.col("block_no") % 4).select(*KEY, "block_no", "line_no", "part")


_REGIONS = """cov as (select a.doc_id, a.pnum, a.block_no, a.line_no, a.text, b.box_idx, b.label from lines a join pboxes b using (doc_id, pnum) where {pct} > 0.7),
hit as (select doc_id, pnum, box_idx, min((block_no, line_no)) m, count(*) n_lines from cov group by all),
nn as (select b.doc_id, b.pnum, b.box_idx, a.block_no, row_number() over (partition by b.doc_id, b.pnum, b.box_idx order by sqrt((a.y0 - b.y0) ** 2 + (a.x0 - b.x0) ** 2), a.block_no) r from pboxes b join blocks a using (doc_id, pnum)),
pts as (select b.doc_id, b.pnum, b.box_idx, b.label, coalesce(hit.m[1], nn.block_no) block_no, coalesce(hit.m[2], 0) line_no from pboxes b left join hit using (doc_id, pnum, box_idx) join nn on nn.doc_id = b.doc_id and nn.pnum = b.pnum and nn.box_idx = b.box_idx and nn.r = 1)""".replace("{pct}", S.sql_pct("a", "b"))


def _layout(spark, sf_dir):
    s, lines, b = S.layout(spark, sf_dir)
    return s, lines, b, _page_boxes(b)


@query(WITH + f", {_REGIONS}, i as (select *, pnum || '_image_' || (row_number() over (partition by doc_id, pnum order by box_idx) - 1) || '.png' image_name from pts where label in ('Figure', 'Picture'))\nselect doc_id, pnum, box_idx, block_no, line_no, image_name, chr(10) || chr(10) || '![' || image_name || '](' || image_name || ')' || chr(10) || chr(10) as text from i")
def image_spans(spark, sf_dir):
    _, lines, blocks, boxes = _layout(spark, sf_dir)
    return P.image_spans(boxes, lines, blocks).select(*KEY, "box_idx", "block_no", "line_no", "image_name", "text")


_EQ = _REGIONS + """, src as (select doc_id, pnum, box_idx, string_agg(text, ' ' order by block_no, line_no) source from cov where label = 'Formula' group by all),
eq as (select p.doc_id, p.pnum, p.box_idx, p.block_no, p.line_no, coalesce(source, '') source, cast(octet_length(encode(coalesce(source, ''))) as int) tokens from pts p left join src using (doc_id, pnum, box_idx) where label = 'Formula'),
ac as (select *, case when box_idx % 3 = 0 then '' when box_idx % 3 = 1 then '$$' || source || '$$' else source[1:5] end predicted from eq where tokens < 384),
acc as (select *, octet_length(encode(predicted)) < 384 and length(predicted) > length(source) * 0.7::double and trim(predicted) <> '' accepted from ac)"""


@query(WITH + f", {_EQ}\nselect doc_id, pnum, box_idx, block_no, line_no, source, tokens, tokens < 384 as replaced from eq")
def equation_regions(spark, sf_dir):
    _, lines, blocks, boxes = _layout(spark, sf_dir)
    return P.equation_regions(boxes, lines, blocks).select(*KEY, "box_idx", "block_no", "line_no", "source", "tokens", "replaced")


def _accepted(spark, sf_dir):
    _, lines, blocks, boxes = _layout(spark, sf_dir)
    eq = P.equation_regions(boxes, lines, blocks).filter("replaced")
    third = F.col("box_idx") % 3
    guess = F.when(third == 0, "").when(third == 1, F.concat(F.lit("$$"), "source", F.lit("$$"))).otherwise(F.substring("source", 1, 5))
    return P.accept_equations(eq.withColumn("predicted", guess)), lines, boxes


@query(WITH + f", {_EQ}\nselect doc_id, pnum, box_idx, accepted, replace(case when accepted then predicted else source end, chr(10), ' ') as text from acc")
def equation_accept(spark, sf_dir):
    return _accepted(spark, sf_dir)[0].select(*KEY, "box_idx", "accepted", "text")


@query(WITH + f""", {_EQ}, gone as (select distinct c.doc_id, c.pnum, c.line_no from cov c join ac using (doc_id, pnum, box_idx)),
every as (select doc_id, pnum, block_no, line_no, 1 rk, 0 box_idx, 'line' kind, text from lines anti join gone using (doc_id, pnum, line_no)
  union all select doc_id, pnum, block_no, line_no, 0, box_idx, 'Formula', replace(case when accepted then predicted else source end, chr(10), ' ') from acc)
select doc_id, pnum, cast(row_number() over (partition by doc_id, pnum order by block_no, line_no, rk, box_idx) - 1 as int) seq, block_no, kind, text from every""")
def equation_insert(spark, sf_dir):
    found, lines, _ = _accepted(spark, sf_dir)
    # formulas are found once: they take lines away and come in
    path = scratch(spark, "equations")
    found.select(*KEY, "box_idx", "block_no", "line_no", "covers", "text").write.parquet(path)
    accepted = spark.read.parquet(path)
    gone = accepted.select(*KEY, F.explode("covers").alias("line_no")).distinct()
    return P.insert_equations(lines.join(gone, [*KEY, "line_no"], "left_anti"), accepted).select(*KEY, "seq", "block_no", "kind", "text")


@query(WITH + f", {_EQ}\nselect doc_id, count(*) as equations, cast(count_if(accepted) as bigint) as successful, cast(count_if(not accepted) as bigint) as failed from acc group by doc_id")
def equation_stats(spark, sf_dir):
    a = _accepted(spark, sf_dir)[0]
    return a.groupBy("doc_id").agg(F.count(F.lit(1)).alias("equations"), F.count_if("accepted").alias("successful"), F.count_if(~F.col("accepted")).alias("failed"))


@query(WITH + f""", {_TYPED}, tl as (select l.*, t.block_type from lines l join typed t using (doc_id, pnum, block_no)),
hb as (select doc_id, pnum, box_idx, case when label in ('Caption', 'Text') then 'Title' else label end label, x0, y0, x1, case when label in ('Caption', 'Text') then y0 + 13 else y1 end y1 from pboxes),
hc as (select a.doc_id, a.pnum, a.line_no, b.label, row_number() over (partition by a.doc_id, a.pnum, a.line_no order by b.box_idx) r from tl a join hb b using (doc_id, pnum) where a.block_type = 'Text' and b.label in ('Title', 'Section-header') and {S.sql_pct('a', 'b')} > 0.7),
hl as (select tl.*, hc.label head from tl left join hc on hc.doc_id = tl.doc_id and hc.pnum = tl.pnum and hc.line_no = tl.line_no and hc.r = 1),
pt as (select *, sum(flag) over (partition by doc_id, pnum, block_no order by line_no) part from (select *, case when head is not null or lag(head) over (partition by doc_id, pnum, block_no order by line_no) is not null then 1 else 0 end flag from hl))
select doc_id, pnum, line_no, coalesce(head, block_type) block_type, cast(dense_rank() over (partition by doc_id, pnum order by block_no, part) - 1 as int) new_block_no from pt""")
def split_headings(spark, sf_dir):
    _, lines, blocks, boxes = _layout(spark, sf_dir)
    typed = P.annotate_blocks(blocks, boxes).select(*KEY, "block_no", "block_type")
    top = F.col("label").isin("Caption", "Text")
    heads = boxes.withColumn("y1", F.when(top, F.col("y0") + 13).otherwise(F.col("y1"))).withColumn("label", F.when(top, "Title").otherwise(F.col("label")))
    return P.split_headings(lines.join(typed, [*KEY, "block_no"]), heads).select(*KEY, "line_no", "block_type", "new_block_no")


@query(WITH + """, li as (select l.*, case when line_no % 6 in (2, 3) then ' ' else text end t, (select 1) one from lines l where src_par % 5 = 4),
fw as (select doc_id, pnum, block_no, line_no, arg_min((x1 - x0) / length(text), span_no) first_width from spans where length(text) > 0 group by all),
j as (select li.*, first_width from li left join fw using (doc_id, pnum, block_no, line_no)),
k as (select *, least(min(x0) over b, 1000.0::double) lft, first_value(first_width) over (partition by doc_id, pnum, block_no order by line_no) width, trim(t) = '' blank, lag(trim(t) = '') over (partition by doc_id, pnum, block_no order by line_no) bb from j window b as (partition by doc_id, pnum, block_no))
select doc_id, pnum, block_no, string_agg(repeat(' ', cast(trunc((x0 - lft) / width) as int)) || t || chr(10), '' order by line_no) as text from k where not (blank and coalesce(bb, false)) group by all""")
def code_indent(spark, sf_dir):
    s, lines, _, _ = _layout(spark, sf_dir)
    width = s.filter(F.length("text") > 0).groupBy(*KEY, "block_no", "line_no").agg(F.min_by((F.col("x1") - F.col("x0")) / F.length("text"), "span_no").alias("first_width"))
    l = lines.filter("src_par % 5 = 4").join(width, [*KEY, "block_no", "line_no"], "left")
    return P.code_indent(l.withColumn("text", F.when(F.col("line_no") % 6 >= 2, F.when(F.col("line_no") % 6 <= 3, " ").otherwise(F.col("text"))).otherwise(F.col("text"))))


@query(WITH + """, st as (select *, font_weight >= 600 or contains(lower(font), 'bold') bold, (doc_id + line_no) % 5 = 0 italic from spans),
n as (select *, row_number() over w - 1 i, count(*) over (partition by doc_id, pnum, block_no, line_no) n,
  coalesce(first_value(case when length(trim(text)) > 2 then bold end ignore nulls) over f, last_value(bold) over f, false) nb, coalesce(first_value(case when length(trim(text)) > 2 then italic end ignore nulls) over f, last_value(italic) over f, false) ni
  from st window w as (partition by doc_id, pnum, block_no, line_no order by span_no), f as (partition by doc_id, pnum, block_no, line_no order by span_no rows between 1 following and unbounded following))
select doc_id, pnum, span_id, case when length(text) > 3 and i > 0 and i < n - 1 then case when italic and not ni then '*' || text || '*' when bold and not nb then '**' || text || '**' else text end else text end as text from n""")
def span_emphasis(spark, sf_dir):
    s = S.spans(spark, sf_dir).withColumn("bold", (F.col("font_weight") >= 600) | F.lower("font").contains("bold")).withColumn("italic", (F.col("doc_id") + F.col("line_no")) % 5 == 0)
    return P.emphasis(s).select(*KEY, "span_id", "text")


@query(WITH + f", {_TYPED}\nselect s.doc_id, s.pnum, s.span_id from spans s join typed t using (doc_id, pnum, block_no) where not (s.pnum % 2 = 0 and s.line_no < 2) and t.block_type not in ('Figure', 'Caption')")
def filter_bad_spans(spark, sf_dir):
    s, _, blocks, boxes = _layout(spark, sf_dir)
    typed = s.join(P.annotate_blocks(blocks, boxes).select(*KEY, "block_no", "block_type"), [*KEY, "block_no"])
    bad = s.filter("pnum % 2 = 0 and line_no < 2").select(*KEY, "span_id")
    return P.filter_spans(typed, bad, ("Figure", "Caption")).select(*KEY, "span_id")


@query(WITH + """, ex as (select s.*, l.x0 lx0, l.x1 lx1, l.y0 ly0, l.y1 ly1 from spans s join lines l using (doc_id, pnum, block_no, line_no))
select doc_id, pnum, pnum || '_' || (n - 1) as span_id, replace(regexp_replace(replace(text, 'th', 'th-' || chr(10)) || chr(13) || chr(10), '[\\n\\r]+$', ''), '-' || chr(10), '') as text,
  concat_ws('_', font, concat_ws('_', case when f & 1 > 0 then 'fixed_pitch' end, case when f & 2 > 0 then 'serif' end, case when f & 4 > 0 then 'symbolic' end, case when f & 8 > 0 then 'script' end, case when f & 32 > 0 then 'non_symbolic' end, case when f & 64 > 0 then 'italic' end)) font,
  case when pnum % 4 in (1, 3) then 792.0::double else 612.0::double end page_width, case when pnum % 4 in (1, 3) then 612.0::double else 792.0::double end page_height
from (select *, row_number() over (partition by doc_id, pnum order by block_no, line_no, span_no) n, (doc_id + line_no * 7) % 128 f from ex) where not ((doc_id + line_no) % 13 = 0 and lx1 > lx0)""")
def span_normalize(spark, sf_dir):
    s, lines, _, _ = _layout(spark, sf_dir)
    j = s.join(lines.select(*KEY, "block_no", "line_no", *[F.col(c).alias("l" + c) for c in XY]), [*KEY, "block_no", "line_no"])
    turn = (F.col("doc_id") + F.col("line_no")) % 13 == 0
    j = j.withColumns({"lx0": F.when(turn, F.col("lx1")).otherwise(F.col("lx0")), "lx1": F.when(turn, F.col("lx0")).otherwise(F.col("lx1"))})
    j = j.withColumn("text", F.concat(F.replace("text", F.lit("th"), F.lit("th-\n")), F.lit("\r\n"))).withColumnRenamed("font", "font_name").withColumn("flags", (F.col("doc_id") + F.col("line_no") * 7) % 128)
    j = j.withColumn("rotation", F.col("pnum") % 4 * 90).withColumn("page_width", F.lit(612.0)).withColumn("page_height", F.lit(792.0))
    return P.normalize_extract(j).select(*KEY, "span_id", "text", "font", "page_width", "page_height")


@query(WITH + "select doc_id, count(distinct pnum) as pages, count(*) as n_spans from spans where pnum >= 1 and pnum < 3 group by doc_id")
def page_range(spark, sf_dir):
    return P.page_range(S.spans(spark, sf_dir), 1, 2).groupBy("doc_id").agg(F.count_distinct("pnum").alias("pages"), F.count(F.lit(1)).alias("n_spans"))


# Tables. Rows are five bands with some jitter, columns three; one band comes twice, and scores differ.
_CELLS = """tb as (select * from boxes where label = 'Table'),
rowc as (select doc_id, pnum, box_idx, cast(i as int) cell_idx, 'table row' as label, 0.3::double + (i % 7) / 10.0::double score, 0.0::double x0, (i % 5) * h + (doc_id % 3) * (i // 5) y0, w x1, (i % 5) * h + h + (doc_id % 3) y1
  from (select doc_id, pnum, box_idx, x1 - x0 w, (y1 - y0) / 5.0::double h, unnest(range(0, 7)) i from tb)),
colc as (select doc_id, pnum, box_idx, cast(10 + i as int) cell_idx, 'table column' as label, 0.6::double + i / 10.0::double score, i * w + 1 x0, 0.0::double y0, i * w + w - 1 x1, h y1 from (select doc_id, pnum, box_idx, (x1 - x0) / 3.0::double w, y1 - y0 h, unnest(range(0, 3)) i from tb)),
cells as (select * from rowc union all select * from colc)"""


def _cells(boxes):
    tb = boxes.filter("label = 'Table'")
    r = tb.select(*KEY, "box_idx", (F.col("x1") - F.col("x0")).alias("w"), ((F.col("y1") - F.col("y0")) / 5.0).alias("h"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("i"))
    jitter = (F.col("doc_id") % 3).cast("double")
    r = r.select(*KEY, "box_idx", F.col("i").alias("cell_idx"), F.lit("table row").alias("label"), (F.lit(0.3) + (F.col("i") % 7) / 10.0).alias("score"), F.lit(0.0).alias("x0"), (F.col("i") % 5 * F.col("h") + jitter * F.floor(F.col("i") / 5)).alias("y0"), F.col("w").alias("x1"), (F.col("i") % 5 * F.col("h") + F.col("h") + jitter).alias("y1"))
    c = tb.select(*KEY, "box_idx", ((F.col("x1") - F.col("x0")) / 3.0).alias("w"), (F.col("y1") - F.col("y0")).alias("h"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    c = c.select(*KEY, "box_idx", (F.col("i") + 10).alias("cell_idx"), F.lit("table column").alias("label"), (F.lit(0.6) + F.col("i") / 10.0).alias("score"), (F.col("i") * F.col("w") + 1).alias("x0"), F.lit(0.0).alias("y0"), (F.col("i") * F.col("w") + F.col("w") - 1).alias("x1"), F.col("h").alias("y1"))
    return r.unionByName(c)


_S = "struct_pack(x0 := x0, y0 := y0, x1 := x1, y1 := y1, score := score)"
_PCT_S = "(case when least(a.x1, b.x1) < greatest(a.x0, b.x0) or least(a.y1, b.y1) < greatest(a.y0, b.y0) or (a.x1 - a.x0) * (a.y1 - a.y0) = 0 then 0.0::double else (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / ((a.x1 - a.x0) * (a.y1 - a.y0)) end)"


def _sql_dedupe(label, lead):
    """The greedy scan as a recursion over the sorted cells: the last kept cell and its number go along."""
    n = "r" if label == "table row" else "c"
    return f"""{n}s as (select doc_id, pnum, box_idx, x0, y0, x1, y1, score, row_number() over (partition by doc_id, pnum, box_idx order by {lead}, cell_idx) k from cells where score > 0.5 and label = '{label}'),
{n}f as (select doc_id, pnum, box_idx, k, {_S} as a, cast(1 as bigint) slot from {n}s where k = 1
  union all select f.doc_id, f.pnum, f.box_idx, s.k, case when {_PCT_S.replace('a.', 'f.a.').replace('b.', 's.')} < 0.3 or s.score > f.a.score then struct_pack(x0 := s.x0, y0 := s.y0, x1 := s.x1, y1 := s.y1, score := s.score) else f.a end,
    f.slot + case when {_PCT_S.replace('a.', 'f.a.').replace('b.', 's.')} < 0.3 then 1 else 0 end from {n}f f join {n}s s on s.doc_id = f.doc_id and s.pnum = f.pnum and s.box_idx = f.box_idx and s.k = f.k + 1),
{n}k as (select doc_id, pnum, box_idx, slot, arg_max(a, k) a from {n}f group by all)"""


_WITH_R = WITH.replace("with ", "with recursive ", 1)


@query(_WITH_R + f", {_CELLS}, {_sql_dedupe('table row', 'y0')}\nselect doc_id, pnum, box_idx, cast(slot - 1 as int) as place, a.y0 as y0, a.y1 as y1, a.score as score from rk")
def cells_dedupe(spark, sf_dir):
    cells = _cells(S.layout_boxes(S.block_table(spark, sf_dir))).filter("score > 0.5 and label = 'table row'")
    a = F.sort_array(F.collect_list(F.struct(F.col("y0").alias("lead"), "cell_idx", F.struct(*XY, "score").alias("c"))))
    kept = cells.groupBy(*KEY, "box_idx").agg(TB.dedupe_cells(F.transform(a, lambda x: x["c"]), 1).alias("k"))
    return kept.select(*KEY, "box_idx", F.posexplode("k").alias("place", "c")).select(*KEY, "box_idx", "place", "c.y0", "c.y1", "c.score")


@query(WITH + f""", {_CELLS}
select doc_id, pnum, box_idx, cell_idx, case when lag(x1) over w is null then x0 else (lag(x1) over w + x0) / 2 end as x0, case when lead(x0) over w is null then x1 else (x1 + lead(x0) over w) / 2 end as x1 from cells where label = 'table column' window w as (partition by doc_id, pnum, box_idx order by x0)""")
def cells_reduce_margin(spark, sf_dir):
    cells = _cells(S.layout_boxes(S.block_table(spark, sf_dir))).filter("label = 'table column'")
    a = F.transform(F.sort_array(F.collect_list(F.struct("x0", F.struct(*XY, "score").alias("c"), "cell_idx"))), lambda x: x["c"])
    g = cells.groupBy(*KEY, "box_idx").agg(a.alias("a"))
    return g.select(*KEY, "box_idx", F.posexplode(TB.close_gaps(F.col("a"), 0)).alias("i", "c")).select(*KEY, "box_idx", (F.col("i") + 10).alias("cell_idx"), "c.x0", "c.x1")


def _sql_gaps(n, lo, hi):
    return f"{n}g as (select doc_id, pnum, box_idx, slot, case when lag(a.{hi}) over w is null then a.{lo} else (lag(a.{hi}) over w + a.{lo}) / 2 end lo, case when lead(a.{lo}) over w is null then a.{hi} else (a.{hi} + lead(a.{lo}) over w) / 2 end hi from {n}k window w as (partition by doc_id, pnum, box_idx order by slot))"


_DIV = f"""{_CELLS}, {_sql_dedupe('table row', 'y0')}, {_sql_dedupe('table column', 'x0')}, {_sql_gaps('r', 'y0', 'y1')}, {_sql_gaps('c', 'x0', 'x1')},
dv as (select r.doc_id, r.pnum, r.box_idx, rd row_dividers, cd col_dividers from
  (select g.doc_id, g.pnum, g.box_idx, list(lo + b.y0 order by slot) || [max(hi) + any_value(b.y0)] rd from rg g join boxes b using (doc_id, pnum, box_idx) group by all) r
  join (select g.doc_id, g.pnum, g.box_idx, list(lo + b.x0 order by slot) || [max(hi) + any_value(b.x0)] cd from cg g join boxes b using (doc_id, pnum, box_idx) group by all) c using (doc_id, pnum, box_idx))"""


@query(_WITH_R + f", {_DIV}\nselect doc_id, pnum, box_idx, array_to_string(list_transform(row_dividers, lambda x: cast(round(x, 4) as decimal(18,4))), ' ') as row_dividers, array_to_string(list_transform(col_dividers, lambda x: cast(round(x, 4) as decimal(18,4))), ' ') as col_dividers from dv")
def table_dividers(spark, sf_dir):
    boxes = S.layout_boxes(S.block_table(spark, sf_dir))
    d = TB.dividers(_cells(boxes), boxes)
    text = lambda c: F.array_join(F.transform(c, lambda x: F.round(x, 4).cast("decimal(18,4)").cast("string")), " ")
    return d.select(*KEY, "box_idx", text("row_dividers").alias("row_dividers"), text("col_dividers").alias("col_dividers"))


def _pieces(spans):
    """Spans in image units, with the columns that order them."""
    t = P.to_page(spans, S.PAGE_BOX, S.IMAGE_BOX)
    return t.select(*KEY, "text", *XY, F.col("block_no").alias("o_0"), F.col("line_no").alias("o_1"), F.col("span_no").alias("o_2"))


_TEXTS = f"""{_DIV}, pc as (select doc_id, pnum, block_no, line_no, span_no, text, x0 / (612.0::double / 816.0::double) x0, y0 / (792.0::double / 1056.0::double) y0, x1 / (612.0::double / 816.0::double) x1, y1 / (792.0::double / 1056.0::double) y1 from spans),
pl as (select p.*, d.box_idx, list_filter(range(0, len(row_dividers) - 1), lambda i: row_dividers[i + 1] <= (y0 + y1) / 2 and (y0 + y1) / 2 <= row_dividers[i + 2])[1] r, list_filter(range(0, len(col_dividers) - 1), lambda i: col_dividers[i + 1] <= (x0 + x1) / 2 and (x0 + x1) / 2 <= col_dividers[i + 2])[1] c from pc p join dv d using (doc_id, pnum)),
ct as (select doc_id, pnum, box_idx, r, c, string_agg(text, '' order by block_no, line_no, span_no) t from pl where r is not null and c is not null group by all),
gr as (select doc_id, pnum, box_idx, r, unnest(range(0, nc)) c from (select doc_id, pnum, box_idx, unnest(range(0, len(row_dividers) - 1)) r, len(col_dividers) - 1 nc from dv)),
tt as (select doc_id, pnum, box_idx, string_agg(rowt, chr(10) order by r) csv from (select gr.doc_id, gr.pnum, gr.box_idx, gr.r, string_agg(coalesce(t, ''), ',' order by gr.c) rowt from gr left join ct using (doc_id, pnum, box_idx, r, c) group by all) group by all)"""


def _tables(spark, sf_dir):
    s, _, blocks = S.layout(spark, sf_dir)
    boxes = S.layout_boxes(blocks)
    return TB.cell_texts(_pieces(s), TB.dividers(_cells(boxes), boxes)), blocks, boxes


@query(_WITH_R + f", {_TEXTS}\nselect doc_id, pnum, box_idx, csv from tt")
def table_cells_text(spark, sf_dir):
    return _tables(spark, sf_dir)[0].select(*KEY, "box_idx", T.csv_dump(F.col("rows")).alias("csv"))


@query(_WITH_R + f""", {_TEXTS}, {_TYPED},
th as (select a.doc_id, a.pnum, a.block_no, b.box_idx from typed a join pboxes b using (doc_id, pnum) where a.block_type = 'Table' and b.label = 'Table' and {S.sql_pct('a', 'b')} > 0.7),
tf as (select doc_id, pnum, box_idx, min(block_no) block_no from th group by all),
ev as (select doc_id, pnum, block_no, null::int box_idx, null::varchar table_data from typed t where not exists (select 1 from th where th.doc_id = t.doc_id and th.pnum = t.pnum and th.block_no = t.block_no)
  union all select tf.doc_id, tf.pnum, tf.block_no, tf.box_idx, csv from tf join tt using (doc_id, pnum, box_idx))
select doc_id, pnum, cast(row_number() over (partition by doc_id, pnum order by block_no, box_idx nulls last) - 1 as int) place, block_no, box_idx, table_data from ev""")
def format_tables(spark, sf_dir):
    texts, blocks, boxes = _tables(spark, sf_dir)
    moved = P.to_page(boxes, S.IMAGE_BOX, S.PAGE_BOX)
    return TB.table_blocks(P.annotate_blocks(blocks, moved), moved, texts).select(*KEY, "place", "block_no", "box_idx", "table_data")


@query(WITH + "select doc_id, pnum, box_idx from (select *, row_number() over (partition by doc_id, pnum order by box_idx) r from boxes) where r <= 5")
def order_boxes_limit(spark, sf_dir):
    """The first so many boxes of a page go to the model; five here, 255 by default."""
    from .. import models

    return models.limit_boxes(S.layout_boxes(S.block_table(spark, sf_dir)), 5).select(*KEY, "box_idx")


@query(_WITH_R + f""", {_DIV}
select b.doc_id, b.pnum, b.box_idx, case when b.label = 'Table' and row_dividers is null then 'Text' else b.label end as label,
  case when row_dividers is null then b.x0 else greatest(least(b.x0, col_dividers[-1]), col_dividers[1]) end as x0, case when row_dividers is null then b.y1 else greatest(least(b.y1, row_dividers[-1]), row_dividers[1]) end as y1
from boxes b left join dv on dv.doc_id = b.doc_id and dv.pnum = b.pnum and dv.box_idx = b.box_idx and b.pnum % 3 <> 1""")
def table_bounds(spark, sf_dir):
    """Table boxes drawn to their dividers; those without are text."""
    boxes = S.layout_boxes(S.block_table(spark, sf_dir))
    found = TB.dividers(_cells(boxes), boxes).filter("pnum % 3 <> 1")
    return TB.fit_to_bounds(boxes, found).select(*KEY, "box_idx", "label", "x0", "y1")


@query(WITH + f""", {_EQ}, n as (select *, row_number() over (partition by doc_id order by pnum, box_idx) - 1 i from eq where tokens < 384), m as (select *, least(max(tokens) over (partition by doc_id, i // 6), 384) + 256 as max_length from n)
select doc_id, pnum, box_idx, max_length, case when box_idx % 2 = 0 then '' else source end as latex from m""")
def equation_batches(spark, sf_dir):
    """Length limits of model batches, and outputs that ran on to the limit emptied."""
    _, lines, blocks, boxes = _layout(spark, sf_dir)
    eq = P.equation_regions(boxes, lines, blocks).filter("replaced")
    limits = P.batch_limits(eq, ["doc_id"], ["pnum", "box_idx"])
    guess = F.when(F.col("box_idx") % 2 == 0, F.rpad("source", 640, "x")).otherwise(F.col("source"))
    return limits.select(*KEY, "box_idx", "max_length", P.unless_run_on(guess, F.col("max_length")).alias("latex"))


def _sql_columns(depth: int) -> str:
    """Runs of 100 words as blocks of one to three columns, below a heading on every other page, cut at empty bands."""
    steps = ["""
with w as (select doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') w from documents),
i as (select doc_id, unnest(range(0, (len(w) + 99) // 100)) i from w),
p as (select doc_id, i, i // 12 pnum, i % 12 k, 1 + doc_id % 3 c, (doc_id + i // 12) % 2 h from i),
b as (select doc_id, pnum, i, case when h = 1 and k = 0 then 50.0 else 50.0 + (k - h) // (12 // c) * (520.0 / c) end x0, case when h = 1 and k = 0 then 40.0 else 80.0 + (k - h) % (12 // c) * 50.0 end y0,
  case when h = 1 and k = 0 then 570.0 else 50.0 + (k - h) // (12 // c) * (520.0 / c) + 520.0 / c - 20 end x1, case when h = 1 and k = 0 then 60.0 else 80.0 + (k - h) % (12 // c) * 50.0 + 45 end y1 from p),
r0 as (select *, cast([] as int[]) region from b)"""]
    for n in range(depth):
        for axis, source in (("x", f"r{n}"), ("y", f"x{n}")):
            along = f"partition by doc_id, pnum, region order by {axis}0, {axis}1, i"
            steps.append(f"{axis}g{n} as (select *, coalesce({axis}0 - max({axis}1) over ({along} rows between unbounded preceding and 1 preceding), 0) g{axis} from {source})")
            rest = ", gy" if axis == "y" else ""
            steps.append(f"{axis}{n} as (select * replace (max(g{axis}) over (partition by doc_id, pnum, region) as g{axis}), sum(case when g{axis} >= 8 then 1 else 0 end) over ({along}) n{axis} from {axis}g{n})" if not rest else f"y{n} as (select * replace (max(gy) over (partition by doc_id, pnum, region) as gy), sum(case when gy >= 8 then 1 else 0 end) over ({along}) ny from yg{n})")
        steps.append(f"r{n + 1} as (select doc_id, pnum, i, x0, y0, x1, y1, list_append(region, cast(case when gx >= 8 and (gx > gy or gy < 8) then nx else ny end as int)) region from y{n})")
    return ",\n".join(steps) + f"""
select doc_id, pnum, i block_no, cast(row_number() over (partition by doc_id, pnum order by region, round(y0 / 1.25), x0, i) - 1 as int) place from r{depth}"""


@query(_sql_columns(3))
def column_order(spark, sf_dir):
    """Blocks of pages with columns, in reading order without a model."""
    from ..functions import text as T
    from ..operators import columns
    from ..session import table

    w = F.size(T.words(F.col("text")))
    i = table(spark, sf_dir, "documents").select("doc_id", w.alias("n")).filter("n > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.expr("(n + 99) div 100 - 1").cast("int"))).alias("i"))
    p = i.selectExpr("doc_id", "i", "i div 12 as pnum", "i % 12 as k", "1 + doc_id % 3 as c", "(doc_id + i div 12) % 2 as h")
    head = "h = 1 and k = 0"
    x0, y0 = "50 + (k - h) div (12 div c) * (520D / c)", "80 + (k - h) % (12 div c) * 50D"
    b = p.selectExpr("doc_id", "pnum", "i as block_no", f"case when {head} then 50D else {x0} end as x0", f"case when {head} then 40D else {y0} end as y0", f"case when {head} then 570D else {x0} + 520D / c - 20 end as x1", f"case when {head} then 60D else {y0} + 45 end as y1")
    return columns.reading_order(b, depth=3).select("doc_id", F.col("pnum").cast("long").alias("pnum"), F.col("block_no").cast("long").alias("block_no"), "place")
