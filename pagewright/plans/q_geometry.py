"""Queries of the geometry functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import geometry as G
from ..session import table
from . import synthetic as S
from .registry import query

WITH = "with " + S.LAYOUT + "\n"
KEY = ["doc_id", "pnum"]
XY = ("x0", "y0", "x1", "y1")


def _blocks(spark, sf_dir):
    return S.block_table(spark, sf_dir)


def _vectors(spark, sf_dir):
    """Boxes and polygons from the first parts of the vectors."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", *[(F.element_at("embedding", i + 1).cast("double") * 100).alias(f"v{i}") for i in range(8)])


_SQL_V = "v as (select vec_id, " + ", ".join(f"cast(embedding[{i + 1}] as double) * 100 as v{i}" for i in range(8)) + " from embeddings)"


@query(WITH + "select doc_id, pnum, block_no, x1 - x0 as w, y1 - y0 as h, (x1 - x0) * (y1 - y0) as area from blocks")
def bbox_props(spark, sf_dir):
    b = G.box()
    return _blocks(spark, sf_dir).select(*KEY, "block_no", G.width(b).alias("w"), G.height(b).alias("h"), G.area(b).alias("area"))


@query(WITH + "select doc_id, pnum, box_idx, x0, y0, x1, y1 from pboxes")
def bbox_rescale(spark, sf_dir):
    boxes = S.layout_boxes(_blocks(spark, sf_dir))
    r = G.rescale(G.box(), G.literal(*S.IMAGE_BOX), G.literal(*S.PAGE_BOX))
    return boxes.select(*KEY, "box_idx", *[c.alias(n) for c, n in zip(r, XY)])


@query(f"with {_SQL_V} select vec_id, " + ", ".join(f"cast(trunc(v{i} * ({[1000, 700][i % 2]}.0::double / {[612, 792][i % 2]}.0::double)) as int) as {n}" for i, n in enumerate(XY)) + " from v")
def bbox_rescale_int(spark, sf_dir):
    r = G.rescale_int(tuple(F.col(f"v{i}") for i in range(4)), (F.lit(612.0), F.lit(792.0)), (F.lit(1000.0), F.lit(700.0)))
    return _vectors(spark, sf_dir).select("vec_id", *[c.alias(n) for c, n in zip(r, XY)])


@query(WITH + f"select a.doc_id, a.pnum, a.block_no, b.block_no as other, {S.sql_pct('a', 'b')} as pct from blocks a join blocks b on a.doc_id = b.doc_id and a.pnum = b.pnum and b.block_no = a.block_no + 1")
def bbox_intersection_pct(spark, sf_dir):
    a = _blocks(spark, sf_dir)
    b = a.select(*KEY, F.col("block_no").alias("other"), *[F.col(c).alias("b" + c) for c in XY])
    return a.join(b, KEY).filter("other = block_no + 1").select(*KEY, "block_no", "other", G.intersection_pct(G.box(), G.box("b")).alias("pct"))


@query(WITH + "select l.doc_id, l.pnum, l.line_no, count(*) > 1 as shared from lines l join lines m on l.doc_id = m.doc_id and l.pnum = m.pnum and l.x0 - 10 < m.x1 and l.x1 > m.x0 and l.y0 - 10 < m.y1 and l.y1 > m.y0 group by all")
def bbox_any_intersect(spark, sf_dir):
    l = S.line_table(spark, sf_dir)
    m = l.select(*KEY, *[F.col(c).alias("b" + c) for c in XY])
    wide = (F.col("x0") - 10, F.col("y0") - 10, F.col("x1"), F.col("y1"))
    return l.join(m, KEY).filter(G.intersects(wide, G.box("b"))).groupBy(*KEY, "line_no").agg((F.count(F.lit(1)) > 1).alias("shared"))


@query(WITH + "select doc_id, pnum, min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1 from spans group by all")
def bbox_closure(spark, sf_dir):
    return S.spans(spark, sf_dir).groupBy(*KEY).agg(*G.closure())


@query(WITH + "select doc_id, pnum, line_no, span_no, coalesce(abs(y0 - py0) < 5 and abs(y1 - py1) < 5 and x0 - px1 < 5 and x0 > px0, false) as joined from (select *, lag(x0) over w px0, lag(y0) over w py0, lag(x1) over w px1, lag(y1) over w py1 from spans window w as (partition by doc_id, pnum order by line_no, span_no))")
def bbox_adjacent(spark, sf_dir):
    w = W.partitionBy(*KEY).orderBy("line_no", "span_no")
    s = S.spans(spark, sf_dir).withColumns({f"p{c}": F.lag(c).over(w) for c in XY})
    return s.select(*KEY, "line_no", "span_no", F.coalesce(G.adjacent(G.box("p"), G.box()), F.lit(False)).alias("joined"))


@query(f"with {_SQL_V} select vec_id, least(v0, v2) x0, least(v1, v5) y0, greatest(v0, v2) x1, greatest(v1, v5) y1 from v")
def polygon_bbox(spark, sf_dir):
    p = F.array(*[F.array(F.col(f"v{i}"), F.col(f"v{i + 1}")) for i in (0, 2, 4, 6)])
    return _vectors(spark, sf_dir).select("vec_id", G.checked(p).alias("p")).select("vec_id", *[c.alias(n) for c, n in zip(G.polygon_box(F.col("p")), XY)])


@query(f"with {_SQL_V} select vec_id, " + ", ".join(f"greatest(least(v{i}, {[8, 12][i % 2]}.0::double), {[-8, -12][i % 2]}.0::double) as c{i}" for i in range(8)) + " from v")
def polygon_clamp(spark, sf_dir):
    p = F.array(*[F.array(F.col(f"v{i}"), F.col(f"v{i + 1}")) for i in (0, 2, 4, 6)])
    v = _vectors(spark, sf_dir).select("vec_id", G.clamp_polygon(p, G.literal(-8, -12, 8, 12)).alias("p"))
    return v.select("vec_id", *[F.col("p")[i // 2][i % 2].alias(f"c{i}") for i in range(8)])


@query(f"with {_SQL_V} select vec_id, " + ", ".join(f"floor(v{i} / 5.0::double) * 5.0::double as {n}" for i, n in enumerate(XY)) + " from v")
def bbox_round(spark, sf_dir):
    b = G.floored(tuple(F.col(f"v{i}") for i in range(4)), 5.0)
    return _vectors(spark, sf_dir).select("vec_id", *[c.alias(n) for c, n in zip(b, XY)])


@query(f"with {_SQL_V} select vec_id, v0 - 0.5::double * abs(v2) as x0, v1 - 0.5::double * abs(v3) as y0, v0 + 0.5::double * abs(v2) as x1, v1 + 0.5::double * abs(v3) as y1, case when v4 >= v5 and v4 >= v6 then 0 when v5 >= v6 then 1 else 2 end as label from v where greatest(v4, v5, v6) > v7")
def decode_boxes(spark, sf_dir):
    """Centres and sizes to corners; the class that scores highest, the first of equals; rows whose last class, none, does go."""
    b = G.from_center(F.col("v0"), F.col("v1"), F.abs("v2"), F.abs("v3"))
    scores = F.array("v4", "v5", "v6")
    v = _vectors(spark, sf_dir).filter(F.greatest("v4", "v5", "v6") > F.col("v7"))
    return v.select("vec_id", *[c.alias(n) for c, n in zip(b, XY)], (F.array_position(scores, F.array_max(scores)) - 1).cast("int").alias("label"))


@query(f"""with {_SQL_V}, a as (select vec_id, v0 x0, v1 y0, v0 + abs(v2) + 1 x1, v1 + abs(v3) + 1 y1, v4 p0, v5 q0, v4 + abs(v6) + 1 p1, v5 + abs(v7) + 1 q1 from v),
m as (select *, floor(least(x1 - x0, p1 - p0) * 0.25::double) m from a)
select vec_id, greatest(0.0::double, least(x1, p1 - m) - greatest(x0, p0 + m)) * greatest(0.0::double, least(y1, q1 - m) - greatest(y0, q0 + m)) / ((x1 - x0) * (y1 - y0)) as pct from m""")
def bbox_margin_pct(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    a = (F.col("v0"), F.col("v1"), F.col("v0") + F.abs("v2") + 1, F.col("v1") + F.abs("v3") + 1)
    b = (F.col("v4"), F.col("v5"), F.col("v4") + F.abs("v6") + 1, F.col("v5") + F.abs("v7") + 1)
    return v.select("vec_id", G.margin_pct(a, b, 0.25).alias("pct"))


@query(f"with {_SQL_V} select vec_id, " + ", ".join(f"{[612, 792][i % 2]}.0::double * (v{i} / 1000) as {n}" for i, n in enumerate(XY)) + " from v")
def bbox_unnormalize(spark, sf_dir):
    b = G.unnormalize(tuple(F.col(f"v{i}") for i in range(4)), F.lit(612.0), F.lit(792.0))
    return _vectors(spark, sf_dir).select("vec_id", *[c.alias(n) for c, n in zip(b, XY)])


@query(f"with {_SQL_V} select vec_id, v0 x0, v1 y0, v2 x1, v1 x2y, v3 y2 from v")
def bbox_corners(spark, sf_dir):
    v = _vectors(spark, sf_dir).withColumn("p", G.corners(tuple(F.col(f"v{i}") for i in range(4))))
    return v.select("vec_id", F.col("p")[0][0].alias("x0"), F.col("p")[0][1].alias("y0"), F.col("p")[1][0].alias("x1"), F.col("p")[1][1].alias("x2y"), F.col("p")[2][1].alias("y2"))
