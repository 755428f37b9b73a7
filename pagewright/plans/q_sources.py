"""Queries of sources, sinks, pipelines and streaming."""

from __future__ import annotations

import io
import zipfile
import zlib
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import sinks, store
from ..operators import document as D
from ..operators import page as P
from ..session import scratch, table
from ..sinks import document_json
from ..sources import binary, office, pdf
from ..sources import csv as csv_source
from ..sources import csv_ranges
from . import pipelines, stage
from . import synthetic as S
from .q_document import _CHUNKS, _CONV, _conversation_blocks
from .q_geometry import WITH
from .q_text import _sql_runs
from .registry import query

_SQL_FORMATS = "(values " + ", ".join(f"('{e}', '{p}', {i})" for i, (e, p) in enumerate(pipelines.FORMATS)) + ") f(ext, pipeline, ord)"
_NAMES = [".csv", ".PDF", ".pdf", ".docx", "", ".tar.gz", ".mp4"]


@query(f"select * from {_SQL_FORMATS}")
def src_formats(spark, sf_dir):
    return pipelines.formats(spark)


@query(f"select page_id, e as ext, f.pipeline from (select page_id, regexp_extract(p, '[^/]+(\\.[^./]*)$', 1) e from (select page_id, '/in/file' || page_id || [{', '.join(repr(n) for n in _NAMES)}][page_id % {len(_NAMES)} + 1] p from pages)) left join {_SQL_FORMATS} on f.ext = e")
def src_ext_dispatch(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("page_id") % len(_NAMES) + 1).cast("int"))
    files = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/in/file"), "page_id", name).alias("path"))
    return pipelines.dispatch(files).select("page_id", "ext", "pipeline")


_KINDS = [".pdf", ".PNG", ".docx", ".tif", ".md"]


@query(f"select page_id, case when e = '.pdf' then 'none' when e in ({', '.join(repr(x) for x in pipelines.IMAGES)}) then 'image' else 'office' end as route from (select page_id, lower([{', '.join(repr(n) for n in _KINDS)}][page_id % {len(_KINDS)} + 1]) e from pages)")
def src_conversion(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(n) for n in _KINDS]), (F.col("page_id") % len(_KINDS) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", pipelines.conversion(F.concat(F.lit("/in/f"), name)).alias("route"))


@query("select page_id, case when page_id % 2 = 0 then 'pdf' else 'other' end as kind from pages")
def sniff_pdf(spark, sf_dir):
    head = F.when(F.col("page_id") % 2 == 0, "%PDF-1.7").otherwise("%!PS")
    return table(spark, sf_dir, "pages").select("page_id", F.concat(head, "html").cast("binary").alias("content")).select("page_id", binary.sniff_pdf().alias("kind"))


@query("select item_id, 0 as \"index\", 'text' as chunk_type, text || chr(10) as content from benchmark")
def src_text(spark, sf_dir):
    """Items written as text files, one each, and read back as files."""
    out = scratch(spark, "texts")
    table(spark, sf_dir, "benchmark").select("item_id", "text").repartition("item_id").write.partitionBy("item_id").text(out)
    item = F.regexp_extract("source", r"item_id=(\d+)/", 1).cast("long").alias("item_id")
    return binary.read_text(spark, f"{out}/*/*.txt").select(item, "index", "chunk_type", "content")


@query("""select cast(row_number() over (partition by n_regionkey order by n_nationkey) - 1 as int) as "index", 'text' as chunk_type, n_name as source,
'n_nationkey: ' || n_nationkey || ';n_name: ' || n_name || ';n_regionkey: ' || n_regionkey as content from nation
union all select 0, 'error', 'bad', 'no encoding fits'""")
def src_csv(spark, sf_dir):
    """Nations of each region as a CSV file, and one file that its encoding doesn't fit."""
    line = F.concat_ws(",", "n_nationkey", "n_name", "n_regionkey")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", line.alias("line")))), lambda x: x["line"])
    text = F.concat(F.lit("n_nationkey,n_name,n_regionkey\n"), F.array_join(lines, "\n"), F.lit("\n"))
    files = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(text.alias("text")).select(F.concat(F.lit("/in/"), "n_regionkey", F.lit(".csv")).alias("path"), F.col("text").cast("binary").alias("content"))
    bad = spark.createDataFrame([("bad", b"a,b\n1,\xff\n")], files.schema)
    return csv_source.exact_chunks(files.unionByName(bad), "utf-8", "n_name").select("index", "chunk_type", "source", "content").replace({"": None}, subset=["source"])


_SHEET = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_RELATIONS = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


@query("""select 'Suppliers' as sheet, cast(row_number() over (partition by s_nationkey order by s_suppkey) - 1 as int) as "index", 'text' as chunk_type,
'"key":"' || s_suppkey || '";"name":"' || s_name || '"' as content from supplier union all select null, 0, 'error', 'BadZipFile: File is not a zip file'""")
def src_xlsx(spark, sf_dir):
    """Suppliers of each nation as a workbook, with an empty row below the last, and a file that isn't one."""

    def book(pdf: pd.DataFrame) -> pd.DataFrame:
        text = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
        rows = [f'<row r="1">{text("A1", "key")}{text("B1", "name")}</row>']
        pdf = pdf.sort_values("s_suppkey")
        rows += [f'<row r="{i}"><c r="A{i}"><v>{k}</v></c>{text(f"B{i}", v)}</row>' for i, (k, v) in enumerate(zip(pdf["s_suppkey"], pdf["s_name"]), 2)]
        parts = {
            "xl/workbook.xml": f'<workbook {_SHEET}><sheets><sheet name="Suppliers" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships {_RELATIONS}><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/worksheets/sheet1.xml": f"<worksheet {_SHEET}><sheetData>{''.join(rows)}<row r='{len(rows) + 1}'/></sheetData></worksheet>",
        }
        return pd.DataFrame({"path": [f"/in/{pdf['s_nationkey'].iloc[0]}.xlsx"], "content": [_zipped(parts)]})

    files = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_name").groupBy("s_nationkey").applyInPandas(book, "path string, content binary")
    bad = spark.createDataFrame([("bad", b"not a workbook")], files.schema)
    return office.excel_chunks(files.unionByName(bad)).select("sheet", "index", "chunk_type", "content")


_BODY = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


@query("""with t as (select conv_id, turn, trim(text) t from conversations where role = 'user' and trim(text) <> ''),
p as (select conv_id, cast(row_number() over (partition by conv_id order by turn) - 1 as int) "index", 'text' chunk_type, t as content, cast(null as varchar) table_content from t),
n as (select conv_id, cast(count(*) as int) n from t group by conv_id),
g as (select conv_id, count(*) turns from conversations group by conv_id)
select * from p union all
select conv_id, coalesce(n, 0), 'table_csv', '| id | turns |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || conv_id || ' | ' || turns || ' |', 'id,turns' || chr(10) || conv_id || ',' || turns from g left join n using (conv_id)
union all select null, 0, 'error', 'BadZipFile: File is not a zip file', null""")
def src_docx(spark, sf_dir):
    """Conversations as Word files: a paragraph for each user turn, a table at the end; and a file that isn't one."""

    def document(pdf: pd.DataFrame) -> pd.DataFrame:
        run = lambda v: f'<w:r><w:t xml:space="preserve">{escape(str(v))}</w:t></w:r>'
        row = lambda *vs: "<w:tr>" + "".join(f"<w:tc><w:p>{run(v)}</w:p></w:tc>" for v in vs) + "</w:tr>"
        one = pdf["conv_id"].iloc[0]
        said = pdf[pdf["role"] == "user"].sort_values("turn")["text"]
        body = "".join(f"<w:p>{run(t)}</w:p>" for t in said) + f"<w:tbl>{row('id', 'turns')}{row(one, len(pdf))}</w:tbl>"
        return pd.DataFrame({"path": [f"/in/{one}.docx"], "content": [_zipped({"word/document.xml": f"<w:document {_BODY}><w:body>{body}</w:body></w:document>"})]})

    files = table(spark, sf_dir, "conversations").groupBy("conv_id").applyInPandas(document, "path string, content binary")
    bad = spark.createDataFrame([("bad", b"not a document")], files.schema)
    conv = F.regexp_extract("source", r"(\d+)\.docx", 1).try_cast("long").alias("conv_id")
    return office.word_chunks(files.unionByName(bad)).select(conv, "index", "chunk_type", "content", "table_content")


def pdf_file(pages: list[list[str]], titles: list[str] = ()) -> bytes:
    """A PDF of lines of text, by a font of two bytes a code whose codes are UTF-16, compressed, with an outline entry
    for each title. An empty line leaves space; lines aren't wrapped."""
    out, at = [b"%PDF-1.5\n"], {}

    def put(n: int, body: bytes) -> None:
        at[n] = sum(map(len, out))
        out.append(b"%d 0 obj\n%s\nendobj\n" % (n, body))

    def stream(n: int, data: bytes) -> None:
        data = zlib.compress(data)
        put(n, b"<</Length %d/Filter/FlateDecode>>stream\n%s\nendstream" % (len(data), data))

    first, k = 10, len(pages)
    kids = b" ".join(b"%d 0 R" % (first + 2 * i) for i in range(k))
    put(1, b"<</Type/Catalog/Pages 2 0 R/Outlines 7 0 R>>")
    put(2, b"<</Type/Pages/Count %d/MediaBox[0 0 612 792]/Resources<</Font<</F1 3 0 R>>>>/Kids[%s]>>" % (k, kids))
    put(3, b"<</Type/Font/Subtype/Type0/BaseFont/Sans/Encoding/Identity-H/DescendantFonts[4 0 R]/ToUnicode 5 0 R>>")
    put(4, b"<</Type/Font/Subtype/CIDFontType2/BaseFont/Sans/DW 500/FontDescriptor 6 0 R>>")
    stream(5, b"begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange endcmap")
    put(6, b"<</Type/FontDescriptor/FontName/Sans/Flags 32/Ascent 750/Descent -250/StemV 80>>")
    for i, lines in enumerate(pages):
        shown = b"".join(b"<%s> Tj T*\n" % t.encode("utf-16-be").hex().encode() for t in lines)
        put(first + 2 * i, b"<</Type/Page/Parent 2 0 R/Contents %d 0 R>>" % (first + 2 * i + 1))
        stream(first + 2 * i + 1, b"BT /F1 10 Tf 12 TL 36 750 Td\n" + shown + b"ET")
    entry = first + 2 * k
    ends = b"/First %d 0 R/Last %d 0 R" % (entry, entry + len(titles) - 1) if titles else b""
    put(7, b"<</Type/Outlines/Count %d%s>>" % (len(titles), ends))
    for i, t in enumerate(titles):
        after = b"/Next %d 0 R" % (entry + i + 1) if i + 1 < len(titles) else b""
        put(entry + i, b"<</Title<FEFF%s>/Parent 7 0 R/Dest[%d 0 R/XYZ 36 750 0]%s>>" % (t.encode("utf-16-be").hex().encode(), first + 2 * i, after))
    table = sum(map(len, out))
    last = max(at) + 1
    rows = b"".join(b"%010d 00000 n\r\n" % at[n] if n in at else b"0000000000 65535 f\r\n" for n in range(last))
    out.append(b"xref\n0 %d\n%strailer\n<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (last, rows, last, table))
    return b"".join(out)


def _pdf_files(spark, sf_dir):
    """Conversations as PDF files: a page and an outline entry for each turn; and a file that isn't one."""

    def made(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn")
        content = pdf_file([t.split("\n") for t in pdf["text"]], [f"{r} {n}" for r, n in zip(pdf["role"], pdf["turn"])])
        return pd.DataFrame({"path": [f"/in/{pdf['conv_id'].iloc[0]}.pdf"], "content": [content]})

    files = table(spark, sf_dir, "conversations").groupBy("conv_id").applyInPandas(made, "path string, content binary")
    return files.unionByName(spark.createDataFrame([("bad", b"not a document")], files.schema))


_PDF_ROWS = "pg as (select conv_id, text, role, turn, cast(row_number() over (partition by conv_id order by turn) - 1 as int) pnum from conversations)"


@query(f"""with {_PDF_ROWS}, ls as (select conv_id, pnum, string_split(text, chr(10)) t from pg), nr as (select conv_id, pnum, t, unnest(range(1, len(t) + 1)) i from ls)
select conv_id, pnum, cast(row_number() over (partition by conv_id, pnum order by i) - 1 as int) as line, t[i] as text, 36.0::double as x0, 36 + 5.0::double * length(t[i]) as x1, 34.5::double + 12 * (i - 1) as y0,
'Sans_non_symbolic' as font, 10.0::double as font_size, 400.0::double as font_weight, cast(null as varchar) as error from nr where t[i] <> ''
union all select null, null, null, null, null, null, null, null, null, null, 'PdfError: not a PDF'""")
def src_pdf(spark, sf_dir):
    """The lines of PDF files."""
    out = scratch(spark, "pdf")
    pdf.pages(_pdf_files(spark, sf_dir)).write.parquet(out)
    pages = spark.read.parquet(out)
    conv = pages.select("doc_id", F.regexp_extract("path", r"(\d+)\.pdf", 1).try_cast("long").alias("conv_id"), "error").distinct()
    line = F.row_number().over(Window.partitionBy("doc_id", "pnum").orderBy("block_no", "line_no", "span_no")) - 1
    spans = pdf.page_spans(pages).withColumn("line", line)
    return conv.join(spans, "doc_id", "left").select("conv_id", "pnum", "line", "text", "x0", "x1", F.round("y0", 6).alias("y0"), "font", "font_size", "font_weight", "error")


@query(f"with {_PDF_ROWS} select conv_id, pnum as page_index, role || ' ' || turn as title, 0 as level, 'XYZ' as view_mode from pg")
def src_pdf_outline(spark, sf_dir):
    """The outlines of PDF files; what can't be read has none."""
    files = _pdf_files(spark, sf_dir)
    ids = files.select(binary.doc_key(), F.regexp_extract("path", r"(\d+)\.pdf", 1).try_cast("long").alias("conv_id"))
    toc = pdf.outline(files).select("doc_id", F.inline("toc"))
    return toc.join(ids, "doc_id").select("conv_id", "page_index", "title", "level", "view_mode")


@query("with " + _sql_runs(100, 100).removeprefix("with ").replace("select doc_id, cast(k // 100 as bigint) pos,", ", c as (select doc_id, cast(k // 100 as int) pos,") .replace("\n, c as", ", c as") + " )\nselect doc_id, cast(count(*) as int) as num_chunks from c group by doc_id")
def pipeline_compose(spark, sf_dir):
    """Stages put together with |: chunks of the documents, then documents of the chunks."""
    from ..functions import chunking

    split = stage.Stage("split", lambda docs: chunking.chunk(docs, "fixed").withColumnRenamed("pos", "index"), ("docs",), ("chunks",))
    name = stage.Stage("name", lambda chunks: chunks.withColumn("chunk_id", D.chunk_id(F.col("doc_id"), F.col("index"))), ("chunks",), ("chunks",))
    join = stage.Stage("join", lambda chunks: D.build_documents(chunks), ("chunks",), ("documents",))
    out = (split | name | join).run({"docs": table(spark, sf_dir, "documents")})
    return out["documents"].select("doc_id", "num_chunks")


@query()
def layout_pipeline(spark, sf_dir):
    """All stages from spans to documents."""
    spans, _, blocks = S.layout(spark, sf_dir)
    boxes = P.to_page(S.layout_boxes(blocks), S.IMAGE_BOX, S.PAGE_BOX)
    return pipelines.layout_pipeline().run({"spans": spans, "boxes": boxes}, store=scratch(spark, "layout"), keep=("documents",))["documents"].select("doc_id", "num_chunks", "summary")


@query(f"with {_CONV}, {_CHUNKS} select doc_id, 200 as code, 'success' as msg, cast(count(*) as int) as num_chunks, string_agg(\"index\" || ' ' || chunk_id || ' ' || chunk_type || ' ' || content, chr(10) order by \"index\") as chunks from ch group by doc_id")
def doc_to_json(spark, sf_dir):
    """Documents as JSON, read again by a schema."""
    chunks = D.build_chunks(_conversation_blocks(spark, sf_dir))
    kind = "code int, msg string, data struct<doc_id:long,num_chunks:int,chunks:array<struct<index:int,chunk_id:string,chunk_type:string,content:string>>>"
    back = document_json(D.build_documents(chunks), chunks).select("doc_id", F.from_json("json", kind, {"mode": "FAILFAST"}).alias("j"))
    lines = F.transform("j.data.chunks", lambda c: F.concat_ws(" ", c["index"].cast("string"), c["chunk_id"], c["chunk_type"], c["content"]))
    return back.select(F.col("j.data.doc_id").alias("doc_id"), "j.code", "j.msg", "j.data.num_chunks", F.array_join(lines, "\n").alias("chunks"))


@query(WITH + "select doc_id, pnum, count(*) as n, cast(sum(length(text)) as bigint) as chars, min(text) as lowest, max(text) as highest from spans where pnum < 10 group by doc_id, pnum")
def dump_spans(spark, sf_dir):
    """The debug dump of the first pages, read again and summed up by page."""
    out = scratch(spark, "dump")
    sinks.dump({"spans": S.spans(spark, sf_dir)}, out)
    back = spark.read.schema("doc_id long, pnum int, text string").json(f"{out}/spans")
    return back.groupBy("doc_id", "pnum").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.min("text").alias("lowest"), F.max("text").alias("highest"))


@query(WITH + """, k as (select 'layout' kind, doc_id, pnum, label, x0, y0, x1, y1 from boxes
  union all select 'order', doc_id, pnum, cast(box_idx as varchar), x0, y0, x1, y1 from boxes where box_idx < 1000
  union all select 'detection', doc_id, pnum, null, x0 / 0.75::double, y0 / 0.75::double, x1 / 0.75::double, y1 / 0.75::double from lines
  union all select 'ocr', doc_id, pnum, text, x0 / 0.75::double, y0 / 0.75::double, x1 / 0.75::double, y1 / 0.75::double from spans)
select kind, doc_id, pnum, count(*) as marks, cast(sum(round(x0 * 12) + round(y0 * 12) + round(x1 * 12) + round(y1 * 12)) as bigint) as places, cast(sum(length(label)) as bigint) as label_chars
from k where pnum < 10 group by kind, doc_id, pnum""")
def dump_overlays(spark, sf_dir):
    """What the drawings of the first pages show, dumped by kind and read again."""
    out = scratch(spark, "overlays")
    spans = S.spans(spark, sf_dir)
    boxes = S.layout_boxes(S.block_table(spark, sf_dir))
    order = boxes.filter("box_idx < 1000").withColumn("position", F.col("box_idx"))
    kinds = {"layout": boxes, "order": order, "detection": S.line_table(spark, sf_dir), "ocr": spans}
    sinks.dump_overlays(kinds, out, {"detection": S.PAGE_BOX, "ocr": S.PAGE_BOX}, S.IMAGE_BOX)
    kind = "doc_id long, pnum int, marks array<struct<x0:double,y0:double,x1:double,y1:double,label:string>>"
    every = None
    for k in kinds:
        one = spark.read.schema(kind).json(f"{out}/{k}").select(F.lit(k).alias("kind"), "doc_id", "pnum", F.explode("marks").alias("m"))
        every = one if every is None else every.unionByName(one)
    places = sum((F.round(F.col(f"m.{c}") * 12) for c in ("y0", "x1", "y1")), F.round(F.col("m.x0") * 12))
    return every.groupBy("kind", "doc_id", "pnum").agg(F.count(F.lit(1)).alias("marks"), F.sum(places).cast("long").alias("places"), F.sum(F.length("m.label")).cast("long").alias("label_chars"))


@query(WITH + f""", {_CONV}, {_CHUNKS}, b as (select 'text_blocks' kind, doc_id, count(*) n, sum(length(text)) chars from cb group by doc_id),
t as (select 'full_text' kind, doc_id, cast(1 as bigint) n, sum(length(text) + case when p is null then 0 when p = 'Text' then 2 else 1 end) chars from (select *, lag(block_type) over (partition by doc_id order by "index") p from cb) group by doc_id)
select kind, doc_id, n, cast(chars as bigint) as chars from b union all select kind, doc_id, n, cast(chars as bigint) from t""")
def dump_documents(spark, sf_dir):
    """Whole texts and merged blocks, dumped and read again."""
    out = scratch(spark, "documents")
    blocks = _conversation_blocks(spark, sf_dir)
    sinks.dump_documents(D.full_text(blocks), blocks, None, out)
    back = lambda k: spark.read.schema("doc_id long, text string").json(f"{out}/{k}").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("long").alias("chars")).select(F.lit(k).alias("kind"), "doc_id", "n", "chars")
    return back("text_blocks").unionByName(back("full_text"))


@query(_sql_runs(100, 100))
def stream_ingest(spark, sf_dir):
    """Documents read as a stream, chunked, and written batch by batch."""
    from ..streaming import ingest

    out = scratch(spark, "stream")
    schema = table(spark, sf_dir, "documents").schema
    stream = ingest.documents(spark, f"{sf_dir}/documents.parquet*", schema, "fixed")
    q = ingest.write(stream, ingest.by_batch(f"{out}/rows"), f"{out}/state")
    q.awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("doc_id", F.col("pos").cast("long").alias("pos"), "chunk")


@query("""select conv_id doc_id, string_agg(coalesce(text, ''), chr(10) order by turn) as text, cast(count(*) as integer) n_pages, cast(count(*) as integer) n_seen, 'whole' status
from (select conv_id, turn, any_value(text) as text from conversations group by all) group by conv_id""")
def stream_assemble(spark, sf_dir):
    """Conversations whose turns arrive as pages in files in no order, put together by keyed state."""
    from ..streaming import assemble, ingest

    out = scratch(spark, "assemble")
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("pnum")).agg(F.any_value("text").alias("text"))
    n = turns.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("n_pages"))
    pages = turns.join(n, "doc_id").withColumn("event_time", F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.xxhash64("doc_id", "pnum"), F.lit(300))))
    pages.repartition(6, F.xxhash64("pnum", "doc_id")).write.parquet(f"{out}/pages")
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 2).parquet(f"{out}/pages")
    ingest.write(assemble.assemble(stream), ingest.by_batch(f"{out}/rows"), f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("batch")


@query("""select 'conv_id: ' || conv_id || ';turn: ' || turn || ';role: ' || coalesce(role, 'nan') || ';text: ' || regexp_replace(said, '^\\s+|\\s+$', '', 'g') as content
from (select conv_id, turn, role, '"' || coalesce(text, '') || '"' || chr(10) || 'end, of turn' said from conversations)""")
def src_csv_ranges(spark, sf_dir):
    """Conversations as CSV files with quotes and line ends in cells, read by byte ranges."""
    out = scratch(spark, "csv-files")
    said = F.concat(F.lit('"'), F.coalesce("text", F.lit("")), F.lit('"\nend, of turn'))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", said.alias("text"))
    turns.coalesce(4).write.option("header", True).option("escape", '"').csv(out)
    return csv_ranges.read(spark, out).select("content")


@query("""select doc_id, case when doc_id % 5 = 0 then 'again: ' || coalesce(text, '') else text end as text, cast(case when doc_id % 5 = 0 then 2 else 1 end as integer) as version
from documents where (doc_id % 3 <> 0 or doc_id % 5 = 0) and (doc_id % 7 <> 0 or doc_id % 5 = 0)""")
def store_versions(spark, sf_dir):
    """Documents put, replaced and deleted in a store with versions; one batch comes twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = store.Store(spark, scratch(spark, "documents-store"))
    first = docs.filter("doc_id % 3 <> 0").withColumn("version", F.lit(1))
    kept.write("first", first)
    replaced = docs.filter("doc_id % 5 = 0").select("doc_id", F.concat(F.lit("again: "), F.coalesce("text", F.lit(""))).alias("text"), F.lit(2).alias("version"))
    kept.write("second", replaced, docs.filter("doc_id % 7 = 0"))
    kept.write("first", first)
    return kept.read()
