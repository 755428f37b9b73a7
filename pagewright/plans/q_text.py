"""Queries of the text functions and chunkers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import chunking as C
from ..functions import sentences as S
from ..functions import text as T
from ..session import table
from .registry import query

NL, NBSP = "\n", " "
PROSE = "('Text','List-item','Footnote','Caption','Figure')"
#: Texts with what the functions look for.
PERTURBED = f"replace(replace(text, '. ', '.' || chr(10) || chr(10) || chr(10) || '• '), 'an ', 'an' || '{NBSP}')"


def _perturbed(c):
    return F.replace(F.replace(c, F.lit(". "), F.lit(".\n\n\n• ")), F.lit("an "), F.lit("an" + NBSP))


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\x{{00a0}}]+|[\\s\\x{{00a0}}]+$', '', 'g')"


def sql_join_lines(a: str, b: str, t: str, c: str) -> str:
    """SQL of `functions.text.join_lines`."""
    rs, ls = f"regexp_replace({a}, '\\s+$', '')", f"regexp_replace({b}, '^\\s+', '')"
    return f"""case
  when {a} <> '' and regexp_matches({a}, '(?s)[\\p{{Lo}}|\\p{{Ll}}|\\d][-—¬]\\s?$') and regexp_matches({b}, '^\\s?[\\p{{Lo}}|\\p{{Ll}}|\\d]')
    then regexp_replace(regexp_replace({a}, '[-—¬]\\s?$', ''), '\\s+$', '') || {ls}
  when {t} in ('Title','Section-header') then {rs} || ' ' || {ls}
  when {t} = 'Formula' then {a} || chr(10) || {b}
  when regexp_matches({a}, '(?s)[\\p{{Lo}}|\\p{{Ll}}|\\d][,;(—"''*]?\\s?$') and regexp_matches({b}, '^\\s?[\\p{{L}}|\\d]') and {t} in {PROSE} then {rs} || ' ' || {ls}
  when {c} then {rs} || ' ' || {ls}
  when {t} in {PROSE} and regexp_matches({a}, '(?s)[。ๆ.?!]\\s?$') then {a} || chr(10) || chr(10) || {b}
  when {t} = 'Table' then {a} || chr(10) || chr(10) || {b}
  else {a} || chr(10) || {b} end"""


def sql_title(x: str) -> str:
    first = "(case when w[1:1] = 'ß' then 'Ss' else upper(w[1:1]) end)"
    return f"array_to_string(list_transform(regexp_extract_all({x}, '(?s)[\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+|[^\\p{{Lu}}\\p{{Ll}}\\p{{Lt}}]+'), lambda w: {first} || lower(w[2:])), '')"


def sql_surround(x: str, t: str) -> str:
    s = sql_strip(x)
    return f"""case when {t} = 'Section-header' then case when starts_with({x}, '#') then {x} else chr(10) || '## ' || {sql_title(s)} || chr(10) end
  when {t} = 'Title' then case when starts_with({x}, '#') then {x} else '# ' || {sql_title(s)} || chr(10) end
  when {t} = 'Table' then chr(10) || {x} || chr(10)
  when {t} in ('List-item','Text') then replace({x}, '#', '\\#')
  when {t} = 'Code' then chr(10) || '```' || chr(10) || {x} || chr(10) || '```' || chr(10)
  when {t} = 'Formula' and starts_with({s}, '$$') and ends_with({s}, '$$') then chr(10) || {s} || chr(10)
  else {x} end"""


@query(f"select doc_id, unnest(range(0, len(c))) as pos, unnest(c) as chunk from (select doc_id, string_split({PERTURBED}, chr(10) || chr(10)) c from documents)")
def chunk_regex(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", _perturbed(F.col("text")).alias("text"))
    return C.chunk(docs, "regex").select("doc_id", F.col("pos").cast("long").alias("pos"), "chunk")


@query(rf"""
with s as (select doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) c from documents),
u as (select doc_id, unnest(range(0, len(c))) i, {sql_strip('unnest(c)')} t from s),
d as (select doc_id, t, min(i) i from u where t <> '' group by all)
select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as bigint) pos, t chunk from d""")
def chunk_sentence(spark, sf_dir):
    return C.chunk(_docs(spark, sf_dir), "sentence").select("doc_id", F.col("pos").cast("long").alias("pos"), "chunk")


def _sql_sentences() -> str:
    """Common steps of the queries of learnt sentences, up to `inside`: the pairs at which no sentence ends."""
    core = lambda x: rf"regexp_replace({x}, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}.]+$', '', 'g')"
    bare = lambda x: rf"lower(regexp_replace({core(x)}, '\.+$', ''))"
    kind_of = lambda x: f"regexp_replace({x}, '[{S.SPACE}]+$', '')"
    quote = S.ENDS.replace("'", "''")
    closers = r"""["'')\]}»”’›]+$"""

    def type_(x):
        return rf"case when regexp_matches({bare(x)}, '^[\p{{N}}][\p{{N}}.,:/-]*$') then '{S.NUMBER}' else {bare(x)} end"

    def kind(x):
        closed = f"regexp_replace({kind_of(x)}, '{closers}', '')"
        return rf"case when not regexp_matches({kind_of(x)}, '{quote}') then null when regexp_matches({closed}, '(\.\.|…)$') then '..' when ends_with({closed}, '.') then '.' else '!' end"

    def case(x):
        first = f"substring({core(x)}, 1, 1)"
        return rf"case when regexp_matches({first}, '\p{{Lu}}|\p{{Lt}}') then 'u' when regexp_matches({first}, '\p{{Ll}}') then 'l' else '' end"

    def some(k, m, p):
        return f"(case when {k} > 0 then {k} * ln({p}) else 0 end + case when {m} > {k} then ({m} - {k}) * ln(1 - {p}) else 0 end)"

    def ratio(a, b, ab, n):
        p2 = f"(case when {n} > {a} then ({b} - {ab}) / ({n} - {a}) else 0 end)"
        return f"-2 * ({some(ab, a, f'({b} / {n})')} + {some(f'({b} - {ab})', f'({n} - {a})', f'({b} / {n})')} - {some(ab, a, f'({ab} / {a})')} - {some(f'({b} - {ab})', f'({n} - {a})', p2)})"

    special = rf"(kind = '.' and (abbreviation or regexp_matches(\"type\", '^\p{{L}}$') or \"type\" = '{S.NUMBER}'))".replace('\\"', '"')
    letters = "cast(length(replace(\"type\", '.', '')) as double)"
    return rf"""
with p as (select doc_id, row_number() over () r, regexp_extract_all(coalesce(text, ''), '[^{S.SPACE}]+[{S.SPACE}]*') p from documents),
x as (select doc_id, r, unnest(range(1, len(p) + 1)) i, unnest(p) x from p),
y as (select *, {kind("x")} k, {core("x")} c, {type_("x")} "type", {case("x")} own from x),
z as materialized (select *, lead("type") over w as next, lead(own) over w as "case", i > 1 and lag(k) over w is null inside, lead(x) over w is null final from y window w as (partition by r order by i)),
counted as materialized (select "type", count_if(regexp_matches(c, '(^|[^.])\.$')) n_period, count_if(not regexp_matches(c, '(^|[^.])\.$')) n_plain, count_if(own = 'l') n_lower, count_if(own = 'u' and inside) n_upper
  from z where "type" <> '' group by "type"),
whole as (select cast(sum(n_period) as double) a, cast(sum(n_period + n_plain) as double) t from counted),
abbr as materialized (select "type", n_period, n_plain from counted, whole where n_period >= 2 and regexp_matches("type", '^[\p{{L}}][\p{{L}}.''-]*$') and length("type") > 1 and a < t and
  2 * ((n_period * ln(0.99) + n_plain * ln(0.01)) - (n_period * ln(a / t) + n_plain * ln(1 - a / t))) * exp(-{letters}) * (length("type") - {letters} + 1) * pow({letters}, -n_plain) >= {S.ABBREVIATION}),
spots as materialized (select "type", k kind, next, "case", "type" in (select "type" from abbr) abbreviation, cast(count(*) as double) n from z where k is not null and not final group by all),
sure as (select next, n from spots where not {special} and next <> ''),
breaks as (select sum(n) b from sure),
starters as materialized (select next from (select next, sum(n) ab, any_value(cast(n_period + n_plain as double)) o from sure join counted on counted."type" = next group by next), breaks, whole
  where {ratio("b", "o", "ab", "t")} >= {S.STARTER} and ab * t > b * o),
held as (select spots."type", next, sum(n) ab, any_value(cast(c.n_period as double)) ot, any_value(cast(d.n_period + d.n_plain as double)) o from spots join counted c on c."type" = spots."type" join counted d on d."type" = next
  where {special.replace('"type"', 'spots."type"')} and next <> '' group by all),
pairs as materialized (select "type", next from (select *, greatest(ot, ab) u, greatest(o, ab) v from held), whole where {ratio("u", "v", "ab", "t")} >= {S.PAIR} and ab > 1 and ab * t > ot * o and next not in (select next from starters)),
common as materialized (select "type" from counted where n_lower > 0 and n_lower >= 9 * n_upper),
flags as (select *, next in (select next from starters) starter, next in (select "type" from common) common, ("type", next) in (select ("type", next) from pairs) pair from spots),
inside as materialized (select "type", kind, next, "case" from flags where case when kind = '..' then "case" = 'l' when not {special} then false
  when "type" = '{S.NUMBER}' then pair or "case" = 'l' else pair or "case" <> 'u' or not (common or (starter and abbreviation)) end)
"""


@query(_sql_sentences() + 'select "type", n_period, n_plain from abbr')
def sentence_abbreviations(spark, sf_dir):
    return S.learn(_docs(spark, sf_dir)).abbreviations


@query(
    _sql_sentences()
    + f""", s as (select z.doc_id, z.r, z.i, z.x, z.k is not null and not z.final and inside."type" is null as ends from z left join inside on inside."type" = z."type" and inside.kind = z.k and inside.next = z.next and inside."case" = z."case"),
g as (select *, coalesce(sum(cast(ends as int)) over (partition by r order by i rows between unbounded preceding and 1 preceding), 0) g from s),
u as (select doc_id, r, g, regexp_replace(string_agg(x, '' order by i), '[{S.SPACE}]+$', '') t from g group by all),
d as (select doc_id, r, t, min(g) g from u group by all)
select doc_id, cast(row_number() over (partition by r order by g) - 1 as bigint) pos, t chunk from d"""
)
def chunk_learned_sentence(spark, sf_dir):
    return C.chunk(_docs(spark, sf_dir), "learned_sentence").select("doc_id", F.col("pos").cast("long").alias("pos"), "chunk")



def _sql_runs(size, step):
    return f"""with w as (select doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') w from documents),
i as (select doc_id, w, unnest(range(0, len(w), {step})) k from w)
select doc_id, cast(k // {step} as bigint) pos, array_to_string(w[k + 1:k + {size}], ' ') chunk from i"""


@query(_sql_runs(100, 100))
def chunk_fixed(spark, sf_dir):
    return C.chunk(_docs(spark, sf_dir), "fixed").select("doc_id", F.col("pos").cast("long").alias("pos"), "chunk")


@query(_sql_runs(100, 50))
def chunk_sliding(spark, sf_dir):
    return C.chunk(_docs(spark, sf_dir), "sliding").select("doc_id", F.col("pos").cast("long").alias("pos"), "chunk")


def _sql_topics(width: int = 20, around: int = 10) -> str:
    by = "partition by r order by g"
    return rf"""
with d as (select doc_id, row_number() over () r, coalesce(text, '') as text from documents where regexp_replace(coalesce(text, ''), '[\s\x{{a0}}]+', '', 'g') <> ''),
x as (select *, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+[^\p{{L}}\p{{N}}_]*') x from d),
e as (select r, (len(x) + {width - 1}) // {width} nb, unnest(range(0, len(x))) i, unnest(x) piece from x where (len(x) + {width - 1}) // {width} >= 3),
c as (select r, nb, i // {width} p, lower(regexp_extract(piece, '[\p{{L}}\p{{N}}_]+')) w, case when contains(piece, chr(10)) then i + 1 end ends from e),
n as materialized (select r, nb, p, w, count(*) n from c where w not in ({", ".join("'" + w.replace("'", "''") + "'" for w in C.STOP_WORDS)}) group by all),
gaps as (select r, nb, unnest(range(1, nb)) g from (select distinct r, nb from e)),
k as (select *, least({around}, g, nb - g) k from gaps),
h as (select k.r, g, w, sum(case when p < g then n else 0 end) a, sum(case when p >= g then n else 0 end) b from k join n on n.r = k.r and p >= g - k and p < g + k group by all),
v as (select r, g, sum(a * b) ab, sum(a * a) aa, sum(b * b) bb from h group by all),
s0 as (select k.r, k.g, case when sqrt(cast(aa as double) * cast(bb as double)) > 0 then cast(ab as double) / sqrt(cast(aa as double) * cast(bb as double)) else 0 end s from k left join v on v.r = k.r and v.g = k.g),
s1 as (select r, g, (coalesce(lag(s) over ({by}), s) + s + coalesce(lead(s) over ({by}), s)) / 3 s from s0),
s2 as (select *, case when coalesce(lag(s) over ({by}) < s, true) then s end l, case when coalesce(lead(s) over ({by}) < s, true) then s end rr from s1),
s3 as (select r, g, last_value(l ignore nulls) over ({by} rows between unbounded preceding and current row) + first_value(rr ignore nulls) over ({by} rows between current row and unbounded following) - 2 * s depth from s2),
s4 as (select *, greatest(avg(depth) over (partition by r) - stddev_pop(depth) over (partition by r) / 2, 0) cut, coalesce(max(depth) over ({by} rows between 3 preceding and 1 preceding), -1) b, coalesce(max(depth) over ({by} rows between 1 following and 3 following), -1) a from s3),
f as (select r, g from s4 where depth > cut and depth > b and depth >= a),
l as (select r, p g, min(ends) first, max(ends) last from c group by all),
m as (select r, g, max(last) over ({by} rows between unbounded preceding and 1 preceding) b, min(first) over ({by} rows between current row and unbounded following) a from l),
cuts as (select r, list_sort(list(distinct cut)) cuts from (select f.r, coalesce(case when b is null then a when a is null or f.g * {width} - b <= a - f.g * {width} then b else a end, f.g * {width}) cut from f join m on m.r = f.r and m.g = f.g) group by r),
t as (select doc_id, x.r, text, x, list_concat([0], list_filter(coalesce(cuts, []), lambda c: c > 0 and c < len(x)), [len(x)]) ends from x left join cuts on cuts.r = x.r),
u as (select *, unnest(range(1, len(ends))) q from t),
z as (select doc_id, r, q - 1 pos, text, ends[q] b, ends[q + 1] e, len(x) n, array_to_string(x[ends[q] + 1:ends[q + 1]], '') own, x[ends[q]] before, x[ends[q + 1]] final from u)
select doc_id, pos, case when pos = 0 then regexp_extract(text, '^[^\p{{L}}\p{{N}}_]*') when contains(before, chr(10)) then regexp_extract(before, '[^\n]*$') else '' end
  || substring(own, 1, length(own) - case when e < n and contains(final, chr(10)) then length(regexp_extract(final, '[^\n]*$')) else 0 end) chunk from z
"""


@query(_sql_topics())
def chunk_topic(spark, sf_dir):
    return C.chunk(_docs(spark, sf_dir), "topic").select("doc_id", F.col("pos").cast("long").alias("pos"), "chunk")


@query(
    rf"""
with segments as ({_sql_topics()}),
t as (select doc_id, pos, regexp_extract_all(chunk, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]') w from segments),
u as (select doc_id, pos, unnest(range(0, len(w))) i, unnest(w) token from t),
k as (select doc_id, pos, lower(token) keyword, count(*) n, min(i) f from u
  where token not in ({", ".join("'" + w.replace("'", "''") + "'" for w in C.STOP_WORDS)}) and not contains('{C.PUNCTUATION.replace("'", "''")}', token) group by all),
r as (select *, row_number() over (partition by doc_id, pos order by n desc, f) "rank" from k)
select doc_id, pos, keyword, n, cast("rank" as int) "rank" from r where "rank" <= 3"""
)
def chunk_topic_keywords(spark, sf_dir):
    return C.top_keywords(C.chunk(_docs(spark, sf_dir), "topic").withColumn("pos", F.col("pos").cast("long")), ["doc_id", "pos"], "chunk")


@query(
    rf"""
with t as (select doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]') w from documents),
u as (select doc_id, unnest(range(0, len(w))) i, unnest(w) token from t),
k as (select doc_id, lower(token) keyword, count(*) n, min(i) f from u
  where token not in ({", ".join("'" + w.replace("'", "''") + "'" for w in C.STOP_WORDS)}) and not contains('{C.PUNCTUATION.replace("'", "''")}', token) group by all),
r as (select *, row_number() over (partition by doc_id order by n desc, f) "rank" from k)
select doc_id, keyword, n, cast("rank" as int) "rank" from r where "rank" <= 3""")
def topk_keywords(spark, sf_dir):
    return C.top_keywords(_docs(spark, sf_dir), ["doc_id"])


@query(rf"select doc_id, replace(regexp_replace(regexp_replace({PERTURBED}, '\n{{3,}}', chr(10) || chr(10), 'g'), '(\n[\s\x{{00a0}}]){{3,}}', chr(10) || chr(10), 'g'), '{NBSP}', ' ') as text from documents")
def cleanup_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.cleanup_text(_perturbed(F.col("text"))).alias("text"))


@query(rf"select doc_id, regexp_replace({PERTURBED}, '(^|[\n ])[•●○■▪▫–—]( )', '\1-\2', 'g') as text from documents")
def replace_bullets(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.replace_bullets(_perturbed(F.col("text"))).alias("text"))


@query(r"select doc_id, replace(replace(text, 'The ', '# The '), '#', '\#') as text from documents")
def escape_markdown(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.escape_markdown(F.replace("text", F.lit("The "), F.lit("# The "))).alias("text"))


@query(r"""select doc_id, regexp_extract(t, '^(\s*)', 1) || '**' || regexp_replace(t, '^\s+|\s+$', '', 'g') || '**' || regexp_extract(t, '(\s*)$', 1) as text
from (select doc_id, case doc_id % 4 when 0 then '  ' || text || ' ' || chr(10) when 1 then chr(9) || text when 2 then '   ' else text end t from documents)""")
def surround_text(spark, sf_dir):
    t = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("  "), "text", F.lit(" \n"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("\t"), "text")).when(F.col("doc_id") % 4 == 2, F.lit("   ")).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", T.surround_text(t, "**").alias("text"))


@query(rf"""select doc_id, regexp_replace(t, '\s*(?:\.\s*){{4,}}', ' ', 'g') as dots, {sql_strip(r"regexp_replace(t, '[\r\n]+', ' ', 'g')")} as lines
from (select doc_id, replace(text, ', ', ' . . . . . ') t from documents)""")
def replace_dots(spark, sf_dir):
    t = F.replace("text", F.lit(", "), F.lit(" . . . . . "))
    return _docs(spark, sf_dir).select("doc_id", T.replace_dots(t).alias("dots"), T.replace_newlines(t).alias("lines"))


TYPES = ["Text", "Title", "Section-header", "List-item", "Table", "Formula", "Code", "Caption"]
_SQL_TYPES = "[" + ", ".join(f"'{t}'" for t in TYPES) + "]"


def _type(c):
    return F.element_at(F.array(*[F.lit(t) for t in TYPES]), (c % len(TYPES) + 1).cast("int"))


@query(f"""select conv_id, turn, {sql_surround('x', 't')} as text
from (select conv_id, turn, {_SQL_TYPES}[cast((conv_id + turn) % 8 + 1 as int)] t, case when conv_id % 3 = 0 then '# ' || text when conv_id % 3 = 1 then '$$' || text || '$$ ' else ' ' || text end x from conversations)""")
def block_surround(spark, sf_dir):
    x = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("# "), "text")).when(F.col("conv_id") % 3 == 1, F.concat(F.lit("$$"), "text", F.lit("$$ "))).otherwise(F.concat(F.lit(" "), "text"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", _type(F.col("conv_id") + F.col("turn")).alias("t"), x.alias("x"))
    return c.select("conv_id", "turn", T.block_surround(F.col("x"), F.col("t")).alias("text"))


@query(f"""with p as (select conv_id, turn, {_SQL_TYPES}[cast((conv_id + turn) % 8 + 1 as int)] t, text || case turn % 4 when 0 then '-' when 1 then ' a,' when 2 then ' a' else '' end a,
  lead(case when turn % 2 = 0 then lower(text) else text end) over (partition by conv_id order by turn) b, conv_id % 5 = 0 c from conversations)
select conv_id, turn, {sql_join_lines('a', 'b', 't', 'c')} as text from p where b is not null""")
def line_separator(spark, sf_dir):
    tail = F.when(F.col("turn") % 4 == 0, "-").when(F.col("turn") % 4 == 1, " a,").when(F.col("turn") % 4 == 2, " a").otherwise("")
    low = F.when(F.col("turn") % 2 == 0, F.lower("text")).otherwise(F.col("text"))
    p = table(spark, sf_dir, "conversations").select("conv_id", "turn", _type(F.col("conv_id") + F.col("turn")).alias("t"), F.concat("text", tail).alias("a"), F.lead(low).over(W.partitionBy("conv_id").orderBy("turn")).alias("b"), (F.col("conv_id") % 5 == 0).alias("c"))
    return p.filter("b is not null").select("conv_id", "turn", T.join_lines(F.col("a"), F.col("b"), F.col("t"), F.col("c")).alias("text"))


_OCR_CASES = "case doc_id % 7 when 0 then repeat('�', 40) || text when 1 then repeat(chr(10), 200) when 2 then repeat(' x', 50) when 3 then repeat('%', 50) when 4 then '' else text end"


def _ocr_cases():
    k = F.col("doc_id") % 7
    return F.when(k == 0, F.concat(F.lit("�" * 40), "text")).when(k == 1, F.lit("\n" * 200)).when(k == 2, F.lit(" x" * 50)).when(k == 3, F.lit("%" * 50)).when(k == 4, F.lit("")).otherwise(F.col("text"))


SQL_RATIO = r"case when length(regexp_replace({x}, '[ \n]', '', 'g')) = 0 then 1.0 else length(regexp_replace(regexp_replace({x}, '[ \n]', '', 'g'), '[^\p{{L}}\p{{N}}]', '', 'g')) / length(regexp_replace({x}, '[ \n]', '', 'g')) end"


def sql_bad_ocr(x: str) -> str:
    ns, rest = f"len(regexp_extract_all({x}, '\\s+'))", f"length(regexp_replace({x}, '\\s+', '', 'g'))"
    nl, other = f"len(regexp_extract_all({x}, '\\n+'))", f"length(regexp_replace({x}, '\\n+', '', 'g'))"
    return f"""case when length({x}) = 0 then true when {ns} / ({rest} + {ns}) > 0.7 then true when {nl} / ({nl} + {other}) > 0.6 then true
  when {SQL_RATIO.format(x=x)} < 0.3 then true else length({x}) - length(replace({x}, '�', '')) > greatest(6.0, length({x}) * 0.03) end"""


@query(f"select doc_id, {sql_bad_ocr('x')} as bad from (select doc_id, {_OCR_CASES} x from documents)")
def bad_ocr(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", _ocr_cases().alias("x")).select("doc_id", T.bad_ocr(F.col("x")).alias("bad"))


@query(f"select doc_id, {SQL_RATIO.format(x='x')} as ratio from (select doc_id, {_OCR_CASES} x from documents)")
def alphanum_ratio(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", _ocr_cases().alias("x")).select("doc_id", T.alphanum_ratio(F.col("x")).alias("ratio"))


@query("select l_orderkey, l_linenumber, concat_ws('_', " + ", ".join(f"case when f & {1 << b} > 0 then '{n}' end" for b, n in T.FONT_FLAGS) + ") as flags from (select l_orderkey, l_linenumber, (l_orderkey * 7919 + l_linenumber * 104729) % 1048576 f from lineitem)")
def font_flags(spark, sf_dir):
    f = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 104729) % 1048576
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.font_flags(f).alias("flags"))


@query(r"""select page_id, regexp_replace(replace(replace(string_split(url, '/')[-1], ' ', '_'), '%20', '_'), '[^a-zA-Z0-9_.-]', '', 'g')[1:50] || '_' || md5(url)[1:8] as name from pages""")
def normalize_uri(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.normalize_uri(F.col("url")).alias("name"))


@query("select page_id, md5(to_base64(encode(html))) as encoded, octet_length(encode(html)) as n_bytes, true as same from pages")
def b64_roundtrip(spark, sf_dir):
    e = T.base64_text(F.col("html").cast("binary"))
    p = table(spark, sf_dir, "pages").withColumn("e", e)
    return p.select("page_id", F.md5(F.col("e").cast("binary")).alias("encoded"), F.octet_length(F.unbase64("e")).cast("long").alias("n_bytes"), (F.unbase64("e") == F.col("html").cast("binary")).alias("same"))


_SQL_ROWS = "(select r_regionkey, [['key', 'name']] || list([cast(n_nationkey as varchar), n_name] order by n_nationkey) as t from nation join region on n_regionkey = r_regionkey group by r_regionkey)"


def _rows(spark, sf_dir):
    """The nations of each region as a table of texts."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    some = n.groupBy("r_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("s"))
    cells = F.transform("s", lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"]))
    return some.select("r_regionkey", F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), cells).alias("t"))


@query(f"select r_regionkey, array_to_string(list_transform(t, lambda r: array_to_string(r, ',')), chr(10)) as csv from {_SQL_ROWS}")
def csv_dumps(spark, sf_dir):
    return _rows(spark, sf_dir).select("r_regionkey", T.csv_dump(F.col("t")).alias("csv"))


@query(f"""select r_regionkey, array_to_string(['| ' || rpad(t[1][1], w1, ' ') || ' | ' || rpad(t[1][2], w2, ' ') || ' |', '|' || repeat('-', w1 + 2) || '|' || repeat('-', w2 + 2) || '|']
  || list_transform(t[2:], lambda r: '| ' || rpad(r[1], w1, ' ') || ' | ' || rpad(r[2], w2, ' ') || ' |'), chr(10)) as markdown
from (select *, cast(greatest(length(t[1][1]) + 2, list_max(list_transform(t, lambda r: length(r[1])))) as int) w1, cast(greatest(length(t[1][2]) + 2, list_max(list_transform(t, lambda r: length(r[2])))) as int) w2 from {_SQL_ROWS})""")
def table_github(spark, sf_dir):
    return _rows(spark, sf_dir).select("r_regionkey", T.github_table(F.col("t")).alias("markdown"))


@query(f"""select r_regionkey, array_to_string(['| ' || array_to_string(t[1], ' | ') || ' |', '| --- | --- |'] || list_transform(t[2:], lambda r: '| ' || array_to_string(r, ' | ') || ' |'), chr(10)) as markdown from {_SQL_ROWS}""")
def table_to_markdown(spark, sf_dir):
    return _rows(spark, sf_dir).select("r_regionkey", T.markdown_table(F.col("t")).alias("markdown"))


@query("select p_partkey, 'p_partkey: ' || p_partkey || ';p_name: ' || trim(p_name) || ';p_size: ' || coalesce(cast(case when p_partkey % 5 <> 0 then p_size end as varchar), 'nan') as content from part")
def row_to_text_csv(spark, sf_dir):
    size = F.when(F.col("p_partkey") % 5 != 0, F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", T.csv_row_text([("p_partkey", F.col("p_partkey")), ("p_name", F.col("p_name")), ("p_size ", size)]).alias("content"))


@query("""select p_partkey, concat_ws(';', case when p_partkey % 7 <> 0 then '"name":"' || p_name || '"' end, case when p_partkey % 5 <> 0 then '"size":"' || p_size || '"' end) as content from part where not (p_partkey % 7 = 0 and p_partkey % 5 = 0)""")
def row_to_text_excel(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_name")).alias("name"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")).alias("size"))
    return p.dropna("all", subset=["name", "size"]).select("p_partkey", T.sheet_row_text([("name", F.col("name")), ("size", F.col("size"))]).alias("content"))


@query("select doc_id, octet_length(encode(text)) as n_tokens, cast(ceil(octet_length(encode(text)) / 1024) as int) as n_rows, cast(ceil(octet_length(encode(text)) / 1024) * 1024 - octet_length(encode(text)) as int) as n_pad from documents")
def byte_token_counts(spark, sf_dir):
    t = T.byte_tokens(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", t.alias("t")).select("doc_id", F.col("t.n_tokens").cast("long").alias("n_tokens"), "t.n_rows", F.col("t.n_pad").cast("int").alias("n_pad"))


@query("""with b as (select item_id, regexp_extract_all(hex(encode(text)), '..') h from benchmark),
i as (select item_id, [cast('0x' || x as int) + 3 for x in h] ids, (1024 - len(h) % 1024) % 1024 pad from b where len(h) > 0),
p as (select item_id, list_concat(ids, list_resize(cast([] as int[]), pad, 0)) ids from i)
select item_id, cast(k // 1024 as int) "row", ids[k + 1:k + 1024] ids from (select item_id, ids, unnest(range(0, len(ids), 1024)) k from p)""")
def byte_tokens(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.byte_token_rows(F.col("text"))).alias("row", "ids"))


@query(r"""with c as (select item_id, text, unnest(range(1, length(text) + 1)) i from benchmark), x as (select item_id, i, substr(text, i, 1) ch from c)
select item_id, string_agg(case when i % 11 = 0 then chr(10) || ch when i % 7 = 0 then case when regexp_full_match(ch, '\s') then '' else ch end when i % 13 = 0 then ' ' || ch else ch end, '' order by i) as text from x group by item_id""")
def edit_apply(spark, sf_dir):
    labels = F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: F.when(i % 11 == 0, "newline-1").when(i % 7 == 0, "delete").when(i % 13 == 0, "space-1").otherwise("equal"))
    return table(spark, sf_dir, "benchmark").select("item_id", T.apply_edits(F.col("text"), labels).alias("text"))


@query("select event_id, strftime(ts + interval 8 hour, '%Y-%m-%d %H:%M:%S') as at from events")
def format_ts(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.zone_time(F.col("ts").cast("timestamp")).alias("at"))


@query(r"""select doc_id, regexp_replace(replace(translate(x, '‘’“”', '''''""'), 'ﬁ', 'fi'), '\r\n?', chr(10), 'g') as text from (select doc_id, replace(replace(replace(text, 'a ', '‘a’ '), 'fi', 'ﬁ'), '. ', '.' || chr(13) || chr(10)) x from documents)""")
def fix_text_subset(spark, sf_dir):
    x = F.replace(F.replace(F.replace("text", F.lit("a "), F.lit("‘a’ ")), F.lit("fi"), F.lit("ﬁ")), F.lit(". "), F.lit(".\r\n"))
    return _docs(spark, sf_dir).select("doc_id", T.fix_text(x).alias("text"))


@query("select doc_id, text as once, text as twice, text as kept, text || 'é' as mixed from documents")
def fix_encoding(spark, sf_dir):
    """Texts whose bytes were read as Latin-1, once and twice, and mended; and what has to stay as it is."""
    misread = lambda c: F.decode(c.cast("binary"), "ISO-8859-1")
    d = _docs(spark, sf_dir)
    mixed = F.concat("text", F.lit("é"))
    return d.select("doc_id", T.fix_encoding(misread(F.col("text"))).alias("once"), T.fix_encoding(misread(misread(F.col("text")))).alias("twice"), T.fix_encoding(F.col("text")).alias("kept"), T.fix_encoding(mixed).alias("mixed"))


@query("""select doc_id, cast(p as integer) page, 'é right ' || regexp_replace(text, '[\\x{e0}-\\x{ff}]', 'ô', 'g') || ' über ñ' as text
from (select doc_id, regexp_replace(coalesce(text, ''), '[^\\x00-\\x7f\\x{c0}-\\x{ff}]', '', 'g') as text from documents), (select unnest([0, 1, 2, 3]) p)""")
def fix_mixed_encoding(spark, sf_dir):
    """Texts that were read by four code pages, between words that are right; mended word by word."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7f\xc0-\xff]", ""), r"[\xe0-\xff]", "ô")
    latin = F.decode(plain.cast("binary"), "ISO-8859-1")
    misread = [F.translate(latin, as_bytes, letters) for letters, as_bytes in map(T.code_page, ("latin_1", "mac_roman", "cp437", "cp850"))]
    d = _docs(spark, sf_dir).select("doc_id", F.explode(F.array(*[F.struct(F.lit(i).alias("page"), t.alias("t")) for i, t in enumerate(misread)])).alias("m"))
    return d.select("doc_id", "m.page", T.fix_mixed_encoding(F.concat(F.lit("é right "), "m.t", F.lit(" über ñ"))).alias("text"))
