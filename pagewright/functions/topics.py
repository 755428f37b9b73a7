"""Topic segments of texts, after Hearst's TextTiling (1997), as aggregates and windows.

Words stand in blocks of `width`; at each gap between two blocks, `around` blocks on either side are compared by the cosine
of their counts of words. A gap whose similarity lies far below the peaks on both sides is deep. Gaps deeper than the mean
less half a deviation, and not less deep than any within `apart` blocks, are borders; a border moves to the nearest line
end, if the text has one.

Texts are dealt whole, into parts by their bytes; words are counted, and sums taken over gaps, where the text is, so that
counts never move. What is about a whole text has one row a gap.

Defined results: a null or blank text has no segments; one of less than three blocks is one segment; repeated rows are
texts of their own; equally deep gaps near each other: the first; the key may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Gaps of a text that is long, for tests.
TILE = 64
#: Bytes of texts that a task takes.
TASK_BYTES = 2_000_000
WORD = r"[\p{L}\p{N}_]+"
#: A word with all marks and white space behind it.
PIECE = r"[\p{L}\p{N}_]+[^\p{L}\p{N}_]*"
#: Blocks between two borders at least.
APART = 4


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0))


def block_words(docs: DataFrame, key: str, text: str, width: int, stop: list[str]) -> DataFrame:
    """(key, h, n_blocks, p, w, n, first, last): counts of words by block, w null for what a block has besides: the first
    and last place of its words at which a line ends, as numbers of the words behind them."""
    d = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), pieces(F.col(text)).alias("x")).withColumn("n_blocks", F.expr(f"(size(x) + {width - 1}) div {width}")).filter("n_blocks >= 3")
    e = d.select("key", "h", "n_blocks", F.posexplode("x").alias("i", "piece"))
    w = F.lower(F.regexp_extract("piece", WORD, 0))
    ends = F.when(F.contains("piece", F.lit("\n")), F.col("i") + 1)
    e = e.select("key", "h", "n_blocks", F.expr(f"cast(i div {width} as int)").alias("p"), F.when(~w.isin(*stop), w).alias("w"), ends.alias("ends"))
    return e.groupBy("key", "h", "n_blocks", "p", "w").agg(F.count(F.lit(1)).alias("n"), F.min("ends").alias("first"), F.max("ends").alias("last"))


def gap_scores(counts: DataFrame, around: int) -> DataFrame:
    """(key, h, n_blocks, g, s, before, after): the similarity at each gap g, between the blocks g - 1 and g, and the line
    ends next to it.

    A word of block p stands behind the gaps from `lo` to p, and before those from p + 1 to `hi`: its counts change at three
    gaps only, and sums of what changes give the sums of products at all gaps."""
    p, n, n_blocks = F.col("p"), F.col("n"), F.col("n_blocks")
    lo = F.greatest(p - (around - 1), F.expr("cast(p div 2 as int)") + 1)
    hi = F.least(p + around, F.expr("cast((p + n_blocks) div 2 as int)"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("int")
    behind, ahead = F.when(lo <= p, n).otherwise(zero), F.when(p + 1 <= hi, n).otherwise(zero)
    change = lambda g, a, b, first=none, last=none: F.struct(g.alias("g"), a.alias("a"), b.alias("b"), first.alias("first"), last.alias("last"))
    changes = F.array(change(F.when(lo <= p, lo), zero, behind), change(p + 1, ahead, -behind, F.col("first"), F.col("last")), change(F.when(p + 1 <= hi, hi + 1), -ahead, zero))
    each = counts.select("key", "h", "n_blocks", "w", F.explode(changes).alias("e")).select("key", "h", "n_blocks", "w", "e.*").filter("g <= n_blocks")
    by_word = each.groupBy("key", "h", "n_blocks", "w", "g").agg(F.sum("a").alias("da"), F.sum("b").alias("db"), F.min("first").alias("first"), F.max("last").alias("last"))
    so_far = W.partitionBy("key", "h", "n_blocks", "w").orderBy("g").rowsBetween(W.unboundedPreceding, 0)
    by_word = by_word.withColumn("a", F.sum("da").over(so_far)).withColumn("b", F.sum("db").over(so_far))
    grown = lambda x, y: F.sum(F.when(F.col("w").isNotNull(), F.col(x) * F.col(y) - (F.col(x) - F.col(f"d{x}")) * (F.col(y) - F.col(f"d{y}"))).otherwise(0))
    gap = by_word.groupBy("key", "h", "n_blocks", "g").agg(grown("a", "b").alias("ab"), grown("a", "a").alias("aa"), grown("b", "b").alias("bb"), F.min("first").alias("first"), F.max("last").alias("last"))
    doc = W.partitionBy("key", "h", "n_blocks")
    up, down = doc.orderBy("g").rowsBetween(W.unboundedPreceding, 0), doc.orderBy(F.desc("g")).rowsBetween(W.unboundedPreceding, -1)
    gap = gap.select("key", "h", "n_blocks", "g", *[F.sum(x).over(up).alias(x) for x in ("ab", "aa", "bb")], F.max("last").over(up).alias("before"), F.min("first").over(down).alias("after"))
    norm = F.sqrt(F.col("aa").cast("double") * F.col("bb").cast("double"))
    return gap.filter("g < n_blocks").select("key", "h", "n_blocks", "g", F.when(norm > 0, F.col("ab") / norm).otherwise(0.0).alias("s"), "before", "after")


def borders(scores: DataFrame) -> DataFrame:
    """(key, h, g, before, after) of the gaps that are borders."""
    doc = W.partitionBy("key", "h")
    by = doc.orderBy("g")
    s = F.col("s")
    smooth = (F.coalesce(F.lag("s").over(by), s) + s + F.coalesce(F.lead("s").over(by), s)) / 3
    d = scores.withColumn("s", smooth)
    # climbing to one side ends where the next one is lower; the peak is there
    left = F.when(F.lag("s").over(by).isNull() | (F.lag("s").over(by) < s), s)
    right = F.when(F.lead("s").over(by).isNull() | (F.lead("s").over(by) < s), s)
    d = d.withColumn("l", left).withColumn("r", right)
    peaks = F.last("l", True).over(by.rowsBetween(W.unboundedPreceding, 0)) + F.last("r", True).over(doc.orderBy(F.desc("g")).rowsBetween(W.unboundedPreceding, 0))
    d = d.withColumn("depth", peaks - 2 * s)
    cut = F.greatest(F.avg("depth").over(doc) - F.stddev_pop("depth").over(doc) / 2, F.lit(0.0))
    before = F.coalesce(F.max("depth").over(by.rowsBetween(1 - APART, -1)), F.lit(-1.0))
    after = F.coalesce(F.max("depth").over(by.rowsBetween(1, APART - 1)), F.lit(-1.0))
    d = d.withColumn("is", (F.col("depth") > cut) & (F.col("depth") > before) & (F.col("depth") >= after))
    return d.filter("is").select("key", "h", "g", "before", "after")


def segments(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 20, block: int = 10, stop: list[str] | None = None) -> DataFrame:
    """key, pos, chunk: the topic segments of each text, in order."""
    from . import chunking

    # whole texts are dealt once, and all that is counted stays with them
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n_tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    dealt = docs.select(key, text).repartition(n_tasks, F.col(key), F.xxhash64(text))
    found = borders(gap_scores(block_words(dealt, key, text, width, stop if stop is not None else chunking.STOP_WORDS), block))
    same = lambda a, b: F.col(f"{a}.key").eqNullSafe(F.col(f"{b}.key")) & (F.col(f"{a}.h") == F.col(f"{b}.h"))
    at = F.col("g") * width
    nearest = F.when(F.col("before").isNull(), F.col("after")).when(F.col("after").isNull() | (at - F.col("before") <= F.col("after") - at), F.col("before")).otherwise(F.col("after"))
    cut = found.select("key", "h", F.coalesce(nearest, at).cast("int").alias("cut"))
    cuts = cut.groupBy("key", "h").agg(F.sort_array(F.collect_set("cut")).alias("cuts"))
    d = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("h"), F.coalesce(text, F.lit("")).alias("text")).filter(F.length(F.regexp_replace("text", r"(?U)\s+", "")) > 0)
    d = d.alias("d").join(cuts.alias("c"), same("d", "c"), "left").select("d.key", "d.text", "c.cuts", pieces(F.col("d.text")).alias("x"))
    n = F.size("x")
    inner = F.filter(F.coalesce("cuts", F.array().cast("array<int>")), lambda c: (c > 0) & (c < n))
    d = d.withColumn("ends", F.concat(inner, F.array(n)))
    # what follows the last line end behind a word belongs to the next one
    lead = lambda i: F.when(F.contains(F.get("x", i), F.lit("\n")), F.regexp_extract(F.get("x", i), r"[^\n]*\z", 0)).otherwise(F.lit(""))
    head = F.regexp_extract("text", r"^[^\p{L}\p{N}_]*", 0)

    def segment(end: Column, k: Column) -> Column:
        start = F.when(k == 0, F.lit(0)).otherwise(F.get("ends", k - 1))
        own = F.array_join(F.slice("x", start + 1, end - start), "")
        tail = F.when(end < n, F.length(lead(end - 1))).otherwise(0)
        return F.concat(F.when(k == 0, head).otherwise(lead(start - 1)), F.substring(own, F.lit(1), F.length(own) - tail))

    return d.select(F.col("key").alias(key), F.posexplode(F.transform("ends", segment)).alias("pos", "chunk"))
