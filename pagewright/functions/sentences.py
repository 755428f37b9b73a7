"""Sentence boundaries with abbreviations learnt from the corpus itself, without labels.

After Kiss and Strunk, "Unsupervised multilingual sentence boundary detection" (2006): a word is an abbreviation if it
stands before a period more firmly than chance says, is short, and hardly ever stands without one. What follows it is
judged by statistics too: words that begin sentences unusually often, pairs that occur together unusually often, and
how a word is written inside of sentences. The paper keeps a flag of whether a word was ever seen in a form; in a very
large corpus everything was, so that counts are compared here.

Everything is counted by aggregates: one row for each word, and one for each (word, next word) at a possible end, which
is a small part of the text. Decisions are taken on these rows, not on occurrences; texts are then cut by joining the
pairs that aren't ends. A text is gathered only to put its own pieces together, and moves once.

Defined results: a null or blank text has no sentences; a text without end marks is one; repeated rows, and rows without
a key, are documents of their own; what has no period before white space is never looked up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, scratch

# The characters that part words, end sentences, and may close after an end.
SPACE = r" \t\n\r\f\x0B\x{A0}\x{85}\x{2028}\x{2029}\x{3000}"
ENDS = r"""[.!?…。！？]["')\]}»”’›]*$"""
#: Thresholds of the paper: score of an abbreviation, log-likelihoods of a sentence starter and of a pair.
ABBREVIATION, STARTER, PAIR = 0.3, 30.0, 7.88
NUMBER = "##number##"


@dataclass(frozen=True)
class Model:
    """Tables of what was learnt, in the shared folder: abbreviations (type), starters (next), pairs (type, next), and
    common words (next): words that stand in small letters inside of sentences."""

    abbreviations: DataFrame
    starters: DataFrame
    pairs: DataFrame
    common: DataFrame
    folder: str

    def drop(self) -> None:
        """Delete the tables; nothing that was made with the model may be computed afterwards."""
        discard(self.abbreviations.sparkSession, self.folder)


def pieces(text: Column) -> Column:
    """Words, each with the white space behind it."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+[{SPACE}]*"), F.lit(0))


def _parts(text: Column) -> Column:
    """A text in parts of whole pieces: each ends at the first piece that may end a sentence, the last one with the text."""
    end = r"""[.!?…。！？]["')\]}»”’›]*"""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?s)(?=[^{SPACE}])(?:.*?{end}(?:[{SPACE}]+|\z)|.+)"), F.lit(0))


def _core(piece: Column) -> Column:
    """A word without marks around it; periods at its end stay."""
    return F.regexp_replace(piece, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$", "")


def word_type(piece: Column) -> Column:
    """A word in small letters without periods at its end; one name for all numbers."""
    bare = F.lower(F.regexp_replace(_core(piece), r"\.+$", ""))
    return F.when(bare.rlike(r"^[\p{N}][\p{N}.,:/-]*$"), NUMBER).otherwise(bare)


def _bare(piece: Column) -> Column:
    return F.regexp_replace(piece, f"[{SPACE}]+$", "")


def _kind(piece: Column) -> Column:
    """How a word ends: `.` by one period, `..` by more, `!` by another end mark, else null."""
    word = _bare(piece)
    closed = F.regexp_replace(word, r"""["')\]}»”’›]+$""", "")
    return F.when(~word.rlike(ENDS), None).when(closed.rlike(r"(\.\.|…)$"), "..").when(F.endswith(closed, F.lit(".")), ".").otherwise("!")


def _case(piece: Column) -> Column:
    """`u` or `l` by a word's first letter, else an empty text."""
    first = F.substring(_core(piece), 1, 1)
    return F.when(first.rlike(r"\p{Lu}|\p{Lt}"), "u").when(first.rlike(r"\p{Ll}"), "l").otherwise("")


def _simple(word: Column) -> Column:
    """Whether a word is of plain letters with one mark behind it at most, as nearly all are; few patterns tell what it is."""
    return word.rlike("^[A-Za-z]+[.,;:!?]?$")


def _type_of(word: Column) -> Column:
    return F.when(_simple(word), F.lower(F.regexp_extract(word, "^[A-Za-z]+", 0))).otherwise(word_type(word))


def _case_of(word: Column) -> Column:
    return F.when(_simple(word), F.when(word < "a", "u").otherwise("l")).otherwise(_case(word))


def _kind_of(word: Column) -> Column:
    mark = F.right(word, F.lit(1))
    return F.when(_simple(word), F.when(mark == ".", ".").when(mark.isin("!", "?"), "!")).otherwise(_kind(word))


def words(docs: DataFrame, text: str = "text", found: DataFrame | None = None) -> DataFrame:
    """(type, n_period, n_plain, n_lower, n_upper_inside) of every word with a letter or digit, over all texts. `found` are
    the texts' `ends`, if they were counted before."""
    # equal words are one with counts before any of them is looked at; what isn't first behind a possible end stands inside
    every = docs.select(F.explode(F.split(text, f"[{SPACE}]+")).alias("x")).filter("x <> ''").groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    found = ends(segments(docs, [], text)) if found is None else found
    begin = docs.select(F.regexp_extract(text, f"^[{SPACE}]*([^{SPACE}]+)", 1).alias("x")).filter("x <> ''").groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    some = every.select("x", "n", F.col("n").alias("inside"))
    for first in (found.select(F.col("y").alias("x"), "n"), begin):
        some = some.unionByName(first.select("x", F.lit(0).cast("long").alias("n"), (-F.col("n")).alias("inside")))
    # a comma behind an abbreviation's period doesn't make it another word
    x = F.col("x")
    period = F.when(_simple(x), F.endswith(x, F.lit("."))).otherwise(_core(x).rlike(r"(^|[^.])\.$"))
    rows = some.select(_type_of(x).alias("type"), period.alias("period"), _case_of(x).alias("case"), "inside", "n").filter(F.col("type") != "")
    of = lambda c, n="n": F.sum(F.when(c, F.col(n)).otherwise(0))
    return rows.groupBy("type").agg(
        of(F.col("period")).alias("n_period"),
        of(~F.col("period")).alias("n_plain"),
        of(F.col("case") == "l").alias("n_lower"),
        of(F.col("case") == "u", "inside").alias("n_upper_inside"),
    )


def segments(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """The columns of `key`, pos, segment, and what stands at its end: x, the last word, and y, the one behind it. A segment
    ends where a sentence may, or with the text (y null)."""
    p = docs.select(*key, _parts(F.col(text)).alias("p"))
    both = F.transform("p", lambda s, i: F.struct(s.alias("segment"), F.regexp_extract(F.get("p", i + 1), f"^[^{SPACE}]+", 0).alias("y")))
    e = p.select(*key, F.posexplode(both).alias("pos", "e")).select(*key, "pos", "e.*")
    # from the end, so that a long segment isn't tried word by word
    last = F.regexp_extract("segment", rf"(?s)\A(?:.*[{SPACE}])?([^{SPACE}]+)[{SPACE}]*\z", 1)
    return e.select(*key, "pos", "segment", last.alias("x"), "y")


PAIR_KEYS = ["x", "y"]


def ends(found: DataFrame) -> DataFrame:
    """(x, y, type, kind, next, case, n) of all possible ends in texts; equal words are one before they are looked at."""
    n = found.filter(F.col("y").isNotNull()).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    return n.select("x", "y", _type_of(F.col("x")).alias("type"), _kind_of(F.col("x")).alias("kind"), _type_of(F.col("y")).alias("next"), _case_of(F.col("y")).alias("case"), "n")


def abbreviation_score(n_period: Column, n_plain: Column, periods: Column, total: Column, word: Column) -> Column:
    """How firmly a word stands before a period: twice the logarithm of how much likelier its counts are with a chance of
    0.99 than with the corpus's, times e to the power of minus its letters, times its periods, and less by a power of
    its length for each time without one."""
    p = periods / total
    chance = n_period * F.log(p) + n_plain * F.log(1 - p)
    firm = n_period * F.log(F.lit(0.99)) + n_plain * F.log(F.lit(0.01))
    letters = F.length(F.replace(word, F.lit("."))).cast("double")
    inner = F.length(word) - letters + 1
    return 2 * (firm - chance) * F.exp(-letters) * inner * F.pow(letters, -n_plain.cast("double"))


def likelihood_ratio(a: Column, b: Column, ab: Column, n: Column) -> Column:
    """Dunning's log-likelihood that two events with counts a and b, and ab together, of n, don't occur independently."""

    def log_of(k: Column, m: Column, p: Column) -> Column:
        # k of m with chance p; 0 * log 0 is 0
        return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(m > k, (m - k) * F.log(1 - p)).otherwise(0.0)

    p, p1, p2 = b / n, ab / a, F.when(n > a, (b - ab) / (n - a)).otherwise(0.0)
    return -2 * (log_of(ab, a, p) + log_of(b - ab, n - a, p) - log_of(ab, a, p1) - log_of(b - ab, n - a, p2))


def abbreviations(counted: DataFrame, least: int = 2) -> DataFrame:
    """type, n_period, n_plain of words that are abbreviations; seen `least` times before a period at least."""
    whole = counted.agg(F.sum("n_period").alias("periods"), F.sum(F.col("n_period") + F.col("n_plain")).alias("total")).first()
    if not whole.total or whole.periods in (0, whole.total):  # nothing, or a period everywhere: that says nothing
        return counted.limit(0).select("type", "n_period", "n_plain")
    some = counted.filter((F.col("n_period") >= least) & F.col("type").rlike(r"^[\p{L}][\p{L}.'-]*$") & (F.length("type") > 1))
    score = abbreviation_score(F.col("n_period"), F.col("n_plain"), F.lit(float(whole.periods)), F.lit(float(whole.total)), F.col("type"))
    return some.filter(score >= ABBREVIATION).select("type", "n_period", "n_plain")


def _special(kind: Column) -> Column:
    """Whether a period may belong to the word: an abbreviation, a letter, or a number."""
    return (kind == ".") & (F.col("abbreviation") | F.col("type").rlike(r"^\p{L}$") | (F.col("type") == NUMBER))


def _known(found: DataFrame, abbreviations_: DataFrame) -> DataFrame:
    marked = abbreviations_.select("type", F.lit(True).alias("abbreviation"))
    return found.join(marked, "type", "left").withColumn("abbreviation", F.coalesce("abbreviation", F.lit(False)))


def learn(docs: DataFrame, text: str = "text", least: int = 2) -> Model:
    """Count a corpus's words and possible ends, and keep what they say."""
    model = _learn(docs, text, least)[0]
    discard(docs.sparkSession, f"{model.folder}/found")
    return model


def _learn(docs: DataFrame, text: str, least: int = 2) -> tuple[Model, DataFrame]:
    """The model, and the texts' `ends` below its folder. Texts are read twice: cut into words, and at possible ends."""
    spark = docs.sparkSession
    folder = scratch(spark, "sentences")

    def store(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    found = store(ends(segments(docs, [], text)), "found")
    counted = store(words(docs, text, found), "words")
    short = store(abbreviations(counted, least), "abbreviations")
    at_ends = store(_known(found, short), "ends")
    sure = at_ends.filter(~_special(F.col("kind")) & (F.col("next") != ""))
    # Words after sure ends. A word that isn't counted by itself can't be judged, so that joins may be inner.
    n = counted.select(F.col("type").alias("next"), (F.col("n_period") + F.col("n_plain")).cast("double").alias("of_next"))
    after = sure.groupBy("next").agg(F.sum("n").cast("double").alias("both"))
    breaks, total = (F.lit(float(x or 0)) for x in (sure.agg(F.sum("n")).first()[0], counted.agg(F.sum(F.col("n_period") + F.col("n_plain"))).first()[0]))
    firm = likelihood_ratio(breaks, F.col("of_next"), F.col("both"), total) >= STARTER
    starters = store(after.join(n, "next").filter(firm & (F.col("both") * total > breaks * F.col("of_next"))).select("next"), "starters")
    # Words behind what may hold its period: pairs that belong together.
    held = at_ends.filter(_special(F.col("kind")) & (F.col("next") != "")).groupBy("type", "next").agg(F.sum("n").cast("double").alias("both"))
    of_type = counted.select("type", F.col("n_period").cast("double").alias("of_type"))
    pair = held.join(of_type, "type").join(n, "next")
    # a word may follow a type more often than the counts of their own say, as commas don't part them
    tied = likelihood_ratio(F.greatest("of_type", "both"), F.greatest("of_next", "both"), F.col("both"), total) >= PAIR
    tied = tied & (F.col("both") > 1) & (F.col("both") * total > F.col("of_type") * F.col("of_next"))
    pairs = store(pair.filter(tied).join(starters, "next", "left_anti").select("type", "next"), "pairs")
    common = store(counted.filter((F.col("n_lower") > 0) & (F.col("n_lower") >= 9 * F.col("n_upper_inside"))).select(F.col("type").alias("next")), "common")
    discard(spark, f"{folder}/words", f"{folder}/ends")
    return Model(short, starters, pairs, common, folder), found


def inside(found: DataFrame, model: Model) -> DataFrame:
    """The pairs x, y of `ends` at which no sentence ends."""

    def flag(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        return df.select(*keys, F.lit(True).alias(name))

    k = _known(found, model.abbreviations)
    k = k.join(flag(model.starters, ["next"], "starter"), "next", "left").join(flag(model.common, ["next"], "common"), "next", "left").join(flag(model.pairs, ["type", "next"], "pair"), ["type", "next"], "left")
    starter, common, pair = (F.coalesce(F.col(c), F.lit(False)) for c in ("starter", "common", "pair"))
    upper = F.col("case") == "u"
    # After an abbreviation or a letter a sentence ends only if a word follows in capitals that isn't written so elsewhere.
    short = F.when(pair | ~upper, True).otherwise(~(common | (starter & F.col("abbreviation"))))
    number = F.when(pair, True).otherwise(F.col("case") == "l")
    stays = F.when(F.col("kind") == "..", F.col("case") == "l").when(~_special(F.col("kind")), False).when(F.col("type") == NUMBER, number).otherwise(short)
    return k.filter(stays).select(*PAIR_KEYS)


def sentences(docs: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, chunk: sentences, trimmed, each once in a text, in order of first occurrence. Without a model, one is
    learnt from the texts themselves."""
    spark = docs.sparkSession
    found = segments(docs.select(key, text, F.monotonically_increasing_id().alias("row")), [key, "row"], text)
    if model is None:
        model, counted = _learn(docs, text)
        inside(counted, model).write.parquet(f"{model.folder}/inside")
        none = spark.read.parquet(f"{model.folder}/inside")
        discard(spark, f"{model.folder}/found")
    else:
        none = inside(ends(found), model)
    none = none.withColumn("stays", F.lit(True))
    parts = found.join(none, PAIR_KEYS, "left")
    piece = F.struct("pos", "segment", F.coalesce("stays", F.lit(False)).alias("stays"))
    gathered = parts.groupBy(key, "row").agg(F.sort_array(F.collect_list(piece)).alias("s"))
    # ends of sentences by their place, then each sentence from the parts up to its end
    last = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == F.size("s") - 1) | ~F.get("s", i)["stays"])
    gathered = gathered.withColumn("last", last)

    def whole(end: Column, k: Column) -> Column:
        start = F.when(k == 0, F.lit(0)).otherwise(F.get("last", k - 1) + 1)
        return F.regexp_replace(F.array_join(F.transform(F.slice("s", start + 1, end - start + 1), lambda x: x["segment"]), ""), f"[{SPACE}]+$", "")

    return gathered.select(key, F.posexplode(F.array_distinct(F.transform("last", whole))).alias("pos", "chunk"))
