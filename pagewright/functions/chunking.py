"""Chunkers: text column to array of chunks. All but topic segmentation are column expressions; `chunk` takes topic segments
from `topics`, which spreads long texts over tasks, and `tile` is the same idea for one text at a time."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import sentences
from . import text as T
from . import topics

# English stop words of the common list.
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself it it's its itself they them their theirs themselves "
    "what which who whom this that that'll these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against "
    "between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor "
    "not only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't "
    "ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def regex_chunks(c: Column, patterns: list[str] | None = None) -> Column:
    """Split by each pattern in turn; empty pieces stay."""
    out = F.array(c)
    for p in patterns or [r"\n\n"]:
        out = F.flatten(F.transform(out, _splitter(p)))
    return out


def _splitter(pattern: str) -> Callable[[Column], Column]:
    return lambda x: F.split(x, pattern, -1)


def sentence_chunks(c: Column) -> Column:
    """Sentences by their end marks, trimmed, each once, in order of first occurrence."""
    return F.filter(F.array_distinct(F.transform(F.split(c, r"(?U)(?<=[.!?])\s+", -1), T.strip)), lambda s: s != "")


def _runs(c: Column, size: int, step: int) -> Column:
    def cut(w: Column) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(step)), lambda i: F.array_join(F.slice(w, i + 1, size), " "))
        return F.when(F.size(w) > 0, made).otherwise(F.array().cast("array<string>"))

    # the one-element array binds the words to a variable, so that a text is split once and not for every chunk
    return F.transform(F.array(T.words(c)), cut)[0]


def fixed_chunks(c: Column, size: int = 100) -> Column:
    """Runs of `size` words; the last may be shorter."""
    return _runs(c, size, size)


def sliding_chunks(c: Column, size: int = 100, step: int = 50) -> Column:
    """Windows of `size` words that begin at every multiple of `step`."""
    return _runs(c, size, step)


def tile(text: str | None, width: int = 20, block: int = 10) -> list[str]:
    """TextTiling (Hearst 1997): pseudo-sentences of `width` words, lexical similarity of `block` of them on either side
    of each gap, depth scores, and boundaries at depths over mean less half a deviation, moved to the nearest paragraph."""
    text = text or ""
    spots = [(m.start(), m.group().lower()) for m in re.finditer(r"\w+", text)]
    stop = set(STOP_WORDS)
    parts = [spots[i : i + width] for i in range(0, len(spots), width)]
    if len(parts) < 3:
        return [text] if text.strip() else []
    counts = []
    for p in parts:
        d: dict[str, int] = {}
        for _, w in p:
            if w not in stop:
                d[w] = d.get(w, 0) + 1
        counts.append(d)

    def score(g: int) -> float:
        k = min(block, g, len(parts) - g)
        a: dict[str, int] = {}
        b: dict[str, int] = {}
        for side, some in ((a, counts[g - k : g]), (b, counts[g : g + k])):
            for d in some:
                for w, n in d.items():
                    side[w] = side.get(w, 0) + n
        norm = (sum(x * x for x in a.values()) * sum(x * x for x in b.values())) ** 0.5
        return sum(n * b.get(w, 0) for w, n in a.items()) / norm if norm else 0.0

    s = np.array([score(g) for g in range(1, len(parts))])
    s = np.convolve(np.pad(s, 1, mode="edge"), np.ones(3) / 3, mode="valid")  # one round of smoothing
    depth = np.zeros(len(s))
    for i in range(len(s)):
        left = right = i
        while left > 0 and s[left - 1] >= s[left]:
            left -= 1
        while right < len(s) - 1 and s[right + 1] >= s[right]:
            right += 1
        depth[i] = s[left] + s[right] - 2 * s[i]
    cut = depth.mean() - depth.std() / 2
    breaks = [m.end() for m in re.finditer(r"\n\s*\n|\n", text)]
    at, last = [], -5
    for i in sorted(np.flatnonzero(depth > max(cut, 0.0)).tolist(), key=lambda i: -depth[i]):
        if all(abs(i - j) >= 4 for j in at):
            at.append(i)
    ends = []
    for i in sorted(at):
        here = parts[i + 1][0][0]
        near = min(breaks, key=lambda x: abs(x - here)) if breaks else here
        if 0 < near < len(text) and near not in ends:
            ends.append(near)
    out = [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)])]
    return [x for x in out if x.strip()]


def topic_chunks(c: Column, width: int = 20, block: int = 10) -> Column:
    """Topic segments of each text, by a pandas UDF: the smoothing and the depth scores need the whole text at once."""

    def segment(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: tile(t, width, block))

    return F.pandas_udf(segment, "array<string>")(c)


def top_keywords(segments: DataFrame, keys: list[str], text: str = "text", k: int = 3) -> DataFrame:
    """keys, keyword, n, rank: the k most frequent words of each segment. Stop words count as such only as written
    in small letters; equally frequent words stand in the order of their first occurrence."""
    token = segments.select(*keys, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0))).alias("token_pos", "token"))
    stop = segments.sparkSession.createDataFrame([(w,) for w in STOP_WORDS], "token string")
    kept = token.join(F.broadcast(stop), "token", "left_anti").filter(~F.lit(PUNCTUATION).contains(F.col("token")))
    counted = kept.groupBy(*keys, F.lower("token").alias("keyword")).agg(F.count(F.lit(1)).alias("n"), F.min("token_pos").alias("first"))
    ranked = counted.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "first")))
    return ranked.filter(F.col("rank") <= k).select(*keys, "keyword", "n", "rank")


CHUNKERS: dict[str, Callable[..., Column]] = {"regex": regex_chunks, "sentence": sentence_chunks, "fixed": fixed_chunks, "sliding": sliding_chunks, "topic": topic_chunks}


#: Chunkers that work on whole tables: functions of a table, `key`, `text` and options, that give key, pos, chunk.
TABLE_CHUNKERS: dict[str, Callable[..., DataFrame]] = {"learned_sentence": sentences.sentences, "topic": topics.segments}


def chunk(docs: DataFrame, strategy: str, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """key, pos, chunk by a chunker's name. Register another with `CHUNKERS[name] = function`, or in `TABLE_CHUNKERS`."""
    if strategy in TABLE_CHUNKERS:
        return TABLE_CHUNKERS[strategy](docs, key=key, text=text, **options)
    if strategy not in CHUNKERS:
        raise ValueError(f"no chunker is called {strategy!r}; there are {sorted([*CHUNKERS, *TABLE_CHUNKERS])}")
    return docs.select(key, F.posexplode(CHUNKERS[strategy](F.col(text), **options)).alias("pos", "chunk"))
