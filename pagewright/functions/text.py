"""Text functions as column expressions. All run inside the JVM; null gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of PDF font flags and the names that they get.
FONT_FLAGS = [(0, "fixed_pitch"), (1, "serif"), (2, "symbolic"), (3, "script"), (5, "non_symbolic"), (6, "italic"), (16, "all_cap"), (17, "small_cap"), (18, "bold"), (19, "use_extern_attr")]
# Block types whose lines run on like prose.
PROSE_TYPES = ("Text", "List-item", "Footnote", "Caption", "Figure")
HEADING_TYPES = ("Title", "Section-header")


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode white space included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+\z", "")


def words(c: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def cleanup_text(c: Column) -> Column:
    """At most one blank line in a row, and plain spaces."""
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"(?U)(\n\s){3,}", "\n\n")
    return F.regexp_replace(c, " ", " ")


def replace_bullets(c: Column) -> Column:
    """Bullet marks at the begin of a word become dashes."""
    return F.regexp_replace(c, r"(^|[\n ])[•●○■▪▫–—]( )", r"$1-$2")


def escape_markdown(c: Column) -> Column:
    return F.regexp_replace(c, "#", r"\\#")


def surround_text(c: Column, mark: str) -> Column:
    """Marks around the text, inside its outer white space."""
    return F.concat(F.regexp_extract(c, r"(?U)^(\s*)", 1), F.lit(mark), strip(c), F.lit(mark), F.regexp_extract(c, r"(?U)(\s*)\z", 1))


def replace_dots(c: Column) -> Column:
    """Four or more dots in a row, with or without space between, become one space."""
    return F.regexp_replace(c, r"(?U)\s*(?:\.\s*){4,}", " ")


def replace_newlines(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"[\r\n]+", " "))


def title_case(c: Column) -> Column:
    """Every run of cased letters begins with a capital; the rest of it is small."""
    runs = F.regexp_extract_all(c, F.lit(r"(?s)[\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+"), F.lit(0))

    def one(w: Column) -> Column:
        first = F.upper(F.substring(w, 1, 1))  # may be longer than a letter
        return F.concat(F.substring(first, 1, 1), F.lower(first.substr(F.lit(2), F.length(first))), F.lower(w.substr(F.lit(2), F.length(w))))

    return F.array_join(F.transform(runs, one), "")


def block_surround(text: Column, block_type: Column) -> Column:
    """The markup of a finished block."""
    head = title_case(strip(text))
    hashed = text.startswith("#")
    bare = strip(text)
    return (
        F.when(block_type == "Section-header", F.when(hashed, text).otherwise(F.concat(F.lit("\n## "), head, F.lit("\n"))))
        .when(block_type == "Title", F.when(hashed, text).otherwise(F.concat(F.lit("# "), head, F.lit("\n"))))
        .when(block_type == "Table", F.concat(F.lit("\n"), text, F.lit("\n")))
        .when(block_type.isin("List-item", "Text"), escape_markdown(text))
        .when(block_type == "Code", F.concat(F.lit("\n```\n"), text, F.lit("\n```\n")))
        .when((block_type == "Formula") & bare.startswith("$$") & bare.endswith("$$"), F.concat(F.lit("\n"), bare, F.lit("\n")))
        .otherwise(text)
    )


def join_lines(a: Column, b: Column, block_type: Column, continues: Column) -> Column:
    """Two lines of a block as one text: hyphens undone, sentences kept apart.

    The letter classes hold a literal bar, as the tool that this follows has them."""
    prose = block_type.isin(*PROSE_TYPES)
    spaced = F.concat(rstrip(a), F.lit(" "), lstrip(b))
    hyphen = (a != "") & a.rlike(r"(?sU)[\p{Lo}|\p{Ll}|\d][-—¬]\s?\z") & b.rlike(r"(?U)^\s?[\p{Lo}|\p{Ll}|\d]")
    runs_on = a.rlike(r"""(?sU)[\p{Lo}|\p{Ll}|\d][,;(—"'*]?\s?\z""") & b.rlike(r"(?U)^\s?[\p{L}|\d]") & prose
    return (
        F.when(hyphen, F.concat(rstrip(F.regexp_replace(a, r"(?U)[-—¬]\s?\z", "")), lstrip(b)))
        .when(block_type.isin(*HEADING_TYPES), spaced)
        .when(block_type == "Formula", F.concat(a, F.lit("\n"), b))
        .when(runs_on | continues, spaced)
        .when(prose & a.rlike(r"(?sU)[。ๆ.?!]\s?\z"), F.concat(a, F.lit("\n\n"), b))
        .when(block_type == "Table", F.concat(a, F.lit("\n\n"), b))
        .otherwise(F.concat(a, F.lit("\n"), b))
    )


def alphanum_ratio(c: Column) -> Column:
    """Share of letters and numbers among what isn't a space or line end; 1 without any."""
    bare = F.regexp_replace(c, "[ \n]", "")
    return F.when(F.length(bare) == 0, F.lit(1.0)).otherwise(F.length(F.regexp_replace(bare, r"[^\p{L}\p{N}]", "")) / F.length(bare))


def bad_ocr(c: Column, spaces: float = 0.7, newlines: float = 0.6, alphanum: float = 0.3) -> Column:
    """Whether a text looks like failed recognition: empty, mostly gaps, garbled, or full of replacement characters."""
    n_space, rest = F.regexp_count(c, F.lit(r"(?U)\s+")), F.length(F.regexp_replace(c, r"(?U)\s+", ""))
    n_line, other = F.regexp_count(c, F.lit("\n+")), F.length(F.regexp_replace(c, "\n+", ""))
    invalid = F.length(c) - F.length(F.regexp_replace(c, "�", ""))
    return (
        F.when(F.length(c) == 0, True)
        .when(n_space / (rest + n_space) > spaces, True)
        .when(n_line / (n_line + other) > newlines, True)
        .when(alphanum_ratio(c) < alphanum, True)
        .otherwise(invalid > F.greatest(F.lit(6.0), F.length(c) * 0.03))
    )


def font_flags(flags: Column) -> Column:
    """Names of the set bits, joined by underscores; empty for null."""
    names = [F.when(flags.bitwiseAND(1 << bit) > 0, F.lit(name)) for bit, name in FONT_FLAGS]
    return F.concat_ws("_", *names)


def span_text(c: Column) -> Column:
    """Extracted text without line ends after it and without hyphenated line breaks."""
    return F.replace(F.regexp_replace(c, r"[\n\r]+\z", ""), F.lit("-\n"), F.lit(""))


def normalize_uri(c: Column) -> Column:
    """A file name that is safe and short, and tells equal names of different places apart."""
    base = F.element_at(F.split(c, "/", -1), -1)
    base = F.replace(F.replace(base, F.lit(" "), F.lit("_")), F.lit("%20"), F.lit("_"))
    return F.concat(F.substring(F.regexp_replace(base, r"[^a-zA-Z0-9_.-]", ""), 1, 50), F.lit("_"), F.substring(F.md5(c.cast("binary")), 1, 8))


def base64_text(c: Column) -> Column:
    """Base64 in one line (Spark's own breaks lines)."""
    return F.regexp_replace(F.base64(c), "[\r\n]", "")


def csv_dump(rows: Column) -> Column:
    """array<array<string>> as lines of commas, unquoted."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, ",", "")), "\n")


def _padded(cell: Column, width: Column) -> Column:
    return F.rpad(cell, F.greatest(width, F.length(cell)), " ")


def github_table(rows: Column) -> Column:
    """array<array<string>>, the first row a header, as a padded pipe table. A column is two wider than its head."""
    n = F.size(rows[0])
    widths = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.greatest(F.length(rows[0][j]) + 2, F.array_max(F.transform(rows, lambda r: F.length(r[j])))))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.zip_with(r, widths, _padded), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(widths, lambda w: F.repeat(F.lit("-"), w + 2)), "|"), F.lit("|"))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)
    return F.array_join(F.concat(F.array(line(rows[0]), rule), body), "\n")


def markdown_table(rows: Column) -> Column:
    """array<array<string>>, the first row a header, as a pipe table without padding; short rows get empty cells."""
    n = F.array_max(F.transform(rows, F.size))
    full = lambda r: F.concat(r, F.array_repeat(F.lit(""), n - F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(full(r), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), n), " | "), F.lit(" |"))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)
    return F.array_join(F.concat(F.array(line(rows[0]), rule), body), "\n")


def csv_row_text(columns: list[tuple[str, Column]]) -> Column:
    """A CSV row as one text: "name: value" joined by semicolons; null reads nan."""
    return F.concat_ws(";", *[F.concat(F.lit(f"{n.strip()}: "), strip(F.coalesce(c.cast("string"), F.lit("nan")))) for n, c in columns])


def sheet_row_text(columns: list[tuple[str, Column]]) -> Column:
    """A sheet's row as one text: quoted names and values of what isn't null."""
    return F.concat_ws(";", *[F.when(c.isNotNull(), F.concat(F.lit(f'"{n}":"'), c.cast("string"), F.lit('"'))) for n, c in columns])


#: What bytes 0x80 to 0x9F are in code page 1252, which leaves five of them as they are, and those bytes.
_BYTES = [(bytes([b]).decode("cp1252"), chr(b)) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]


def fix_encoding(c: Column, rounds: int = 2) -> Column:
    """UTF-8 that was read as Latin-1 or as code page 1252, line by line, up to so many times over.

    A line is mended only if all of its letters are bytes of such a code page and the bytes are valid UTF-8 with letters
    beyond ASCII: one letter that was right to begin with leaves the line as it is. Null stays null."""

    def mend(line: Column) -> Column:
        as_bytes = F.translate(line, "".join(a for a, _ in _BYTES), "".join(b for _, b in _BYTES))

        def of(x: Column) -> Column:
            latin = x.rlike(r"^[\x00-\xff]*$") & x.rlike(r"[\xc2-\xf4][\x80-\xbf]")
            back = F.when(latin, F.encode(x, "ISO-8859-1")).otherwise(F.lit(None).cast("binary")).cast("string")
            return F.when(F.is_valid_utf8(back), back).otherwise(line)

        return F.transform(F.array(as_bytes), of)[0]

    def times(line: Column) -> Column:
        for _ in range(rounds):
            line = F.transform(F.array(line), mend)[0]
        return line

    return F.when(c.rlike(r"[\xc2-\xf4]"), F.array_join(F.transform(F.split(c, "\n", -1), times), "\n")).otherwise(c)


#: Code pages that UTF-8 is often read by, the likeliest first.
CODE_PAGES = ("cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "koi8_r")


def code_page(name: str) -> tuple[str, str]:
    """Letters of the upper half of a code page, and the bytes that they are (as Latin-1). Bytes that the page lacks stand
    for themselves."""
    letters = {b: bytes([b]).decode(name, "replace") for b in range(0x80, 0x100)}
    return "".join(chr(b) if x == "\ufffd" else x for b, x in letters.items()), "".join(map(chr, letters))


def fix_mixed_encoding(c: Column, pages: tuple[str, ...] = CODE_PAGES, rounds: int = 2) -> Column:
    """UTF-8 that was read by a wrong code page in parts of a text only, word by word, up to so many times over.

    A word (what stands between ASCII white space) is mended by a page if all of its letters beyond ASCII come in groups
    that are valid UTF-8 in that page; one right letter leaves the word as it is, and other words are no matter. A word of letters alone may well be right in the
    rarer pages, so that these need a letter beyond ASCII that is a sign. If several
    pages fit, the result with the fewest odd characters is taken (others than letters, marks, digits, punctuation and
    money), then the likelier page. Null stays null."""
    known = [(*code_page(p), p in ("cp1252", "latin_1")) for p in pages]
    if not known:
        return c

    def mend(word: Column) -> Column:
        def option(k: int, letters: str, as_bytes: str) -> Column:
            # Latin-1 letters that the page lacks would stand for bytes
            lacks = "".join(x for x in map(chr, range(0x80, 0x100)) if x not in letters)
            read = F.translate(word, letters + lacks, as_bytes + "\ufffd" * len(lacks))
            odd = lambda b: F.length(F.regexp_replace(b, r"[\p{L}\p{M}\p{N}\p{P}\p{Sc}\x20-\x7e]", ""))
            # one-element arrays bind what is made to a variable, so that it is made once
            back = F.transform(F.array(read), lambda r: F.when(r.rlike(r"^[\x00-\xff]*\z"), F.encode(r, "ISO-8859-1")).cast("string"))
            return F.transform(back, lambda b: F.when(F.is_valid_utf8(b), F.struct(odd(b).alias("odd"), F.lit(k).alias("page"), b.alias("text"))))[0]

        every = F.array(*[option(k, *page[:2]) for k, page in enumerate(known)])
        western = [option(k, *page[:2]) for k, page in enumerate(known) if page[2]]
        strange = word.rlike(r"[^\x00-\x7f\p{L}\p{M}\p{Nd}]")
        best = F.when(strange, F.array_min(every)["text"])
        return F.coalesce(best.otherwise(F.array_min(F.array(*western))["text"]) if western else best, word)

    def whole(word: Column) -> Column:
        out = mend(word)
        for _ in range(rounds - 1):
            out = F.transform(F.array(out), lambda x: F.when(x.rlike(r"[^\x00-\x7f]{2}"), mend(x)).otherwise(x))[0]
        return out

    if rounds < 1:
        return c
    # only words with two letters beyond ASCII beside each other are taken out; most texts have few
    space = r" \t\r\n\x0B\f"
    word = rf"(?<![^{space}])[^{space}]*?[^\x00-\x7f]{{2}}[^{space}]*"
    between = F.split(c, word, -1)
    # each mended word with what stands behind it
    return F.when(c.rlike(r"[^\x00-\x7f]{2}"), F.transform(F.array(F.struct(between.alias("between"), F.regexp_extract_all(c, F.lit(word), F.lit(0)).alias("words"))), lambda s: F.concat(s["between"][0], F.array_join(F.transform(s["words"], lambda x, i: F.concat(whole(x), F.get(s["between"], i + 1))), "")))[0]).otherwise(c)


def encoding_fixed(texts: DataFrame) -> DataFrame:
    """The stage `fix_encoding`: the column text, mended by lines and then by words."""
    return texts.withColumn("text", fix_mixed_encoding(fix_encoding(F.col("text"))))


def fix_text(c: Column) -> Column:
    """The part of mojibake repair that needs no model of encodings: straight quotes, ligatures, line ends, controls."""
    c = F.translate(c, "‘’‚‛“”„‟", "''''\"\"\"\"")
    for a, b in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.regexp_replace(c, "\r\n?| | |\u0085", "\n")
    return F.regexp_replace(c, "[\u0000-\u0008\u000b\u000e-\u001f\u007f﻿]", "")


def apply_edits(text: Column, labels: Column) -> Column:
    """A text after edits, a label to each character: delete drops white space only; newline-1 and space-1 put a line end
    or a space before the character; anything else keeps it."""
    chars = F.filter(F.split(text, ""), lambda x: x != "")
    one = lambda ch, label: (
        F.when((label == "delete") & ch.rlike(r"(?U)^\s$"), F.lit("")).when(label == "newline-1", F.concat(F.lit("\n"), ch)).when(label == "space-1", F.concat(F.lit(" "), ch)).otherwise(ch)
    )
    return F.array_join(F.zip_with(chars, labels, one), "")


def byte_tokens(text: Column, length: int = 1024) -> Column:
    """struct(n_tokens, n_rows, n_pad) of a byte tokenizer with rows of `length`."""
    n = F.octet_length(text)
    rows = F.ceil(n / F.lit(length)).cast("int")
    return F.struct(n.alias("n_tokens"), rows.alias("n_rows"), (rows * length - n).alias("n_pad"))


def byte_token_rows(text: Column, length: int = 1024) -> Column:
    """array<array<int>>: bytes plus 3, in rows of `length`, the last one padded with 0. Empty text: no rows."""
    n = F.octet_length(text)
    rows = F.ceil(n / F.lit(length)).cast("int")
    ids = F.transform(F.regexp_extract_all(F.hex(text.cast("binary")), F.lit(".."), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("int") + 3)
    full = F.concat(ids, F.array_repeat(F.lit(0), rows * length - n))

    def cut(ids: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), rows - 1), lambda i: F.slice(ids, i * length + 1, length))

    # bound to a variable, so that the bytes are listed once and not for every row
    return F.when(n > 0, F.transform(F.array(full), cut)[0]).otherwise(F.array().cast("array<array<int>>"))


def zone_time(ts: Column, zone: str = "Asia/Shanghai") -> Column:
    """A time in a zone, as text."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd HH:mm:ss")
