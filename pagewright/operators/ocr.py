"""What recognition needs around its model: languages, and results as spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Languages and their codes.
LANGUAGES = {
    "Afrikaans": "af", "Arabic": "ar", "Bengali": "bn", "Bulgarian": "bg", "Catalan": "ca", "Chinese": "zh", "Croatian": "hr", "Czech": "cs", "Danish": "da", "Dutch": "nl", "English": "en", "Estonian": "et", "Finnish": "fi",
    "French": "fr", "German": "de", "Greek": "el", "Hebrew": "he", "Hindi": "hi", "Hungarian": "hu", "Indonesian": "id", "Italian": "it", "Japanese": "ja", "Korean": "ko", "Latvian": "lv", "Lithuanian": "lt", "Norwegian": "no",
    "Persian": "fa", "Polish": "pl", "Portuguese": "pt", "Romanian": "ro", "Russian": "ru", "Serbian": "sr", "Slovak": "sk", "Slovenian": "sl", "Spanish": "es", "Swedish": "sv", "Tamil": "ta", "Thai": "th", "Turkish": "tr",
    "Ukrainian": "uk", "Urdu": "ur", "Vietnamese": "vi",
}


def language_codes(rows: DataFrame, name: str = "lang", strict: bool = True) -> DataFrame:
    """Rows with the code of their language, given by name in any case or by code. An unknown one raises if `strict`,
    and else has a null code; null stays null."""
    known = rows.sparkSession.createDataFrame([*((k.lower(), v) for k, v in LANGUAGES.items()), *((v, v) for v in LANGUAGES.values())], "known string, code string")
    out = rows.join(F.broadcast(known), F.lower(F.col(name)) == F.col("known"), "left").drop("known")
    if not strict:
        return out
    wrong = F.col(name).isNotNull() & F.col("code").isNull()
    return out.withColumn("code", F.when(wrong, F.raise_error(F.concat(F.lit("no language code: "), F.col(name))).cast("string")).otherwise(F.col("code")))


def result_spans(lines: DataFrame) -> DataFrame:
    """Recognised lines (doc_id, pnum, line_idx, text, box) as spans: a block, a line and a span each."""
    number = F.col("line_idx")
    return lines.select("doc_id", "pnum", number.alias("block_no"), F.lit(0).alias("line_no"), F.lit(0).alias("span_no"), F.concat_ws("_", F.col("pnum").cast("string"), number.cast("string")).alias("span_id"), "text", F.lit("").alias("font"), F.lit(0.0).alias("font_size"), F.lit(0.0).alias("font_weight"), "x0", "y0", "x1", "y1")
