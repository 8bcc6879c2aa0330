"""Content keys and output names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def translation_key(text: Column, source: Column, target: Column, provider: str, model: str, temperature: float, prefix: str = "") -> Column:
    return F.md5(F.concat_ws("|", text, source, target, F.lit(provider), F.lit(model), F.lit(str(temperature)), F.lit(prefix)))


def parameter_key(parameters: dict[str, Column]) -> Column:
    """sha256 over name=value pairs in name order; a null value is written as empty."""
    pairs = [F.concat(F.lit(k + "="), F.coalesce(parameters[k].cast("string"), F.lit(""))) for k in sorted(parameters)]
    return F.sha2(F.concat_ws(";", *pairs), 256)


def file_key(name: Column, size: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("_", name, size.cast("string"))), 1, 8)


def speech_key(text: Column, voice: Column, style: Column) -> Column:
    return F.concat_ws("_", F.md5(text), F.coalesce(voice, F.lit("default")), F.substring(F.md5(F.coalesce(style, F.lit(""))), 1, 8))


def subtitle_name(path: Column, lang: Column, other: Column, role: str) -> Column:
    """{stem}_{lang}.srt; if both languages are equal the role ('source' or 'target') tells them apart."""
    stem = F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)
    return F.concat(stem, F.lit("_"), F.when(lang == other, F.concat(F.lit(role + "_"), lang)).otherwise(lang), F.lit(".srt"))


def output_name(path: Column, lang: Column) -> Column:
    stem, ext = F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1), F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 2)
    return F.concat(stem, F.lit("_"), lang, ext)
