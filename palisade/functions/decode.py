"""Decoders as columns: base64, hex, percent, JavaScript escapes, layered encodings."""

from __future__ import annotations

import base64
import binascii
import gzip
import zlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from palisade.functions.text import find_all, is_meaningful, java_regex, strip
from palisade.storage import run_folder

# Escape patterns in scripts.
HEX_ESCAPES = r"(?:\\x[0-9a-fA-F]{2})+"
UNICODE_ESCAPES = r"(?:\\u[0-9a-fA-F]{4})+"
EVAL_BASE64 = r"eval\s*\(\s*(?:atob|Buffer\.from)\s*\(\s*[\"']([A-Za-z0-9+/=]{20,})[\"']"
FROM_CHAR_CODE = r"String\.fromCharCode\s*\(([^)]+)\)"
SCRIPT_URL = r"https?://[^\s\"'<>)]+"
MAX_LAYERS = 3


def utf8_text(raw: Column) -> Column:
    """Bytes as text; broken sequences become replacement characters."""
    return F.make_valid_utf8(raw.cast("string"))


def padded_base64(text: Column) -> Column:
    """Well-formed base64 for a string over the alphabet and "=", or null where decoding must fail.

    A "=" early in a group of four is skipped; one that completes the group ends the data, the rest is ignored.
    The text is walked by its "=" signs, of which there are few.
    """
    pieces = F.split(text, "=", -1)
    last = F.size(pieces) - 1
    start = F.struct(
        F.lit("").alias("out"), F.lit(0).alias("filled"), F.lit(0).alias("pads"), F.lit(False).alias("done")
    )

    def step(state: Column, piece: Column) -> Column:
        filled = (state["filled"] + F.length(piece["data"])) % 4
        pads = F.when(F.length(piece["data"]) > 0, 0).otherwise(state["pads"]) + F.when(
            piece["sign"] & (filled >= 2), 1
        ).otherwise(0)
        moved = F.struct(
            F.concat(state["out"], piece["data"]).alias("out"),
            filled.alias("filled"),
            pads.alias("pads"),
            (piece["sign"] & (filled >= 2) & (filled + pads >= 4)).alias("done"),
        )
        return F.when(state["done"], state).otherwise(moved)

    def finish(state: Column) -> Column:
        return F.when(state["done"], F.concat(state["out"], F.repeat(F.lit("="), 4 - state["filled"]))).when(
            state["filled"] == 0, state["out"]
        )

    walked = F.aggregate(
        F.transform(pieces, lambda p, i: F.struct(p.alias("data"), (i < last).alias("sign"))), start, step, finish
    )
    regular = (F.length(text) % 4 == 0) & text.rlike(r"^[A-Za-z0-9+/]*={0,2}\z")
    return F.when(regular, text).otherwise(walked)


def strict_base64_text(text: Column) -> Column:
    # The try form: the optimizer may evaluate this ahead of the tests that guard it.
    return utf8_text(F.try_to_binary(padded_base64(text), F.lit("base64")))


def hex_text(text: Column) -> Column:
    digits = F.rtrim(text, F.lit("\n"))
    return F.when(F.length(digits) % 2 == 0, utf8_text(F.unhex(digits)))


def percent_decoded(text: Column) -> Column:
    """%XX sequences decoded as UTF-8, everything else (also "+") kept."""
    tokens = F.regexp_extract_all(text, F.lit(r"(?s)(?:%[0-9a-fA-F]{2})+|[^%]+|%"), F.lit(0))
    return F.array_join(
        F.transform(
            tokens,
            lambda t: F.when(
                t.rlike("^%[0-9a-fA-F]{2}"), utf8_text(F.unhex(F.replace(t, F.lit("%"), F.lit(""))))
            ).otherwise(t),
        ),
        "",
    )


@F.pandas_udf(T.StringType())
def _gunzip_base64(texts: pd.Series) -> pd.Series:
    def one(text):
        try:
            return gzip.decompress(base64.b64decode(text)).decode("utf-8", errors="replace")
        except (ValueError, binascii.Error, OSError, EOFError, zlib.error):
            return None

    return texts.map(one)


# Not moved or repeated by the optimizer: a filter on the result must not run the function twice.
_gunzip_base64 = _gunzip_base64.asNondeterministic()


def _looks_encoded(data: Column) -> Column:
    """Whether any decoder could take the text."""
    return data.rlike("(?d)^[A-Za-z0-9+/=]+$") | F.contains(data, F.lit("%")) | _looks_zipped(data)


def _looks_zipped(data: Column) -> Column:
    """Base64 of a gzip head, whatever stands between its letters."""
    return data.rlike("^[^A-Za-z0-9+/]*H[^A-Za-z0-9+/]*4[^A-Za-z0-9+/]*s[^A-Za-z0-9+/]*I")


#: What a row of the worklist waits for: nothing, a layer's decoders, those with gzip.
_DONE, _CODED, _ZIPPED = 0, 1, 2


def _state(data: Column) -> Column:
    coded = F.when(_looks_zipped(data), _ZIPPED).otherwise(_CODED)
    return F.when(F.coalesce(_looks_encoded(data), F.lit(False)), coded).otherwise(_DONE)


def _peeled(rows: DataFrame, state: int, zipped: Column) -> DataFrame:
    """rows with _text: what the first decoder that accepts ``_data`` makes of it, with what is left for the next layer and its
    state there. Only rows of the state change; _now is the state that a row had."""
    data, now = F.col("_data"), F.col("_now")
    candidates = F.array(
        _candidate("plain", F.when(data.rlike("(?d)^[0-9a-fA-F]+$") & (F.length(data) >= 4), hex_text(data))),
        _candidate(
            "plain",
            F.when(
                data.rlike("(?d)^[A-Za-z0-9+/=]+$") & (F.length(data) > 10),
                strict_base64_text(F.rtrim(data, F.lit("\n"))),
            ),
        ),
        _candidate("gzip", zipped),
        _candidate("percent", F.when(F.contains(data, F.lit("%")), percent_decoded(data))),
    )
    # A lambda variable holds each candidate, so none is decoded again for its tests.
    accepted = F.filter(
        candidates,
        lambda c: F.coalesce(is_meaningful(c["text"]), F.lit(False)) & ((c["kind"] != "percent") | (c["text"] != data)),
    )
    # A one-row generator keeps the optimizer from writing the decoders out again for each use of their result.
    one = rows.withColumn("_layer", F.explode_outer(F.array(F.when(now == state, F.get(accepted, F.lit(0))))))
    kind, text = F.col("_layer.kind"), F.col("_layer.text")
    left = F.when(kind == "plain", strip(text)).when(kind == "percent", text).when(now != state, data)
    peeled = one.withColumns({"_text": F.coalesce(text, F.col("_text")), "_data": left}).drop("_layer")
    return peeled.withColumn("_next", F.when(now == state, _state(F.col("_data"))))


def layered_decode(df: DataFrame, column: str, output: str = "decoded", max_layers: int = MAX_LAYERS) -> DataFrame:
    """Peel up to ``max_layers`` encodings; each layer is hex, base64, gzip in base64, or percent, in that order,
    and counts only if what comes out reads like text.

    A worklist: each layer reads its rows once and is a table in the shared folder, with the state of every row for the next
    layer. Rows that cannot be encoded are done at once, and only rows that changed in a layer go on to the next; where none
    did, the loop ends. Rows that look like gzip are taken from the layer's table, and they alone go through Python.
    """
    spark = df.sparkSession
    folder = run_folder(spark, "layers")

    def kept(rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    work = df.withColumns({"_data": F.col(column), "_text": F.lit(None).cast("string")}).withColumn("_now", _state(F.col("_data")))
    out = []
    for n in range(max_layers):
        layer = kept(_peeled(work, _CODED, F.lit(None).cast("string")), f"layer={n}")
        waiting = layer.where(F.col("_now") == _ZIPPED)
        layer = layer.where(F.col("_now") != _ZIPPED).withColumn("_next", F.coalesce("_next", F.lit(_DONE)))
        if waiting.limit(1).count():
            zipped = waiting.drop("_next").withColumn("_zip", _gunzip_base64("_data"))
            layer = layer.unionByName(kept(_peeled(zipped, _ZIPPED, F.col("_zip")).drop("_zip"), f"zipped={n}"))
        goes_on = F.col("_next") != _DONE
        if n + 1 == max_layers or not layer.where(goes_on).limit(1).count():
            out.append(layer)
            break
        out.append(layer.where(~goes_on))
        work = layer.where(goes_on).withColumn("_now", F.col("_next")).drop("_next")
    if not out:
        out = [work]
    return reduce(DataFrame.unionByName, [rows.select(*df.columns, F.col("_text").alias(output)) for rows in out])


def _candidate(kind: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), text.alias("text"))


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    def one(text):
        if text is None:
            return None
        try:
            plain = text.encode("utf-8").decode("unicode_escape")
        except UnicodeDecodeError:
            return None
        return plain.encode("utf-8", errors="replace").decode("utf-8") if plain != text else None

    return texts.map(one)


# Not moved or repeated by the optimizer: a filter on the result must not run the function twice.
_unescape = _unescape.asNondeterministic()


def unescape_js(df: DataFrame, column: str, output: str = "unescaped") -> DataFrame:
    """Backslash escapes resolved, bytes read as Latin-1; null when nothing changes. Rows without a backslash stay native."""
    text = F.col(column)
    escaped = F.contains(text, F.lit("\\"))
    latin = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return df.withColumn("_py", _unescape(F.when(escaped, text))).select(
        *df.columns, F.when(escaped, F.col("_py")).when(latin != text, latin).alias(output)
    )


def is_printable(text: Column) -> Column:
    return ~text.rlike(r"[\p{C}\p{Z}&&[^ ]]")


def hex_escapes(files: DataFrame) -> DataFrame:
    runs = find_all(files, HEX_ESCAPES)
    decoded = utf8_text(F.unhex(F.replace("matched", F.lit("\\x"), F.lit(""))))
    return _strings(runs, decoded, "hex_escape").where(is_printable(F.col("decoded")))


def unicode_escapes(files: DataFrame) -> DataFrame:
    """Surrogates are no characters of their own, so runs that hold one are not printable."""
    runs = find_all(files, UNICODE_ESCAPES).where(~F.col("matched").rlike(r"\\u[dD][89a-fA-F]"))
    decoded = F.decode(F.unhex(F.replace("matched", F.lit("\\u"), F.lit(""))), "UTF-16BE")
    return _strings(runs, decoded, "unicode_escape").where(is_printable(F.col("decoded")))


def eval_base64(files: DataFrame) -> DataFrame:
    runs = find_all(files, EVAL_BASE64)
    decoded = strict_base64_text(F.regexp_extract("matched", java_regex(EVAL_BASE64), 1))
    return _strings(runs, decoded, "eval_base64").where("decoded <> ''")


def char_codes(files: DataFrame) -> DataFrame:
    """String.fromCharCode lists; one malformed number voids the call, numbers beyond Unicode are left out."""
    runs = find_all(files, FROM_CHAR_CODE)
    parts = F.transform(F.split(F.regexp_extract("matched", java_regex(FROM_CHAR_CODE), 1), ",", -1), strip)
    well_formed = F.forall(
        parts, lambda p: p.rlike(r"^[+-]?(?:0+|[1-9][0-9]*|0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+)\z")
    )

    def number(part: Column) -> Column:
        digits = F.regexp_replace(part, r"^[+-]?0?[xXoObB]?(?=.)", "")
        value = (
            F.when(part.rlike(r"^[+-]?0[xX]"), F.conv(digits, 16, 10))
            .when(part.rlike(r"^[+-]?0[oO]"), F.conv(digits, 8, 10))
            .when(part.rlike(r"^[+-]?0[bB]"), F.conv(digits, 2, 10))
            .otherwise(F.regexp_replace(part, r"^[+-]", ""))
        )
        magnitude = value.try_cast("decimal(38,0)")
        return F.when(F.startswith(part, F.lit("-")), -magnitude).otherwise(magnitude)

    codes = F.filter(F.transform(parts, number), lambda c: (c >= 0) & (c <= 0x10FFFF))
    text = F.array_join(
        F.transform(codes, lambda c: F.decode(F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0")), "UTF-32")), ""
    )
    return _strings(runs.where(well_formed), text, "from_char_code").where("decoded <> ''")


def _strings(runs: DataFrame, decoded: Column, kind: str) -> DataFrame:
    return runs.select("repo_id", "path", "line_no", F.lit(kind).alias("kind"), decoded.alias("decoded"))


def decode_script_strings(files: DataFrame) -> DataFrame:
    """All four kinds of hidden strings: repo_id, path, line_no, kind, decoded."""
    return (
        hex_escapes(files)
        .unionByName(unicode_escapes(files))
        .unionByName(eval_base64(files))
        .unionByName(char_codes(files))
    )


def script_urls(files: DataFrame) -> DataFrame:
    return files.select(
        "repo_id", "path", F.explode_outer(F.regexp_extract_all("content", F.lit(java_regex(SCRIPT_URL)), F.lit(0))).alias("url")
    ).where("url is not null")
