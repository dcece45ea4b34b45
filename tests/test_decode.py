"""Decoders against small Python references."""

import base64
import gzip
import random
import re
from urllib.parse import unquote

from pyspark.sql import functions as F

from palisade.functions import decode, unicode

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def py_base64(x):
    try:
        return base64.b64decode(x).decode("utf-8", "replace")
    except ValueError:
        return None


def meaningful(t):
    if len(t) < 5 or sum(" " <= c <= "~" for c in t) / len(t) < 0.7:
        return False
    return not (" " not in t and len(t) > 50 and t.isalpha())


def peel(x, depth=3):
    """Layers as specified: hex, base64, gzip in base64, percent; the first readable result wins."""
    if depth == 0:
        return None
    tries = []
    if re.fullmatch(r"[0-9a-fA-F]{4,}", x):
        try:
            tries.append((bytes.fromhex(x).decode("utf-8", "replace"), "strip"))
        except ValueError:
            pass
    if re.fullmatch(r"[A-Za-z0-9+/=]{11,}", x):
        tries.append((py_base64(x), "strip"))
    try:
        tries.append((gzip.decompress(base64.b64decode(x)).decode("utf-8", "replace"), "stop"))
    except (ValueError, OSError, EOFError):
        pass
    if unquote(x) != x:
        tries.append((unquote(x), "keep"))
    for text, how in tries:
        if text is not None and meaningful(text):
            deeper = None if how == "stop" else peel(text.strip() if how == "strip" else text, depth - 1)
            return deeper or text
    return None


def test_base64_accepts_exactly_what_python_does(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET + "=" * rng.choice([0, 3, 30])) for _ in range(rng.randint(1, 24))) for _ in range(3000)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", decode.strict_base64_text(F.col("t")).alias("d")).collect()
    assert [(r.t, r.d) for r in got if r.d != py_base64(r.t)] == []
    assert sum(r.d is not None for r in got) > 300


def test_layered_decode(spark):
    rng = random.Random(5)

    def wrap(t):
        for _ in range(rng.randint(0, 4)):
            kind, raw = rng.randint(0, 4), t.encode()
            if kind == 0:
                t = raw.hex()
            elif kind == 1:
                t = base64.b64encode(raw).decode()
            elif kind == 2:
                t = base64.b64encode(gzip.compress(raw)).decode()
            elif kind == 3:
                t = "".join(f"%{b:02x}" for b in raw)
            else:
                t = "  " + t + "%41%zz+ "
        return t

    texts = [wrap("".join(rng.choice("hello world \u00e9;(){}abc\n") for _ in range(rng.randint(3, 70)))) for _ in range(300)]
    texts += ["hello%20world", "48656c6c6f", "ab", "a" * 60, "aGVsbG8gd29ybGQ=", "not encoded at all"]
    got = decode.layered_decode(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()
    assert [(r.t, r.decoded) for r in got if r.decoded != peel(r.t)] == []
    assert sum(r.decoded is not None for r in got) > 100


def test_layered_decode_reads_its_rows_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    zipped = base64.b64encode(gzip.compress(b"hello zipped world")).decode()
    texts = ["hello%20world", "plain text", zipped, base64.b64encode(zipped.encode()).decode(), None, b"hello world".hex().encode().hex()]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").mapInArrow(seen, "t string")
    got = decode.layered_decode(rows, "t")
    assert read.value == len(texts)
    assert sorted((r.t or "", r.decoded) for r in got.collect()) == sorted((t or "", peel(t) if t else None) for t in texts)


def test_unescape_js(spark):
    texts = ["\\x68\\x65\\x6c\\x6c\\x6f", "hello", "hell\\u006f", "\\uZZZZ", "\u00e9", "\u00e9\\n"]
    want = ["hello", None, "hello", None, "\u00c3\u00a9", "\u00c3\u00a9\n"]
    got = {r.t: r.unescaped for r in decode.unescape_js(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()}
    assert [got[t] for t in texts] == want


def test_hidden_strings(as_files):
    b64 = base64.b64encode(b"alert(document.domain)").decode()
    text = (
        'a = "\\x48\\x69";\nb = "\\u0048\\u00e9";\neval(atob("' + b64 + '"));\nString.fromCharCode(72, 0x69, 0b100001)\n'
        'String.fromCharCode(72, 08)\nc = "\\x00\\x01"; d = "\\ud83d\\ude00"; String.fromCharCode(-5, 99999999)'
    )
    got = sorted((r.kind, r.line_no, r.decoded) for r in decode.decode_script_strings(as_files([("a.js", text)])).collect())
    assert got == [
        ("eval_base64", 3, "alert(document.domain)"), ("from_char_code", 4, "Hi!"), ("hex_escape", 1, "Hi"), ("unicode_escape", 2, "H\u00e9"),
    ]
    assert decode.decode_script_strings(as_files([("a.js", 'var x = "hello world";')])).count() == 0


def test_script_urls(as_files):
    urls = decode.script_urls(as_files([("a.js", 'fetch("https://evil.example/p"); x(http://b.example)')])).collect()
    assert sorted(r.url for r in urls) == ["http://b.example", "https://evil.example/p"]


def test_unicode_cleanup(spark, as_files):
    row = spark.createDataFrame([("a\u200bb\u200cc\u202ed\u202c \u0430\u0435",)], "t string").select(
        unicode.strip_invisible(F.col("t")), unicode.strip_bidi(F.col("t")), unicode.normalize_homoglyphs(F.col("t")), unicode.count_invisible(F.col("t"))
    ).first()
    assert row[0] == "abcd \u0430\u0435" and row[1] == "a\u200bb\u200ccd \u0430\u0435" and row[2].endswith(" ae") and row[3] == 4
    lines = unicode.trojan_lines(as_files([("t", "\u202eline1\n\u202eline2\u202c\nnormal")])).collect()
    assert sorted((r.line_no, r.code_point) for r in lines) == [(1, "Bidi override U+202E"), (2, "Bidi override U+202C"), (2, "Bidi override U+202E")]
