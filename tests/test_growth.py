"""Work per row: what costs most over large tables is done once, or not at all."""

from collections import Counter
from dataclasses import replace
from datetime import timedelta
from glob import glob
from math import log2

from pyspark.sql import Row, functions as F

from palisade.functions.text import shannon_entropy
from palisade.operators import ranges, similar_names
from palisade.operators.matching import _gated, match_content, occurrences
from palisade.rules import behavior, secrets
from palisade.sources import archives
from palisade.streaming.changed_files import LastSeen


def test_shared_letters_are_compared_as_numbers(spark):
    """Repeated letters and letters of several bytes, against a plain count; no text is searched for each pair."""
    words = ["aabbaa", "abab", "\U0001f600\U0001f600ab", "éèéè", "banana", "bananas", "cabana", "zzzzzz", "é", ""]
    names, popular = spark.createDataFrame([(w,) for w in words], "name string"), spark.createDataFrame([(w,) for w in words], "popular string")
    pairs = similar_names.bound_pairs(names, popular)
    want = {}
    for a in words:
        for b in words:
            shared = sum((Counter(a) & Counter(b)).values())
            if a and b and a != b and 2 * shared >= similar_names.MIN_RATIO * (len(a) + len(b)):
                want[a, b] = shared
    assert {(r.name, r.popular): r.shared for r in pairs.collect()} == want and want
    assert "replace(" not in pairs._jdf.queryExecution().optimizedPlan().toString()


class _Handle:
    """State and timers of one key, and the calls they cost."""

    def __init__(self):
        self.state, self.timers, self.calls = None, set(), Counter()

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.state

    def update(self, value):
        self.state = value

    def clear(self):
        self.state = None

    def listTimers(self):
        self.calls["list"] += 1
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.calls["register"] += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls["delete"] += 1
        self.timers.discard(at)


def test_a_file_keeps_one_timer_without_listing_them():
    handle, seen = _Handle(), LastSeen("r", timedelta(seconds=1))
    seen.init(handle)
    rows = lambda *r: iter([Row(at=at, size=size, sha256=sha) for at, size, sha in r])
    out = list(seen.handleInputRows(("a", "p"), rows((30, 1, "x"), (10, None, None), (20, 1, "x")), None))
    assert [(r.size, r.sha256, r.at) for r in out] == [(None, None, 10), (1, "x", 20)]
    assert list(seen.handleInputRows(("a", "p"), rows((5, 1, "x")), None)) == [] and handle.calls == {"register": 1}
    assert len(list(seen.handleInputRows(("a", "p"), rows((2_000_000, 1, "x")), None))) == 1
    assert handle.timers == {3001} and handle.calls == {"register": 2, "delete": 1}
    assert list(seen.handleExpiredTimer(("a", "p"), None, None)) == [] and handle.state is None


def test_members_leave_in_small_batches(spark):
    """A worker holds a few megabytes of members, however many archives a batch brings."""
    import io
    import zipfile

    def zipped(n):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            for i in range(n):
                z.writestr(f"m{i}.txt", b"x" * (1 << 20))
        return buffer.getvalue()

    rows = spark.createDataFrame([("r", f"{i}.zip", zipped(4)) for i in range(6)] + [("r", "gone.zip", None)], "repo_id string, path string, raw binary").coalesce(1)
    got = archives.read_archives(rows).mapInArrow(lambda it: (b.select(["size"]).append_column("held", [sum(len(x.as_py() or b"") for x in b["raw"])] * b.num_rows) for b in it), "size long, held long")
    assert archives._BATCH_BYTES <= 4 << 20
    assert archives.expand_archives(rows).agg(F.sum("size")).first()[0] == 24 << 20 and archives.archive_errors(rows).count() == 1
    assert got.where("size is null").count() == 1


def test_entropy_counts_sorted_characters(spark):
    lines = ["aab", "a\nb\nb", "\U0001f600é\U0001f600", " ", "x" * 500, "abc" * 70 + "ß", ""]
    frame = spark.createDataFrame([(x,) for x in lines] + [(None,)], "t string").select("t", shannon_entropy(F.col("t")).alias("e"))
    want = lambda t: -sum(n / len(t) * log2(n / len(t)) for n in Counter(t).values()) if t else 0.0
    assert all(abs(r.e - want(r.t)) < 1e-8 for r in frame.collect())
    assert "replace(" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_links_alone_do_not_start_the_expressions_for_links(spark, as_files):
    """Rules about links have further literals: prose with a link skips them, every match still comes out."""
    rules = [r for r in [*behavior.RULES, *secrets.RULES] if r.rule_id in ("B1", "B2", "B22", "K4", "K6")]
    hits = ["https://a.example/x/PAYLOAD", "FETCH ( 'http://a')", "http.get('https://b')", "https://a.example/?a=1&Token=x", "mongodb+srv://u:p@h/d", "amqps://u:p@h", "api_key = 'abcdefgh01234567'"]
    files = as_files([("prose.txt", "see https://a.example/x for the key and more")] + [(f"{i}.txt", t) for i, t in enumerate(hits)])
    prepared, guards, _ = _gated(files, rules, "content", ["path"])
    admitted = prepared.select("path", *[F.expr(g).alias(r.rule_id) for r, g in zip(rules, guards)]).where("path = 'prose.txt'").first()
    assert not any(admitted[r.rule_id] for r in rules)
    assert {r.path for r in match_content(files, rules).collect()} == {f"{i}.txt" for i in range(len(hits))}


def test_ranges_take_up_texts_that_admit_a_rule_and_store_no_pieces(spark, as_files):
    """Long texts without a rule's literals cost a search for literals; runs are measured, and ranges dealt, for the others only."""
    plain, key = "word " * 600, "AKIA" + "A" * 16
    spaced = "eval" + " " * 900 + "('1') " + plain
    files = as_files([("plain.txt", plain), ("key.txt", f"{plain}\n{key}\n{plain}"), ("spaced.js", spaced), ("small.txt", key)])
    rules = [r for r in [*behavior.RULES, *secrets.RULES] if r.rule_id in ("B7", "K1")]
    folders = lambda: set(glob(f"{spark.conf.get('spark.checkpoint.dir')}/ranges-*"))
    known = folders()
    found = ranges.match_content_by_ranges(files, rules, range_chars=600, overlap=200)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(found) == rows(match_content(files, rules)) and len(rows(found)) == 3
    (folder,) = folders() - known
    assert {p.rpartition("/")[2] for p in glob(f"{folder}/*")} == {"files", "found", "astray"}
    stored = {r.path: (r._ranged, r._whole) for r in spark.read.parquet(f"{folder}/files").collect()}
    assert stored == {"key.txt": ([1], []), "spaced.js": ([], [0])}


def test_a_look_at_the_first_character_changes_no_match(spark, as_files):
    """Letters that folding equates with ASCII ones begin words too; patterns that may begin otherwise stay as they are."""
    assert ranges.led_by_first(r"(?:dig|ping)\s+x") == r"(?=[dp])(?:dig|ping)\s+x"
    for pattern in (r"(?i)\b(?:token|key)=", r"\s*(?:dig|ping)", r"(?:a|b)?c?", r"eval\(", r"(?:[ab]|c)d"):
        assert ranges.led_by_first(pattern) == pattern
    rules = [r for r in [*behavior.RULES, *secrets.RULES] if ranges.led_by_first(r.pattern) != r.pattern]
    led = [replace(r, pattern=ranges.led_by_first(r.pattern)) for r in rules]
    words = "socket \u017focket SEND \u017fend Fork FOR\u212a spawn sftp a@b scp a@b at  x AT\u00a0x reg add REG ADD redis://u:p@h chmod +x Dig x p\u0131ng x P\u0130NG x echo $MY_SECRET"
    files = as_files([("a.txt", words), ("b.txt", words.upper()), ("c.txt", words.replace(" ", "\n"))])
    rows = lambda rules: sorted(map(str, occurrences(files, rules).collect()))
    assert len(rules) > 10 and rows(led) == rows(rules) and len(rows(rules)) > 20
