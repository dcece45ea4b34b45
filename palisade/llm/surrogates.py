"""Personal data: detected entities receive keyed, type-consistent surrogates.

detect() finds e-mail addresses, telephone, card, social security and bank account numbers, IP addresses, access keys, assigned
secrets and titled names in whole texts; a name that stands behind a title is replaced wherever its text mentions it. Each has a canonical form, so all its spellings share one surrogate. A surrogate keeps
what the type fixes (length and kinds of characters, card and account checks, the country, private networks, a name's gender and
script) and is drawn from HMAC-SHA256 of a secret key. assign() draws for all distinct entities of the corpus; a surrogate that
two entities of a type draw, or that is itself an entity of the corpus, is drawn anew, until all differ. After every WIDEN
draws the format of what is still open widens: other octet lengths, then a wider private network, then any address, then IPv6
form; longer local parts, names and numbers; any printable character in secrets. So no format runs out. The mapping goes to the
tasks if its size stays below a bound that is checked; otherwise it reaches the texts by joins.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import ipaddress
import itertools
import re
import string
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from palisade.llm.common import free_names, small_arrow_batches, stored, text_key

KEY = b"palisade-surrogates"
SEND_BOUND = 32 * 1024 * 1024
#: Draws after which a format widens by a step.
WIDEN = 8
#: What a secret is drawn from where its own kinds of characters leave no choice.
PRINTABLE = string.ascii_letters + string.digits + "!#$%&()*+,-./:;=?@[]^_{|}~"

MALE = ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Signor", "г-н", "Господин", "господин", "κ.", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "Signora", "г-жа", "Госпожа", "госпожа", "κα", "Κυρία")
NEUTRAL = ("Dr", "Prof", "Professor")
GENDER = {t: "m" for t in MALE} | {t: "f" for t in FEMALE} | {t: "n" for t in NEUTRAL}
#: Syllables and endings that names are built from, by script; endings by gender, then of surnames.
SYLLABLES = {
    "latin": ("ba be da do fe ga ha jo ka la le ma mi na no pa ra ri sa so ta ti va vi".split(), {"m": "n r s ld".split(), "f": "a ia na lla".split(), "n": "e i y o".split(), "s": "ner mann well ton".split()}),
    "cyrillic": ("ба ве да до ка ла ле ма ми на но па ра ри са со та ти ва ви".split(), {"m": "н р с й".split(), "f": "а ия на ла".split(), "n": "е и о у".split(), "s": "нко лин рук цев".split()}),
    "greek": ("βα δα κα λα λε μα μι να νο πα ρα ρι σα σο τα τι φα".split(), {"m": "ς νος ρης λος".split(), "f": "α ια νη λα".split(), "n": "ι ο ε υ".split(), "s": "κης δης νου λας".split()}),
}

NAME_PART = r"[^\W\d_a-zà-öø-ÿа-яα-ω][^\W\d_]+(?:[-'’][^\W\d_]+)?"
TITLED = re.compile(rf"(?<!\w)({'|'.join(sorted(map(re.escape, GENDER), key=len, reverse=True))})\.? ({NAME_PART}(?: {NAME_PART})?)")
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
NUMBERS = (
    ("account", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z\d]{4}){3,7}(?: ?[A-Z\d]{1,3})?(?!\w)")),
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,3}(?!\d)|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])|(?<![\w.,+-])(?<!\d )(?:0\d{1,4}(?: \d{2,8}){1,4}|\d{3} \d{3} \d{4})(?![\w-]| \d|[.,]\d)")),
    ("card", re.compile(r"(?<![\w.-])(?:[3-6]\d{12,18}|[3-6]\d{3}([ -])\d{4}\1\d{4}\1\d{4})(?![\w-])")),
    ("card", re.compile(r"(?<![\w.-])3\d{3}([ -])\d{6}\1\d{5}(?![\w-])")),
    ("ssn", re.compile(r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("ip", re.compile(rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?![\w]|\.\d)")),
)
THREE_DIGITS = re.compile(r"\d{2}")
COLONS = re.compile(r"(?<![\w:])[\w:]+")
GROUP = re.compile(r"[0-9A-Fa-f]{0,4}")
MENTION = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
PART = re.compile(r"[^\W\d_]+")
ACCESS_KEY = re.compile(r"(?<!\w)(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)")
SECRET = re.compile(r"(?i)(?<![a-z])(?:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?([^\s\"'<>]{8,})")
LOCAL = re.compile(r"[\w.%+-]")
DOMAIN = re.compile(r"[^\W_][\w-]*(?:\.[^\W_][\w-]*)+")


def script_of(word: str) -> str:
    name = unicodedata.name(word[0], "")
    return "cyrillic" if name.startswith("CYRILLIC") else "greek" if name.startswith("GREEK") else "latin"


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text[start - 1]):
            start -= 1
        while start < at and text[start] in ".-+%_":
            start += 1
        domain = DOMAIN.match(text, at + 1)
        if start < at and domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _addresses(text: str) -> Iterator[tuple[int, int, str]]:
    """IPv6 addresses, full or compressed, as (start, end, canonical form); "::" and "::1" name no one, and words take no part."""
    for m in COLONS.finditer(text):
        if m.group().count(":") < 2 or re.match(r"\.\d", text[m.end() : m.end() + 2]):
            continue
        at, spans = m.start(), []
        for group in m.group().split(":"):
            if GROUP.fullmatch(group):
                spans.append((at, at + len(group)))
            else:
                yield from _address(text, spans)
                spans = []
            at += len(group) + 1
        yield from _address(text, spans)


def _address(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """The address that the groups of a run make, if need be without a single colon at an end."""
    for first, last in ((0, 0), (0, 1), (1, 0), (1, 1)):
        own = spans[first : len(spans) - last]
        if 3 <= len(own) <= 9 and not (first and spans[0][0] < spans[0][1] or last and spans[-1][0] < spans[-1][1]):
            found = text[own[0][0] : own[-1][1]]
            if any(c.isdigit() for c in found):
                try:
                    address = ipaddress.IPv6Address(found)
                except ValueError:
                    continue
                if int(address) > 1:
                    yield own[0][0], own[-1][1], ":".join(f"{int(x, 16):x}" for x in address.exploded.split(":"))
                return


def _mentions(text: str, names: dict[str, str]) -> Iterator[tuple[int, int, str, str]]:
    """Whole words, also in capitals, that are names of the text. names: kind by word."""
    for m in MENTION.finditer(text):
        parts = [p.span() for p in PART.finditer(text, *m.span())]
        i = 0
        while i < len(parts):
            for j in (i + 1, i):
                own = text[parts[i][0] : parts[j][1]] if j < len(parts) else ""
                if own in names:
                    yield parts[i][0], parts[j][1], names[own], own.lower()
                    i = j
                    break
            i += 1


def same_name(kind: str) -> str:
    """Names are one kind: gender and place only shape what is drawn."""
    return "name" if kind.startswith("name-") else kind


def detect(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical form) of the entities of a text, in order, without overlaps; earlier kinds win."""
    found: list[tuple[int, int, str, str]] = []
    if not text:
        return found
    if "@" in text:
        found += [(s, e, "email", text[s:e].lower()) for s, e in _emails(text)]
    if "AKIA" in text or "ASIA" in text:
        found += [(*m.span(), "access", m.group()) for m in ACCESS_KEY.finditer(text)]
    if "=" in text or ":" in text:
        # One sign repeated is a mask or a rule, not a value.
        found += [(*m.span(1), "secret", m.group(1)) for m in SECRET.finditer(text) if m.group(1)[0].isalnum() or len(set(m.group(1))) > 1]
    if "::" in text or text.count(":") >= 7:
        found += [(s, e, "ip6", canon) for s, e, canon in _addresses(text)]
    if THREE_DIGITS.search(text):
        for kind, pattern in NUMBERS:
            for m in pattern.finditer(text):
                s = m.group()
                if kind == "card" and len(s) == 17 and luhn(_digits(s)):
                    continue
                if kind == "phone" and s[0] == "0" and " " in s and not 8 <= len(_digits(s)) <= 13:
                    continue
                canon = s if kind == "ip" else s.replace(" ", "") if kind == "account" else ("+" if s[0] == "+" else "") + _digits(s)
                found.append((*m.span(), kind, canon))
    if any(t in text for t in GENDER):
        names: dict[str, str] = {}
        for m in TITLED.finditer(text):
            at, parts = m.start(2), m.group(2).split(" ")
            for i, part in enumerate(parts):
                own = part[:-2] if part[-2:] in ("'s", "’s", "'S", "’S") else part
                kind = f"name-{'s' if i == len(parts) - 1 else GENDER[m.group(1)]}-{script_of(own)}"
                found.append((at, at + len(own), kind, own.lower()))
                for form in (own, own.upper(), own[0] + own[1:].lower()):
                    names.setdefault(form, kind)
                at += len(part) + 1
        if names:
            found += _mentions(text, names)
    kept: list[tuple[int, int, str, str]] = []
    for x in found:
        at = bisect.bisect(kept, x)
        if (not at or kept[at - 1][1] <= x[0]) and (at == len(kept) or kept[at][0] >= x[1]):
            kept.insert(at, x)
    return kept


class _Draws:
    """Keyed pseudo-random choices."""

    def __init__(self, key: bytes, *what: object):
        self.key, self.what, self.n, self.rest = key, "\x1f".join(map(str, what)).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.rest) < 4:
            self.rest += hmac.new(self.key, self.what + self.n.to_bytes(4, "little"), hashlib.sha256).digest()
            self.n += 1
        x, self.rest = int.from_bytes(self.rest[:4], "little"), self.rest[4:]
        return x % n

    def like(self, c: str) -> str:
        if c.isdigit():
            return str(self.below(10))
        if c.isascii() and c.isalpha():
            return chr((97 if c.islower() else 65) + self.below(26))
        if c.isalpha():
            base = {"cyrillic": 0x430, "greek": 0x3B1}.get(script_of(c))
            made = chr(base + self.below(16)) if base else chr(97 + self.below(26))
            return made.upper() if c.isupper() else made
        return c


def luhn(digits: str) -> int:
    """The check sum of a card number; 0 for a valid one."""
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10


def _account_check(account: str) -> str:
    moved = account[4:] + account[:2] + "00"
    return f"{98 - int(''.join(str(int(c, 36)) for c in moved)) % 97:02d}"


def draw(kind: str, canon: str, key: bytes, attempt: int) -> str:
    """The surrogate of a canonical form at an attempt, in canonical form itself. Every WIDEN attempts the format is a step wider."""
    rnd, wide = _Draws(key, kind, canon, attempt), attempt // WIDEN
    more = lambda c: "".join(map(rnd.like, c * wide))
    if kind == "email":
        local, _, domain = canon.rpartition("@")
        own = _Draws(key, "domain", domain)
        labels = domain.split(".")
        hidden = ["".join(map(own.like, x)) if x not in ("example", "www", "mail") else x for x in labels[:-1]]
        return ("".join(map(rnd.like, local)) + more("x")).lower() + "@" + ".".join([*hidden, labels[-1]])
    if kind == "card":
        made = canon[0] + "".join(map(rnd.like, canon[1:-1])) + more("0")
        check = next(c for c in "0123456789" if luhn(made + c) == 0)
        return made + (check if luhn(canon) == 0 else str((int(check) + 1 + rnd.below(9)) % 10))
    if kind == "phone":
        keep = 2 if canon.startswith("+1") else 3 if canon.startswith("+") else 1 if canon.startswith("0") else 0
        rest = canon[keep:]
        return canon[:keep] + str(2 + rnd.below(8)) + "".join(map(rnd.like, rest[1:])) + more("0")
    if kind == "ip":
        octets = canon.split(".")
        keep = 1 if octets[0] in ("10", "127") else 2 if canon.startswith("192.168.") or octets[0] == "172" and 16 <= int(octets[1]) < 32 else 0
        if wide >= 4:
            return "fd" + ":".join("".join("0123456789abcdef"[rnd.below(16)] for _ in range(n)) for n in (2, *[4] * 7))
        if wide >= 2 and keep:
            octets, keep = (["10"], 1) if wide == 2 else ([], 0)
        if wide:
            made = [str(rnd.below(256)) for _ in range(4 - keep)]
            return ".".join(octets[:keep] + made)
        sizes = {1: (1, 9), 2: (11, 89), 3: (101, 155)}
        made = [str(sizes[len(o)][0] + rnd.below(sizes[len(o)][1])) for o in octets[keep:]]
        if not keep and made[0] in ("10", "127"):
            made[0] = "5" * len(made[0]) if len(made[0]) < 3 else "155"
        return ".".join(octets[:keep] + made)
    if kind == "ip6":
        group = lambda n: "123456789abcdef"[rnd.below(15)] + "".join("0123456789abcdef"[rnd.below(16)] for _ in range(n - 1))
        return ":".join("0" if part == "0" and not wide else group(4 if wide else len(part)) for part in canon.split(":"))
    if kind == "account":
        made = canon[:2] + "00" + "".join(map(rnd.like, canon[4:])) + more("0")
        return made[:2] + _account_check(made) + made[4:]
    if kind == "access":
        return canon[:4] + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[rnd.below(32)] for _ in canon[4:]) + more("A")
    if kind == "secret" and re.fullmatch(r"[0-9a-f]+", canon):
        return "".join("0123456789abcdef"[rnd.below(16)] for _ in canon) + more("0")
    if kind == "secret" and (wide or not any(c.isalnum() for c in canon)):
        return "".join(PRINTABLE[rnd.below(len(PRINTABLE))] for _ in range(len(canon) + max(0, wide - 1)))
    if kind.startswith("name-"):
        _, gender, script = kind.split("-")
        syllables, endings = SYLLABLES[script]
        n = 2 + wide
        return "".join(syllables[rnd.below(len(syllables))] for _ in range(n)) + endings[gender][rnd.below(len(endings[gender]))]
    return "".join(map(rnd.like, canon)) + more("0")


def render(kind: str, original: str, surrogate: str) -> str:
    """A surrogate in the format of the text it replaces."""
    if kind in ("phone", "card", "ssn", "account"):
        rest = iter(surrogate.removeprefix("+"))
        return "".join(next(rest) if c.isalnum() else c for c in original) + "".join(rest)
    if kind == "email":
        same = len(surrogate) == len(original)
        return "".join(s.upper() if o.isupper() else s for o, s in zip(original, surrogate)) if same else surrogate
    if kind == "ip6":
        groups = original.split(":")
        made = ipaddress.IPv6Address(surrogate).compressed if "::" in original else ":".join(g.zfill(len(o)) for g, o in zip(surrogate.split(":"), groups))
        return made.upper() if original.isupper() else made
    if kind.startswith("name-"):
        return surrogate.upper() if original.isupper() else surrogate[0].upper() + surrogate[1:]
    return surrogate


def replace(text: str, found: list[tuple[int, int, str, str]], mapping: dict[tuple[str, str], str]) -> str:
    out, at = [], 0
    for start, end, kind, canon in found:
        out += [text[at:start], render(kind, text[start:end], mapping[same_name(kind), canon])]
        at = end
    return "".join([*out, text[at:]])


def entities(documents: DataFrame) -> DataFrame:
    """Distinct (kind, canon) of the text column."""
    small_arrow_batches(documents.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = sorted({(k, c) for t in batch.column(0) for *_, k, c in detect(t.as_py())})
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.string()), pa.array([c for _, c in own], pa.string())], ["kind", "canon"])

    return documents.select("text").mapInArrow(find, "kind string, canon string").distinct()


def assign(found: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, canon, surrogate): distinct within a kind, and never itself an entity of that kind. found: distinct (kind, canon).

    Names of all kinds come back as the kind "name": a word has one surrogate whatever its gender and place.
    Ends for every input, as formats widen without end.
    """
    name = F.when(F.startswith("kind", F.lit("name-")), F.lit("name")).otherwise(F.col("kind"))
    known = stored(found.groupBy(name.alias("kind"), "canon").agg(F.min("kind").alias("shape")), "entities")
    taken, open_ = None, known
    for attempt in itertools.count():
        def pick(batches: Iterator[pa.RecordBatch], attempt: int = attempt) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [draw(k, c, key, attempt) for k, c in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], ["kind", "canon", "shape", "surrogate"])

        drawn = open_.select("kind", "canon", "shape").mapInArrow(pick, "kind string, canon string, shape string, surrogate string")
        drawn = drawn.join(known.select("kind", F.col("canon").alias("surrogate"), F.lit(1).alias("real")).distinct(), ["kind", "surrogate"], "left")
        if taken is not None:
            drawn = drawn.join(taken.select("kind", "surrogate", F.lit(1).alias("used")), ["kind", "surrogate"], "left")
        else:
            drawn = drawn.withColumn("used", F.lit(None).cast("int"))
        drawn = stored(drawn, "drawn")
        free = drawn.where("real is null and used is null")
        won = free.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon")).select("kind", "canon", "surrogate")
        taken = stored(won if taken is None else taken.unionByName(won), "surrogates")
        open_ = stored(drawn.select("kind", "canon", "shape").join(taken.select("kind", "canon"), ["kind", "canon"], "left_anti"), "open")
        if not open_.limit(1).count():
            return taken


def secret_key(spark: SparkSession) -> bytes:
    """The key of the session's setting `spark.palisade.surrogates.key`; without it the published KEY, with which surrogates can be recomputed."""
    named = spark.conf.get("spark.palisade.surrogates.key", None)
    return named.encode() if named else KEY


def replace_entities(documents: DataFrame, key: bytes | None = None, send_bound: int = SEND_BOUND, count_to: str | None = None) -> DataFrame:
    """documents with surrogates in the text column; with count_to, also the number of entities replaced in a column of that name.

    Without a key, that of the session's setting is used (`secret_key`).
    Texts without entities, null and empty ones stay as they are; other columns stay; repeated rows change alike; an empty
    table stays empty.
    """
    spark = documents.sparkSession
    mapping = assign(entities(documents), key or secret_key(spark))
    size = mapping.agg(F.sum(F.octet_length("kind") + F.octet_length("canon") + F.octet_length("surrogate") + 100)).first()[0] or 0
    small_arrow_batches(spark)
    columns = [c for c in documents.columns if c != count_to]
    fields = documents.select(*columns).schema.fields
    schema = StructType([*fields, *(StructType().add(count_to, "long").fields if count_to else [])])

    def rewritten(batch: pa.RecordBatch, maps: Iterator[dict]) -> pa.RecordBatch:
        texts, counts = [], []
        for text, own in zip(batch.column("text"), maps):
            text = text.as_py()
            found = detect(text)
            texts.append(replace(text, found, own) if found else text)
            counts.append(len(found))
        made = [pa.array(texts, batch.schema.field("text").type) if c == "text" else batch.column(c) for c in columns]
        return pa.RecordBatch.from_arrays(made + [pa.array(counts, pa.int64())] * bool(count_to), columns + [count_to] * bool(count_to))

    if size <= send_bound:
        whole = {(r["kind"], r["canon"]): r["surrogate"] for r in mapping.collect()}

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield rewritten(batch, (whole for _ in range(batch.num_rows)))

        return documents.select(*columns).mapInArrow(apply, schema)

    ta, tb, own_map = free_names([*documents.columns, count_to or "", "kind", "canon", "surrogate"], "_ta", "_tb", "_map")

    def own_entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted({(a, b, same_name(k), c) for text, a, b in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()) for *_, k, c in detect(text.as_py())})
            cols = list(zip(*rows)) if rows else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()))], [ta, tb, "kind", "canon"])

    keyed = documents.select(*columns, text_key("text")["a"].alias(ta), text_key("text")["b"].alias(tb))
    held = keyed.select("text", ta, tb).mapInArrow(own_entities, f"{ta} long, {tb} long, kind string, canon string").distinct()
    by_text = held.join(mapping, ["kind", "canon"]).groupBy(ta, tb).agg(F.collect_list(F.struct("kind", "canon", "surrogate")).alias(own_map))

    def apply_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield rewritten(batch, ({(x["kind"], x["canon"]): x["surrogate"] for x in m.as_py() or []} for m in batch.column(own_map)))

    return keyed.join(by_text, [ta, tb], "left").select(*columns, own_map).mapInArrow(apply_own, schema)
