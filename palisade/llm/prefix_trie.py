"""Prefix trie of rebuilt conversations, by composable fingerprints; no rebuilt text is ever formed.

A turn is an element g of the integers modulo P, and a sequence of turns is the monoid element (length, sum of g_i * B^i): two of
them combine to (m + n, x + B^m * y). Turns are numbered and multiplied up in ranges of the sorted table, whose products then
combine to the offsets of the ranges, so a conversation of any length is spread over tasks. The prefix of depth d of a rebuilt
conversation is the product of the head of its base and of a stretch of its own turns, which is the quotient of two of its own
prefixes: three such residues, computed from numbers alone, are the fingerprint of a node.

Equality is verified, not assumed. Turns with the same 128-bit key must have the same role and text, and members of a node must
refer to turns with the same key; as the parent's fingerprint follows from the node's and the last key, equality of whole prefixes
follows from the root down. If any group fails, all is done again with other constants.

What a subtree holds is added up over the members of its top: a node counts at its smallest member only, and a conversation is
the smallest member of a node exactly from some depth on.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.llm.common import stored

P = 2**31 - 1
RESIDUES = 3
ATTEMPTS = 8
#: Members of a node that end in it are written as pieces of this many ids, then digested in order.
IDS_PER_PIECE = 4096
#: A parent with more children than this is copied SALTS times for the join.
HOT_CHILDREN = 1000
SALTS = 32
NODE = ["d", *(f"f{j}" for j in range(RESIDUES))]
SUMS = [f"s{j}" for j in range(RESIDUES)]


class Residues:
    """Constants of one attempt, and powers as columns."""

    def __init__(self, attempt: int):
        rng = random.Random(attempt)
        self.attempt = attempt
        self.bases = [rng.randrange(1 << 20, P - 1) for _ in range(RESIDUES)]

    def turn(self, j: int, a: Column | str = "a", b: Column | str = "b") -> Column:
        return F.pmod(F.xxhash64(a, b, F.lit(100 + 10 * self.attempt + j)), F.lit(P - 1)) + 1

    def power(self, j: int, exponent: str, levels: int = 4) -> Column:
        """B^exponent modulo P for exponents below 256^levels, from tables of powers by bytes of the exponent."""
        out = None
        for level in range(levels):
            base = pow(self.bases[j], 256**level, P)
            table = ", ".join(f"{pow(base, i, P)}L" for i in range(256))
            part = F.expr(f"element_at(array({table}), cast((shiftright({exponent}, {8 * level}) & 255) + 1 as int))")
            out = part if out is None else out * part % P
        return out

    def inverse(self, j: int, exponent: str, most: int) -> Column:
        """B^-exponent for 0 <= exponent <= most."""
        base = pow(self.bases[j], -1, P)
        return F.expr(f"element_at(array({', '.join(f'{pow(base, i, P)}L' for i in range(most + 1))}), cast({exponent} + 1 as int))")


def head_length(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % 9


MOST_HEAD = 8


def running_totals(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """rows with `upto` (the sum of value over the key's rows up to this one), `whole` (over all of them) and `first` (their
    smallest order), for an order that is unique within the key. The table is cut into ranges, whose sums are combined, so a key
    may hold any share of the rows."""
    ranged = stored(rows.repartitionByRange(key, order).withColumn("range", F.spark_partition_id()), "ranges")
    local = Window.partitionBy("range", key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.groupBy("range", key).agg(F.sum(value).alias("own"), F.min(order).alias("low"))
    across = Window.partitionBy(key)
    before = F.coalesce(F.sum("own").over(across.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("range", key, before.alias("before"), F.sum("own").over(across).alias("whole"), F.min("low").over(across).alias("first"))
    placed = ranged.withColumn("upto", F.sum(value).over(local)).join(offsets, ["range", key])
    return placed.withColumn("upto", F.col("upto") + F.col("before")).drop("range", "before")


def prefix_trie(conversations: DataFrame, group: int = 5) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conversations: (conv_id, turn, role, text). Conversation c is rebuilt as the first h original turns of c - c % group (all if
    fewer, none if absent), then its own turns after its first h; h = crc32(c as text) % 9. Turns go by turn, null first, ties by
    role, then text; null role and text are empty. Repeated rows are turns like others. Rows with a null conv_id are left out.
    Texts of any length are hashed whole and compared whole, once for each distinct one. An empty table gives no node; extra
    columns are ignored.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("c"),
        F.col("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("c is not null")
    for attempt in range(ATTEMPTS):
        nodes = _trie(turns, Residues(attempt), group)
        if nodes is not None:
            return nodes
    raise RuntimeError(f"fingerprints met in {ATTEMPTS} attempts")


def _numbered(turns: DataFrame, k: Residues) -> tuple[DataFrame, DataFrame]:
    """(range, c, k, a, b, bytes, sums) of every turn, k and sums counted within its range; (range, c, n, off, sums before, last)."""
    tied = bool(turns.groupBy("c", "turn").agg(F.count("*").alias("n")).where("n > 1").limit(1).count())
    tie = [F.col(x) if tied else F.lit("").alias(x) for x in ("role", "text")]
    key = lambda i: F.xxhash64("role", "text", F.lit(2 * k.attempt + i))
    slim = turns.select("c", "turn", key(0).alias("a"), key(1).alias("b"), F.octet_length("text").cast("long").alias("bytes"), *tie, F.monotonically_increasing_id().alias("row"))
    order = [F.col("turn").asc_nulls_first(), "role", "text", "row"]
    ranged = stored(slim.repartitionByRange("c", *order).withColumn("range", F.spark_partition_id()), "turns")
    within = Window.partitionBy("range", "c").orderBy(*order)
    local = ranged.withColumn("k", F.row_number().over(within).cast("long"))
    sums = [F.sum(k.turn(j) * k.power(j, "k") % P).over(within.rowsBetween(Window.unboundedPreceding, 0)) % P for j in range(RESIDUES)]
    local = stored(local.select("range", "c", "k", "a", "b", "bytes", *[s.alias(n) for s, n in zip(sums, SUMS)]), "numbered")

    ends = local.groupBy("range", "c").agg(F.max(F.struct("k", *SUMS)).alias("e")).select("range", "c", F.col("e.k").alias("n"), *[F.col(f"e.{s}").alias(s) for s in SUMS])
    before = Window.partitionBy("c").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0)))
    lifted = ends.select("*", *[(k.power(j, "off") * F.col(s) % P).alias(f"l{j}") for j, s in enumerate(SUMS)])
    return local, lifted.select("range", "c", "n", "off", *[(F.coalesce(F.sum(f"l{j}").over(before), F.lit(0)) % P).alias(f"o{j}") for j in range(RESIDUES)], *[f"l{j}" for j in range(RESIDUES)])


def _trie(turns: DataFrame, k: Residues, group: int) -> DataFrame | None:
    texts = turns.groupBy("role", "text").agg(F.lit(1).alias("one"))
    keys = texts.select(*[F.xxhash64("role", "text", F.lit(2 * k.attempt + i)).alias(n) for i, n in enumerate("ab")])
    if keys.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        return None
    local, spans = _numbered(turns, k)
    spans = stored(spans, "spans")
    at = lambda j: ((F.col(f"o{j}") + k.power(j, "off") * F.col(f"s{j}")) % P).alias(f"s{j}")
    early = local.where(F.col("k") <= MOST_HEAD).join(spans.where(F.col("off") < MOST_HEAD).drop(*[f"l{j}" for j in range(RESIDUES)]), ["range", "c"])
    early = early.withColumn("i", F.col("off") + F.col("k")).where(F.col("i") <= MOST_HEAD).select("c", "i", "a", "b", "bytes", *[at(j) for j in range(RESIDUES)])

    whole = [F.sum(f"l{j}").alias(f"w{j}") for j in range(RESIDUES)]
    convs = spans.groupBy("c").agg(F.sum("n").alias("turns"), *whole).select("c", "turns", head_length(F.col("c")).alias("h"), (F.col("c") - F.col("c") % group).alias("base"), *[(F.col(f"w{j}") % P).alias(f"w{j}") for j in range(RESIDUES)])
    heads = early.withColumnRenamed("c", "base").join(convs.select("c", "base", "h"), "base").where("i <= h").select("c", "i", "a", "b", "bytes", *SUMS)
    last = lambda rows, own, prefix: rows.groupBy("c").agg(F.max(F.struct("i", *SUMS)).alias("e")).select("c", F.col("e.i").alias(own), *[F.col(f"e.s{j}").alias(f"{prefix}{j}") for j in range(RESIDUES)])
    own = last(early.join(convs.select("c", "h"), "c").where("i <= h"), "_", "q").drop("_")
    convs = convs.join(own, "c", "left").join(last(heads, "hb", "p"), "c", "left").na.fill(0, ["hb", *[f"{x}{j}" for x in "pq" for j in range(RESIDUES)]])
    convs = stored(convs.withColumn("gap", F.col("h") - F.col("hb")), "conversations")

    # (range, c) is what the turns are dealt by, so numbers of a conversation reach its turns without meeting in one task.
    by_span = spans.select("range", "c", "off", *[f"o{j}" for j in range(RESIDUES)]).join(convs, "c")
    behind = lambda j, x: F.pmod(F.col(f"p{j}") + k.inverse(j, "gap", MOST_HEAD) * F.pmod(F.col(x) - F.col(f"q{j}"), F.lit(P)), F.lit(P))
    suffix = local.join(by_span, ["range", "c"]).where("off + k > h").withColumn("i", F.col("off") + F.col("k"))
    suffix = suffix.withColumns({f"s{j}": at(j) for j in range(RESIDUES)})
    suffix = suffix.select("range", "c", (F.col("i") - F.col("gap")).alias("d"), *[behind(j, f"s{j}").alias(f"f{j}") for j in range(RESIDUES)], "a", "b", "bytes")
    zero = F.lit(0).cast("long")
    heads = heads.select(F.lit(-1).alias("range"), "c", F.col("i").alias("d"), *[F.col(f"s{j}").alias(f"f{j}") for j in range(RESIDUES)], "a", "b", "bytes")
    roots = convs.select(F.lit(-1).alias("range"), "c", zero.alias("d"), *[zero.alias(f"f{j}") for j in range(RESIDUES)], zero.alias("a"), zero.alias("b"), zero.alias("bytes"))
    members = stored(suffix.unionByName(heads).unionByName(roots), "members")

    met = members.groupBy(*NODE).agg(F.min("c").alias("rep"), F.count("*").alias("n_convs"), *[f(x).alias(f"{n}_{x}") for x in ("a", "b") for f, n in ((F.min, "min"), (F.max, "max"))], F.max("bytes").alias("bytes"))
    up = [F.pmod(F.col(f"f{j}") - k.turn(j, "min_a", "min_b") * k.power(j, "d"), F.lit(P)).alias(f"u{j}") for j in range(RESIDUES)]
    nodes = stored(met.select("*", *up), "nodes")
    if nodes.where("min_a != max_a or min_b != max_b").limit(1).count():
        return None
    nodes = nodes.select(*NODE, *[f"u{j}" for j in range(RESIDUES)], "rep", "n_convs", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    kids = nodes.where("d > 0").groupBy((F.col("d") - 1).alias("d"), *[F.col(f"u{j}").alias(f"f{j}") for j in range(RESIDUES)]).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, NODE, "left").na.fill(0, ["n_children"])
    nodes = stored(running_totals(nodes, "rep", "d", "saved"), "chains")

    # A conversation's own chain: the nodes whose smallest member it is. Each of its other prefixes holds the chain whole.
    chains = nodes.groupBy("rep").agg(F.max("whole").alias("t"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves")).where("t > 0 or leaves > 0").withColumnRenamed("rep", "c")
    spread = by_span.select("range", "c").union(convs.select(F.lit(-1).alias("range"), "c")).join(chains, "c")
    under = members.select("range", "c", *NODE).join(spread, ["range", "c"]).groupBy(*NODE).agg(F.sum("t").alias("t"), F.sum("leaves").alias("n_leaves"))
    nodes = nodes.join(under, NODE, "left").na.fill(0, ["t", "n_leaves"]).withColumn("saved_tokens", F.col("t") - F.col("upto") + F.col("saved"))
    ends = convs.select("c", (F.col("turns") - F.col("gap")).alias("past"), "hb", *[behind(j, f"w{j}").alias(f"f{j}") for j in range(RESIDUES)], *[f"p{j}" for j in range(RESIDUES)], (F.col("turns") > F.col("h")).alias("own"))
    ends = ends.select("c", F.when(F.col("own"), F.col("past")).otherwise(F.col("hb")).alias("d"), *[F.when(F.col("own"), F.col(f"f{j}")).otherwise(F.col(f"p{j}")).alias(f"f{j}") for j in range(RESIDUES)])
    nodes = stored(nodes.join(_digests(ends), NODE, "left"), "trie")
    return _with_parents(nodes).select(
        F.col("rep").alias("conv_id"),
        F.col("d").alias("depth"),
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def _batch(rows: list[list], numbers: list[str], text: str) -> pa.RecordBatch:
    columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(numbers))]
    return pa.RecordBatch.from_arrays([*columns, pa.array([r[-1] for r in rows], pa.string())], [*numbers, text])


def _digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined ids of each node: ids become pieces in ranges, pieces of a node one digest."""
    node = ", ".join(f"{x} long" for x in NODE)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids = None, []
        for batch in batches:
            out = []
            for *key, c in zip(*(batch.column(x).to_pylist() for x in (*NODE, "c"))):
                if ids and (key != at or len(ids) == IDS_PER_PIECE):
                    out.append([*at, ids[0], ",".join(map(str, ids))])
                    ids = []
                at = key
                ids.append(c)
            yield _batch(out, [*NODE, "low"], "ids")
        yield _batch([[*at, ids[0], ",".join(map(str, ids))]] if ids else [], [*NODE, "low"], "ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*(batch.column(x).to_pylist() for x in (*NODE, "ids"))):
                if key != at:
                    if at is not None:
                        out.append([*at, state.hexdigest()])
                    at, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _batch(out, NODE, "ends_sha256")
        yield _batch([] if at is None else [[*at, state.hexdigest()]], NODE, "ends_sha256")

    cut = ends.repartitionByRange(*NODE, "c").sortWithinPartitions(*NODE, "c").mapInArrow(pieces, f"{node}, low long, ids string")
    return cut.repartition(*NODE).sortWithinPartitions(*NODE, "low").mapInArrow(digest, f"{node}, ends_sha256 string")


def _with_parents(nodes: DataFrame) -> DataFrame:
    """nodes with `parent`, the smallest member of the parent: the node's own, but where the chain begins."""
    inner = nodes.where("d > first").withColumn("parent", F.col("rep"))
    starts = nodes.where("d = first and d > 0")
    key = [F.col("d").alias("pd"), *[F.col(f"f{j}").alias(f"u{j}") for j in range(RESIDUES)]]
    up = [f"u{j}" for j in range(RESIDUES)]
    parents = nodes.where("n_children > 0").select(*key, F.col("rep").alias("parent"), "n_children")
    starts = starts.withColumn("pd", F.col("d") - 1).withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)))
    # Few parents have many children; only these are copied, and their children are dealt over the copies.
    hot = parents.where(F.col("n_children") > HOT_CHILDREN).select("pd", *up, F.col("parent").alias("hot"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    starts = starts.join(hot, ["pd", *up, "salt"], "left")
    rest = starts.where("hot is null").join(parents.where(F.col("n_children") <= HOT_CHILDREN).drop("n_children"), ["pd", *up])
    columns = [*nodes.columns, "parent"]
    root = nodes.where("d = 0").withColumn("parent", F.lit(None).cast("long"))
    return inner.select(columns).unionByName(rest.select(columns)).unionByName(starts.where("hot is not null").withColumn("parent", F.col("hot")).select(columns)).unionByName(root.select(columns))
