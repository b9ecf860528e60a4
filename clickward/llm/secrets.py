"""Secret scans in DataFrame functions only: known shapes, and sliding-window entropy for the rest.

Known shapes are found by regular expressions, leftmost and without overlap
per kind. Further candidates are runs of token characters. Each belongs to a
character class (hexadecimal, letters of one case, letters or digits of one
case, letters, anything), and a window of `WINDOW` characters slides over it. The window's Shannon entropy follows
from the sum of c * log2(c) over its symbol counts c; a step changes only the
counts of the symbol that leaves and the one that enters, so the sum is kept
up to date by two differences. A candidate whose highest window entropy
reaches its class's limit is reported, unless the allow-list names it (known
examples and placeholders, identifiers, names in camel case, digests announced
as such, runs of the alphabet) or a known shape already covers part of it. The allow-list never
removes a known shape.

Positions come from the lengths of matches and of the gaps between them, one
row each, summed up in a window per text: linear in a text's matches.

Every step is linear in a text, however long its runs are. Candidates that tie
in entropy are all reported.

Defined cases: a null or empty text has no span; rows without doc_id are left
out; repeated rows are reported again; an empty table gives an empty result;
further columns are ignored. Positions are code points, from 0, end exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 20

# Kinds in their order, with pattern, group that must be long enough, its least length, and a cheap test.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
# Character classes of candidates, the first that fits counts, and the bits a window must reach. Nine of
# ten random strings of 20 characters reach their class's limit; words reach 3.6 bits and several in a row 3.7, so
# letters of one case need more than that and are found as surely only from 40 characters on.
CLASSES = (
    (r"^([0-9a-f]+|[0-9A-F]+)$", 3.1),
    (r"^([A-Z]?[a-z]+|[A-Z]+)$", 3.7),
    (r"^([a-z0-9]+|[A-Z0-9]+)$", 3.6),
    (r"^[A-Za-z]+$", 3.75),
    (r"", 3.8),
)
# What is no secret though it looks random.
ALLOWED = (
    r"(?i)example|placeholder|dummy|changeme|sample|redacted|xxxx|0123456789|abcdefghij|lorem"
    r"|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    r"|^[0-9_/=+-]+$|^[A-Za-z]+([_/-][A-Za-z0-9]{1,12})+$|(?-i:^[a-z]*([A-Z][a-z]+){2,}$)"
)
ALLOWED_BEFORE = r"(?i)(sha-?(1|224|256|384|512)|md5|integrity|checksum|digest|commit|etag|uuid|guid|isbn|doi)[\x20:=\"'-]*$"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    group: int
    least: int
    test: str | None = None


KINDS = (
    Kind("assign", ASSIGN, 2, 6),
    Kind("access", ACCESS, 0, 20, "AKIA"),
    Kind("hex", HEX, 0, 24),
    Kind("entropy", CANDIDATE, 0, WINDOW),
)
BASE = len(KINDS) - 1


def _pieces(kind: Kind, rank: int) -> Column:
    """Matches of a kind in `text`: their strings, the part that must be long, and the gaps around them."""
    pattern = F.lit(kind.pattern)
    found = F.struct(
        F.lit(rank).alias("rank"),
        F.regexp_extract_all("text", pattern, F.lit(0)).alias("match"),
        F.regexp_extract_all("text", pattern, F.lit(kind.group)).alias("value"),
        F.split("text", kind.pattern, -1).alias("gap"),
    )
    present = F.col("text").rlike(kind.pattern)
    if kind.test:
        present = F.contains("text", F.lit(kind.test)) & present
    return F.when(present, found)


def peak_entropy(text: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy, in bits, of any `window` characters of a text at least that long."""
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])

    def gain(count: Column) -> Column:
        return F.get(weight, count + 1) - F.get(weight, count)

    def over(chars: Column) -> Column:
        def step(state: Column, at: Column) -> Column:
            # Characters that stay in the window while one leaves and one enters.
            start = F.greatest(at - (window - 1), F.lit(0))
            stay = F.slice(chars, start + 1, at - start)
            enters = gain(F.size(F.filter(stay, lambda c: c == F.get(chars, at))))
            leaves = gain(F.size(F.filter(stay, lambda c: c == F.get(chars, at - window))))
            total = state["total"] + enters - F.when(at >= window, leaves).otherwise(0.0)
            least = F.when(at >= window - 1, F.least(state["least"], total)).otherwise(state["least"])
            return F.struct(total.alias("total"), least.alias("least"))

        start = F.struct(F.lit(0.0).alias("total"), F.lit(1e9).alias("least"))
        places = F.sequence(F.lit(0), F.size(chars) - 1)
        return F.aggregate(places, start, step, lambda s: F.lit(math.log2(window)) - s["least"] / window)

    # A one-element array binds the split characters to a name, so they are split once.
    return F.get(F.transform(F.array(F.split(text, "")), over), 0)


def secret_spans(docs: DataFrame) -> DataFrame:
    """(row, doc_id, rank, start, end): a row per span, and one of rank -1 per document."""
    texts = docs.where(F.col("doc_id").isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text")
    )
    none = F.array().cast("array<string>")
    # One entry without matches stands for the document itself, whatever else is found or dropped.
    document = F.struct(F.lit(-1).alias("rank"), none.alias("match"), none.alias("value"), none.alias("gap"))
    pieces = F.filter(F.array(document, *[_pieces(kind, rank) for rank, kind in enumerate(KINDS)]), lambda p: p.isNotNull())
    zipped = F.transform(
        F.sequence(F.lit(0), F.size("p.match") - 1),
        lambda i: F.struct(
            i.alias("at"),
            F.char_length(F.get("p.gap", i)).alias("gap"),
            F.char_length(F.get("p.match", i)).alias("length"),
            F.char_length(F.get("p.value", i)).alias("value"),
            F.when(F.col("p.rank") == BASE, F.get("p.match", i)).alias("text"),
            F.when(F.col("p.rank") == BASE, F.right(F.get("p.gap", i), F.lit(24))).alias("before"),
        ),
    )
    found = texts.select("row", "doc_id", pieces.alias("pieces"))
    matches = (
        found.select("row", "doc_id", F.explode("pieces").alias("p"))
        .select("row", "doc_id", "p.rank", F.explode_outer(F.when(F.size("p.match") > 0, zipped)).alias("m"))
        .select("row", "doc_id", "rank", "m.*")
    )
    so_far = Window.partitionBy("row", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("length")).over(so_far)
    placed = matches.repartition("row").withColumn("end", end).withColumn("start", F.col("end") - F.col("length"))
    least = F.get(F.array(*[F.lit(k.least) for k in KINDS]), F.col("rank"))
    long_enough = placed.where((F.col("rank") < 0) | (F.col("value") >= least))

    bits = F.coalesce(*[F.when(F.col("text").rlike(pattern), F.lit(limit)) for pattern, limit in CLASSES])
    allowed = F.col("text").rlike(ALLOWED) | F.col("before").rlike(ALLOWED_BEFORE)
    random = F.when(F.col("rank") == BASE, ~allowed & (peak_entropy(F.col("text")) >= bits)).otherwise(True)
    kept = long_enough.where(random)

    # A candidate stands at its end, a known shape at its start: what began before it ends must also end before it.
    is_base = F.col("rank").between(0, BASE - 1)
    order = F.when(is_base, F.col("start")).otherwise(F.col("end"))
    before = (
        Window.partitionBy("row").orderBy(order, is_base.cast("int")).rowsBetween(Window.unboundedPreceding, -1)
    )
    covered = F.max(F.when(is_base, F.col("end"))).over(before)
    free = kept.withColumn("covered", covered).where((F.col("rank") != BASE) | (F.coalesce("covered", F.lit(-1)) <= F.col("start")))
    return free.select("row", "doc_id", "rank", "start", "end")


def secret_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_entropy, base_spans, spans): one row per row of `docs`."""
    spans = secret_spans(docs)
    name = F.get(F.array(*[F.lit(k.name) for k in KINDS]), F.col("rank"))
    label = F.concat_ws(":", name, "start", "end")
    entry = F.struct("start", "rank", label.alias("label"))
    known = F.col("rank") >= 0

    def listed(condition: Column) -> Column:
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.when(condition, entry))), lambda e: e["label"]), ",")

    counts = [F.count(F.when(F.col("rank") == r, 1)).alias(f"n_{k.name}") for r, k in enumerate(KINDS)]
    return (
        spans.groupBy("row", "doc_id")
        .agg(*counts, listed(known & (F.col("rank") < BASE)).alias("base_spans"), listed(known).alias("spans"))
        .drop("row")
    )
