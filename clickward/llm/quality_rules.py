"""Quality rules: base statistics of every text, then robust multivariate outliers per language and source.

The statistics of a document become a vector; in each (lang, source) group the
minimum-covariance-determinant estimate gives a centre and a scatter of the
most concentrated `SUBSET` of the group, and a document far from its group's
centre by Mahalanobis distance is rejected.

The estimate runs as concentration steps over all documents of all groups at
once: distances from the present estimate are counted in fine bins per group,
the bin that completes the subset is the cut, and the moments of what lies
below it are the next estimate. A step moves one row of moments per (group,
start, bin), never a document, so a group may hold any share of the table.
There are four deterministic starts: the median and the median absolute
deviation of each number, taken from the same kind of bins, and from the
numbers standardised by these the correlations of their hyperbolic tangents,
those of the directions from the median, and the plain moments. All starts take
`TRIAL` steps; the one of least determinant goes on until its determinant falls
no more, at most `STEPS` steps. The scatter gets a floor on its diagonal,
because most texts have no symbols and no repeats at all and an exact zero
scatter would make one symbol an infinite distance; determinants are compared
with it. Only documents that pass the base rule enter the estimates. Groups
with fewer than `LEAST` of them are judged together as one group; if these are
still fewer, the base rule alone decides.

Defined cases: a null, empty or blank text has no words and fails the base
rule; null lang or source is a group of its own; repeated rows count as often
as they occur; an empty table gives an empty result; further columns are
ignored. A bin at the cut goes into the subset whole, so equal vectors are in it
or out of it together; of equal determinants the first start's goes on. Whole
texts of any length are counted, a chunk of bytes at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickward.llm.common import PolyHash, chunks, constants, mix, word_bounds
from clickward.session import materialize

WINDOW = 8
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_WORDS = PolyHash(211)
_PLACE = constants(223, WINDOW)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _repeated(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a window of words found twice or more in that text."""
    out = np.zeros(len(first) - 1, np.int64)
    n = len(words) - WINDOW + 1
    if n <= 0:
        return out
    rolled = mix(sum(words[j : n + j] * _PLACE[j] for j in range(WINDOW)))
    for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        m = b - a - WINDOW + 1
        if m < 2:
            continue
        own = rolled[a : a + m]
        ranked = np.sort(own)
        twice = ranked[1:][ranked[1:] == ranked[:-1]]
        if not len(twice):
            continue
        at = np.searchsorted(twice, own)
        starts = twice[np.minimum(at, len(twice) - 1)] == own
        cover = np.zeros(b - a + 1, np.int64)
        np.add.at(cover, np.flatnonzero(starts), 1)
        np.add.at(cover, np.flatnonzero(starts) + WINDOW, -1)
        out[i] = int((np.cumsum(cover[:-1]) > 0).sum())
    return out


def _dup_lines(text: bytes) -> int:
    seen, again = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            again += 1
        elif line.split(None, 1):
            seen.add(line)
    return again


def base_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, STATS...) of every row of `docs`."""
    keep = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))
    fields = [f for f in keep.schema.fields if f.name != "text"]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{s} long" for s in STATS)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, buffer, offsets in chunks(batches):
            starts, ends, first = word_bounds(buffer, offsets)
            words = _WORDS.between(_WORDS.prefix(buffer), starts, ends) if len(starts) else np.zeros(0, np.uint64)
            # A code point is a byte that does not continue one; prefix sums give any span's count.
            points = np.concatenate([[0], np.cumsum((buffer & 0xC0) != 0x80)])
            symbols = np.concatenate([[0], np.cumsum(_SYMBOL[buffer])])
            chars = np.concatenate([[0], np.cumsum(points[ends] - points[starts])])
            raw = buffer.tobytes()
            dup = [_dup_lines(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            made = [
                first[1:] - first[:-1],
                chars[first[1:]] - chars[first[:-1]],
                symbols[offsets[1:]] - symbols[offsets[:-1]],
                np.asarray(dup, np.int64),
                _repeated(words, first),
            ]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(f.name) for f in fields], *[pa.array(m, pa.int64()) for m in made]],
                names=[*[f.name for f in fields], *STATS],
            )

    return keep.mapInArrow(count, ddl)


N = 5
SUBSET = 0.75
TRIAL = 2
STEPS = 30
# A determinant falls if its logarithm does by more than this.
FALL = 1e-6
LEAST = 50
# Fixed values. CUT: chi-square of 5 degrees, 1 in 10,000 beyond it. SPREAD: what the scatter of the closest
# 75 % of a 5-dimensional normal is to be multiplied by. FLOOR: least standard deviation of each number.
CUT = 25.745
SPREAD = 1.4115
FLOOR = (0.5, 0.03, 0.03, 0.35, 0.1)
BINS_PER_OCTAVE = 64
GROUP = ["g_lang", "g_source"]
ESTIMATE = ", ".join(["g_lang string", "g_source string", "start int", "logdet double", *(f"c{i} double" for i in range(N)),
                      *(f"p{i}{j} double" for i in range(N) for j in range(i, N))])
BROADCAST_GROUPS = 10_000


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def transformed() -> list[Column]:
    """x0...x4: length, word length (with 100 words of 5 letters added), symbol share, repeated lines, repeated share."""
    n, chars = F.col("n_words"), F.greatest(F.col("word_chars"), F.lit(1))
    made = (
        F.log(F.greatest(n, F.lit(1)).cast("double")),
        F.log((F.col("word_chars") + 500) / (n + 100)),
        F.sqrt(F.col("n_symbols") / chars),
        F.log1p(F.col("n_dup_lines").cast("double")),
        F.col("n_repeat_words") / F.greatest(n, F.lit(1)),
    )
    return [x.alias(f"x{i}") for i, x in enumerate(made)]


def _distance() -> Column:
    """Squared Mahalanobis distance of x from the joined estimate."""
    off = [F.col(f"x{i}") - F.col(f"c{i}") for i in range(N)]
    terms = [off[i] * off[j] * F.col(f"p{i}{j}") * (1 if i == j else 2) for i in range(N) for j in range(i, N)]
    return sum(terms[1:], terms[0])


def _estimate(key: tuple, start: int, centre: np.ndarray, scatter: np.ndarray, found: bool = True) -> pd.DataFrame:
    """A row of ESTIMATE; what only starts a search (not `found`) has no determinant to compare yet."""
    floored = scatter + np.diag(np.square(FLOOR))
    precise = np.linalg.inv(floored)
    upper = [precise[i, j] for i in range(N) for j in range(i, N)]
    logdet = np.linalg.slogdet(floored)[1] if found else np.inf
    return pd.DataFrame([[*key, start, logdet, *centre, *upper]], columns=[c.split()[0] for c in ESTIMATE.split(", ")])


def _symmetric(row: pd.Series, name: str) -> np.ndarray:
    out = np.zeros((N, N))
    for i in range(N):
        for j in range(i, N):
            out[i, j] = out[j, i] = row[f"{name}{i}{j}"]
    return out


def _middle(values: np.ndarray, counts: np.ndarray) -> float:
    order = np.argsort(values, kind="stable")
    return float(values[order][np.searchsorted(np.cumsum(counts[order]), counts.sum() / 2)])


def _first_estimate(key: tuple, bins: pd.DataFrame) -> pd.DataFrame:
    """Medians and median absolute deviations from counted values."""
    centre, spread = np.zeros(N), np.zeros(N)
    for i, own in bins.groupby("dim"):
        value, count = own["value"].to_numpy(), own["count"].to_numpy()
        centre[i] = _middle(value, count)
        spread[i] = 1.4826 * _middle(np.abs(value - centre[i]), count)
    return _estimate(key, 0, centre, np.diag(spread**2), found=False)


def _more_starts(key: tuple, sums: pd.DataFrame) -> pd.DataFrame:
    """Starts 1 to 3 from the sums of standardised numbers, their tangents and their directions."""
    row = sums.iloc[0]
    middle, unit = (row[[f"{name}{i}" for i in range(N)]].to_numpy(float) for name in ("c", "d"))
    made = []
    for start, name in enumerate(("t", "u", "z"), 1):
        mean = row[[f"{name}{i}" for i in range(N)]].to_numpy(float) / row["count"]
        spread = _symmetric(row, f"{name}{name}") / row["count"] - np.outer(mean, mean)
        if name == "z":
            made.append(_estimate(key, start, middle + unit * mean, spread * np.outer(unit, unit), found=False))
            continue
        size = np.sqrt(np.maximum(np.diag(spread), 1e-12))
        alike = spread / np.outer(size, size)
        np.fill_diagonal(alike, 1.0)
        made.append(_estimate(key, start, middle, alike * np.outer(unit, unit), found=False))
    return pd.concat(made)


def _next_estimate(key: tuple, bins: pd.DataFrame) -> pd.DataFrame:
    """Mean and scatter of the bins nearest to the centre that together hold the subset."""
    bins = bins.sort_values("bin")
    count = bins["count"].to_numpy()
    upto = int(np.searchsorted(np.cumsum(count), np.ceil(SUBSET * count.sum()))) + 1
    near = bins.iloc[:upto].sum()
    centre = np.asarray([near[f"s{i}"] for i in range(N)]) / near["count"]
    scatter = _symmetric(near, "m") / near["count"] - np.outer(centre, centre)
    return _estimate(key[:2], int(key[2]), centre, scatter * SPREAD)


def _beside(rows: DataFrame, estimates: DataFrame, bounded: bool) -> DataFrame:
    """Rows with their group's estimate; the estimates are broadcast only if their count was found small."""
    own = F.broadcast(estimates) if bounded else estimates
    return rows.join(own, GROUP)


def _starts(rows: DataFrame, bounded: bool) -> DataFrame:
    """The estimates that the search starts from, four for every group."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.round(F.col(f"x{i}") * 256).alias("v")) for i in range(N)]))
    counted = rows.select(*GROUP, each.alias("b")).groupBy(*GROUP, "b.dim", "b.v").count()
    counted = counted.select(*GROUP, "dim", (F.col("v") / 256).alias("value"), "count")
    first = materialize(counted.groupBy(*GROUP).applyInPandas(_first_estimate, ESTIMATE), "estimates")
    middle = first.select(*GROUP, *[f"c{i}" for i in range(N)], *[(1 / F.sqrt(f"p{i}{i}")).alias(f"d{i}") for i in range(N)])
    scaled = _beside(rows, middle, bounded).withColumns({f"z{i}": (F.col(f"x{i}") - F.col(f"c{i}")) / F.col(f"d{i}") for i in range(N)})
    away = F.sqrt(sum([F.col(f"z{i}") ** 2 for i in range(1, N)], F.col("z0") ** 2))
    turned = {f"u{i}": F.when(away > 0, F.col(f"z{i}") / away).otherwise(0.0) for i in range(N)}
    scaled = scaled.withColumns({**turned, **{f"t{i}": F.tanh(f"z{i}") for i in range(N)}})
    sums = [F.count("*").alias("count"), *[F.max(f"{n}{i}").alias(f"{n}{i}") for n in "cd" for i in range(N)]]
    sums += [F.sum(f"{n}{i}").alias(f"{n}{i}") for n in "tuz" for i in range(N)]
    sums += [F.sum(F.col(f"{n}{i}") * F.col(f"{n}{j}")).alias(f"{n}{n}{i}{j}") for n in "tuz" for i in range(N) for j in range(i, N)]
    more = scaled.groupBy(*GROUP).agg(*sums).groupBy(*GROUP).applyInPandas(_more_starts, ESTIMATE)
    return materialize(first.unionByName(more), "starts")


def determinant_estimates(rows: DataFrame, bounded: bool, steps: int = STEPS) -> DataFrame:
    """Centre and inverse scatter of every group, and the logarithm of its determinant; `rows` have GROUP and x0...x4."""
    names = [c.split()[0] for c in ESTIMATE.split(", ")]
    bin_ = F.floor(F.log2(F.greatest(_distance(), F.lit(0.0)) + 2.0**-10) * BINS_PER_OCTAVE).alias("bin")
    moments = [F.count("*").alias("count"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(N)]]
    moments += [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"m{i}{j}") for i in range(N) for j in range(i, N)]
    by = [*GROUP, "start"]
    estimates = _starts(rows, bounded)
    for step in range(1, steps + 1):
        placed = _beside(rows, estimates, bounded).select(*by, bin_, *[f"x{i}" for i in range(N)])
        after = placed.groupBy(*by, "bin").agg(*moments).groupBy(*by).applyInPandas(_next_estimate, ESTIMATE)
        before = estimates.select(*by, F.struct(*names).alias("before"))
        pair = before.join(after.select(*by, F.struct(*names).alias("after")), by)
        fell = F.col("after.logdet") < F.col("before.logdet") - FALL
        chosen = pair.select(F.when(fell, F.col("after")).otherwise(F.col("before")).alias("e"), fell.alias("fell"))
        if step == TRIAL:
            least = F.min_by(F.struct("e", "fell"), F.struct("e.logdet", "e.start")).alias("least")
            chosen = chosen.groupBy(*[F.col(f"e.{g}") for g in GROUP]).agg(least).select("least.e", "least.fell")
        written = materialize(chosen.select("e.*", "fell"), "estimates")
        estimates = written.drop("fell")
        if step >= TRIAL and written.where("fell").isEmpty():
            break
    return estimates


def judged(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, STATS..., base_failed, distance, kept) of every row of `docs`."""
    stats = base_statistics(docs).withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source")})
    stats = materialize(stats.select("doc_id", "lang", "source", *STATS, base_failed().alias("base_failed"), *transformed()), "stats")
    sound = stats.where(~F.col("base_failed"))
    large = materialize(sound.groupBy("lang", "source").count().where(F.col("count") >= least).drop("count"), "groups")
    bounded = large.count() < BROADCAST_GROUPS
    marked = large.withColumn("own", F.lit(True))
    grouped = stats.join(F.broadcast(marked) if bounded else marked, ["lang", "source"], "left")
    # A tab occurs in no group of its own: the small groups together.
    rest = F.lit("\trest")
    grouped = grouped.withColumn("g_lang", F.when(F.col("own"), F.col("lang")).otherwise(rest)).withColumn(
        "g_source", F.when(F.col("own"), F.col("source")).otherwise(rest)
    )
    rows = grouped.where(~F.col("base_failed")).select(*GROUP, *[f"x{i}" for i in range(N)])
    estimates = determinant_estimates(rows, bounded)
    rest_count = grouped.where(~F.col("base_failed") & (F.col("g_lang") == rest) & (F.col("g_source") == rest)).count()
    if rest_count < least:
        estimates = estimates.where((F.col("g_lang") != rest) | (F.col("g_source") != rest))
    own = F.broadcast(estimates) if bounded else estimates
    measured = grouped.join(own, GROUP, "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUT)
    return measured.select("doc_id", *STATS, "base_failed", "distance", kept.alias("kept"))
