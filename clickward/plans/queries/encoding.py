"""Queries of leakage-safe encodings."""

from __future__ import annotations

from clickward.operators import encoding as ops
from clickward.operators.clean import cast_events, prepare_events
from clickward.operators.ordering import split_groups, time_order
from clickward.operators.splits import temporal_split
from clickward.plans.queries import sql
from clickward.plans.queries.registry import query, rounded
from clickward.session import materialize
from clickward.sources.adapters import clicks_clean

TARGET, FOLDS, ALPHA = "is_attributed", 5, 20.0
FEATURES = [*[(c,) for c in ops.SINGLES], *ops.PAIRS]


def _split(spark, sf_dir):
    return temporal_split(prepare_events(cast_events(clicks_clean(spark, sf_dir))))


_RATE = """
train AS (SELECT * FROM parted WHERE split = 'train'),
rate AS (SELECT avg(is_attributed) AS g, count(*) AS n FROM train),
folded AS (
  SELECT p.*, g, CASE WHEN split = 'train'
    THEN CAST((idx >= n // 5) AS INTEGER) + CAST((idx >= 2 * n // 5) AS INTEGER) + CAST((idx >= 3 * n // 5) AS INTEGER) + CAST((idx >= 4 * n // 5) AS INTEGER)
    ELSE 5 END AS fold
  FROM parted p, rate)
"""


def _encode_sql(keys: tuple[str, ...]) -> str:
    """Encoding of one feature: earlier folds' rows of the same key, by a join."""
    name = "_".join(keys)
    same = " AND ".join(f"f.{k} = h.{k}" for k in keys)
    listed = ", ".join(keys)
    return f"""
enc_{name} AS (
  SELECT f.event_id, round(COALESCE((sum(h.s) + 20.0::DOUBLE * max(f.g)) / (sum(h.c) + 20.0::DOUBLE), max(f.g)), 6) AS te_{name},
    COALESCE(CAST(sum(h.c) AS DOUBLE), 0.0) AS freq_{name}_train
  FROM folded f LEFT JOIN (
    SELECT {listed}, fold, sum(is_attributed) AS s, count(*) AS c FROM folded WHERE split = 'train' GROUP BY {listed}, fold) h
  ON {same} AND h.fold < f.fold
  GROUP BY f.event_id)
"""


def _sql(*features: tuple[str, ...], where: str = "") -> str:
    names = ["_".join(k) for k in features]
    columns = ", ".join(f"te_{n}, freq_{n}_train" for n in names)
    joins = " ".join(f"JOIN enc_{n} USING (event_id)" for n in names)
    return sql.with_(
        *sql.CLEAN_SPLIT,
        _RATE,
        *[_encode_sql(k) for k in features],
        select=f"SELECT event_id, {columns} FROM folded {joins} {where}",
    )


@query(
    "smoothed_stats",
    sql.with_(
        *sql.CLEAN_SPLIT,
        _RATE,
        select="""
SELECT app, channel, round((sum(is_attributed) + 20.0::DOUBLE * max(g)) / (count(*) + 20.0::DOUBLE), 6) AS enc_val, count(*) AS freq_val
FROM folded WHERE split = 'train' GROUP BY app, channel
""",
    ),
)
def smoothed_stats(spark, sf_dir):
    split = _split(spark, sf_dir)
    _, rate = ops.train_summary(split, TARGET)
    stats = ops.smoothed_stats(split.where("split = 'train'"), ("app", "channel"), TARGET, rate, ALPHA)
    return stats.select("app", "channel", *rounded("enc_val"), "freq_val")


def _encoded(spark, sf_dir, keys):
    split = _split(spark, sf_dir)
    rows, rate = ops.train_summary(split, TARGET)
    folded = ops.with_folds(split, rows, FOLDS)
    rows_, groups = split_groups(folded, keys, time_order())
    return ops.encode(rows_, [groups], TARGET, rate, FOLDS, ALPHA, history_of=folded)


@query("oof_te_single", _sql(("ip",), where="WHERE split = 'train'"))
def oof_te_single(spark, sf_dir):
    out = _encoded(spark, sf_dir, ("ip",)).where("split = 'train'")
    return out.select("event_id", *rounded("te_ip"), "freq_ip_train")


@query("oof_te_pair", _sql(("ip", "app"), where="WHERE split = 'train'"))
def oof_te_pair(spark, sf_dir):
    out = _encoded(spark, sf_dir, ("ip", "app")).where("split = 'train'")
    return out.select("event_id", *rounded("te_ip_app"), "freq_ip_app_train")


@query("holdout_te", _sql(("app", "channel"), where="WHERE split <> 'train'"))
def holdout_te(spark, sf_dir):
    out = _encoded(spark, sf_dir, ("app", "channel")).where("split <> 'train'")
    return out.select("event_id", *rounded("te_app_channel"), "freq_app_channel_train")


@query("rate_features", _sql(*FEATURES))
def rate_features(spark, sf_dir):
    out, info = ops.rate_features(materialize(_split(spark, sf_dir), "split"), TARGET, FOLDS, ALPHA)
    names = [*info.singles, *info.pairs]
    return out.select(
        "event_id", *rounded(*[f"te_{n}" for n in names]), *[f"freq_{n}_train" for n in names]
    )
