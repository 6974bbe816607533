"""Execution logs and paired tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.functions.identity import short_id_joined
from evalspark.operators import latency, sketches, stats
from evalspark.plans.registry import Tables, query
from evalspark.session import materialize


@query(
    "lat_percentiles",
    """, d AS (SELECT duration_ms FROM executions WHERE success)
    SELECT unnest(['P50_ms', 'P90_ms', 'P95_ms', 'P99_ms', 'max_ms']) AS name,
      unnest([round(x, 2) FOR x IN quantile_cont(duration_ms, [0.5, 0.9, 0.95, 0.99, 1.0])]) AS value FROM d""",
    "executions",
)
def lat_percentiles(t: Tables):
    """Interpolated latency percentiles of the successful runs."""
    return latency.percentiles(t.adapted("executions"))


@query(
    "lat_percentiles_by_db",
    """, d AS (SELECT db_id, duration_ms FROM executions WHERE success),
    q AS (SELECT db_id, quantile_cont(duration_ms, [0.5, 0.9, 0.95, 0.99, 1.0]) AS v FROM d GROUP BY db_id)
    SELECT db_id, unnest(['P50_ms', 'P90_ms', 'P95_ms', 'P99_ms', 'max_ms']) AS name,
      unnest([round(x, 2) FOR x IN v]) AS value FROM q""",
    "executions",
)
def lat_percentiles_by_db(t: Tables):
    """The same per database."""
    return latency.percentiles(t.adapted("executions"), ["db_id"])


def _daily_sketches(t: Tables):
    """Sketches of each day and database, stored and read back."""
    done = t.adapted("executions").filter("success and duration_ms is not null")
    daily = done.withColumn("day", F.to_date(F.col("ts").cast("timestamp")))
    return done, materialize(sketches.sketch(daily, ["day", "db_id"], "duration_ms"), "latency-sketches")


def _within_bound(done, found, by: list[str]):
    """Whether each quantile's exact rank is as far off as its sketch may be, at most."""
    ranks = F.create_map(*[F.lit(x) for pair in latency.PROFILE.items() for x in pair])
    value, rank = F.col("value"), ranks[F.col("name")]
    places = (
        done.select(*by, "duration_ms")
        .join(F.broadcast(found), by)
        .groupBy(*by, "n", "name", "value")
        .agg(
            F.count("*").alias("rows"),
            F.count_if(F.col("duration_ms") < value).alias("below"),
            F.count_if(F.col("duration_ms") <= value).alias("up_to"),
        )
    )
    bound = sketches.rank_error() + 1 / F.col("rows")
    off = F.greatest(F.col("below") / F.col("rows") - rank, rank - F.col("up_to") / F.col("rows"))
    return places.select(*by, "name", "n", ((F.col("n") == F.col("rows")) & (off <= bound)).alias("as_stated"))


_SKETCHED = "unnest(['P50_ms', 'P90_ms', 'P95_ms', 'P99_ms', 'max_ms']) AS name, count(*) AS n, true AS as_stated"


@query("lat_sketches_by_db", f"SELECT db_id, {_SKETCHED} FROM executions WHERE success GROUP BY db_id", "executions")
def lat_sketches_by_db(t: Tables):
    """Latency percentiles per database from the sketches of its days, against exact ranks."""
    done, stored = _daily_sketches(t)
    merged = sketches.merge(stored, ["db_id"])
    return _within_bound(done, sketches.quantiles(merged, ["db_id"], latency.PROFILE), ["db_id"])


@query("lat_sketches", f"SELECT 'all' AS part, {_SKETCHED} FROM executions WHERE success", "executions")
def lat_sketches(t: Tables):
    """The same over all days and databases."""
    done, stored = _daily_sketches(t)
    whole = sketches.quantiles(sketches.merge(stored, []), [], latency.PROFILE).withColumn("part", F.lit("all"))
    return _within_bound(done.withColumn("part", F.lit("all")), whole, ["part"])


@query(
    "lat_bands",
    """, b(limit_ms) AS (VALUES (3000::BIGINT), (5000), (10000), (30000))
    SELECT limit_ms, count(*) FILTER (duration_ms <= limit_ms) AS n_at_or_below,
      count(*) FILTER (duration_ms > limit_ms) AS n_above FROM executions, b WHERE success GROUP BY limit_ms""",
    "executions",
)
def lat_bands(t: Tables):
    """Successful runs at or below and above each limit."""
    return latency.band_counts(t.adapted("executions"))


_REQUESTS = """, r AS (SELECT value AS ttft_ms, value * 1.53719 + k AS total_latency_ms, k AS output_tokens,
      ts AS started_at, ts + to_milliseconds(CAST(k * 10 AS BIGINT)) AS ended_at FROM event_fields)"""


def _requests(t: Tables):
    k = F.col("k")
    return t.adapted("event_fields").select(
        F.col("value").alias("ttft_ms"),
        (F.col("value") * 1.53719 + k).alias("total_latency_ms"),
        k.alias("output_tokens"),
        F.col("ts").alias("started_at"),
        F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + k * 10_000).alias("ended_at"),
    ).withColumn("started_at", F.col("started_at").cast("timestamp"))


@query(
    "lat_nearest_rank",
    f"""{_REQUESTS}, u AS (SELECT 'ttft_ms' AS metric, ttft_ms AS ms FROM r UNION ALL SELECT 'total_latency_ms', total_latency_ms FROM r),
    o AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY ms) - 1 AS rank, count(*) OVER (PARTITION BY metric) AS n FROM u),
    f(name, p) AS (VALUES ('p50', 0.5::DOUBLE), ('p95', 0.95))
    SELECT metric, name, round(ms, 2) AS value FROM o, f WHERE rank = CAST(round_even(p * (n - 1), 0) AS BIGINT)""",
    "event_fields",
)
def lat_nearest_rank(t: Tables):
    """Nearest-rank percentiles of a request log."""
    return latency.request_percentiles(_requests(t))


@query(
    "request_throughput",
    f"""{_REQUESTS}, w AS (SELECT count(*) AS requests, (epoch_us(max(ended_at)) - epoch_us(min(started_at))) / 1e6 AS wall,
      sum(output_tokens) AS tokens FROM r)
    SELECT requests, round(wall, 2) AS wall_seconds, round(tokens / wall, 2) AS tokens_per_sec,
      round(requests / wall, 2) AS requests_per_sec FROM w""",
    "event_fields",
)
def request_throughput(t: Tables):
    """Tokens and requests per second over the log's wall time."""
    return latency.request_throughput(_requests(t))


@query(
    "lat_slowest",
    """SELECT db_id, count(*) AS n, round(avg(duration_ms), 2) AS mean_ms, round(max(duration_ms), 2) AS max_ms
    FROM executions GROUP BY db_id ORDER BY mean_ms DESC, db_id LIMIT 20""",
    "executions",
)
def lat_slowest(t: Tables):
    """The twenty slowest databases, a top-k report."""
    return latency.slowest(t.adapted("executions"))


@query(
    "lat_policy",
    """, b(limit_ms) AS (VALUES (3000::BIGINT), (5000), (10000))
    SELECT limit_ms, count(*) FILTER (duration_ms > limit_ms OR timed_out) AS exceeding, count(*) AS total,
      round(count(*) FILTER (duration_ms > limit_ms OR timed_out) / count(*), 4) AS ratio
    FROM executions, b GROUP BY limit_ms""",
    "executions",
)
def lat_policy(t: Tables):
    """Runs that a tighter timeout would have cut."""
    return latency.timeout_policy(t.adapted("executions"))


@query(
    "staged_outcomes",
    """SELECT example_id, CASE WHEN success AND duration_ms <= 10000 THEN 'success' ELSE 'timeout' END AS stage_a_10s_outcome,
      CASE WHEN success AND duration_ms <= 10000 THEN 'success_under_10s' WHEN success THEN 'success_10_to_30s'
        ELSE 'timeout_30s' END AS stage_b_30s_outcome FROM executions""",
    "executions",
)
def staged_outcomes(t: Tables):
    """Outcome of each run after both stages."""
    staged = t.adapted("executions").withColumns(latency.staged_outcomes())
    return staged.select("example_id", "stage_a_10s_outcome", "stage_b_30s_outcome")


@query(
    "outcome_rollup",
    """SELECT count(*) AS source_rows, count(*) FILTER (success AND duration_ms <= 3000) AS success_under_3s,
      count(*) FILTER (success AND duration_ms > 3000 AND duration_ms <= 10000) AS success_3_to_10s,
      count(*) FILTER (success AND duration_ms > 10000 AND duration_ms <= 30000) AS success_10_to_30s,
      count(*) FILTER (success) AS success, count(*) FILTER (error_type = 'timeout') AS timeout,
      count(*) FILTER (error_type = 'sqlite_error') AS sqlite_error, count(*) FILTER (error_type = 'unsafe_sql') AS unsafe,
      count(*) FILTER (error_type = 'internal_error') AS internal_error,
      count(*) FILTER (error_type = 'worker_lost') AS other FROM executions""",
    "executions",
)
def outcome_rollup(t: Tables):
    """Runs by duration band and error type."""
    return latency.outcome_rollup(t.adapted("executions"))


_MAPS = """, x AS (SELECT *, 'train-' || db_id || '-' || substr(sha256(db_id || question), 1, 8) AS old_id FROM examples),
    m AS (SELECT old_id, 'stable-' || min(example_id) AS stable_id FROM x WHERE ord % 3 = 0 GROUP BY old_id),
    c AS (SELECT old_id, min(example_id) AS stable_id FROM x WHERE ord % 4 <> 1 GROUP BY old_id)"""


def _id_maps(t: Tables):
    """A log under old ids, and the two maps away from them."""
    old = short_id_joined("train", F.col("db_id"), F.col("question"))
    log = t.adapted("examples").select("ord", "example_id", old.alias("old_id"))
    first = F.min("example_id")
    migration = log.filter("ord % 3 = 0").groupBy("old_id").agg(
        F.concat(F.lit("stable-"), first).alias("stable_id")
    )
    content = log.filter("ord % 4 <> 1").groupBy("old_id").agg(first.alias("stable_id"))
    return log, migration, content


@query(
    "id_remap",
    f"""{_MAPS} SELECT ord, x.old_id AS example_id, coalesce(m.stable_id, c.stable_id, x.old_id) AS stable_id
    FROM x LEFT JOIN m USING (old_id) LEFT JOIN c USING (old_id)""",
    "examples",
)
def id_remap(t: Tables):
    """Old ids of a log replaced by stable ones."""
    log, migration, content = _id_maps(t)
    historical = log.select("ord", F.col("old_id").alias("example_id"))
    return latency.remap_ids(historical, migration, content)


@query(
    "rerun_set",
    """SELECT example_id, db_id, 'SELECT ' || ord AS gold_sql FROM executions WHERE error_type = 'unsafe_sql'""",
    "executions",
)
def rerun_set(t: Tables):
    """The source rows of all runs that failed one way."""
    log = t.adapted("executions")
    source = log.select(
        "example_id", "db_id", F.concat(F.lit("SELECT "), "ord").alias("gold_sql")
    )
    return latency.rerun_of_failures(source, log.filter("not success"), "unsafe_sql")


@query(
    "rerun_database",
    "SELECT example_id, db_id FROM executions WHERE db_id = 'db-7'",
    "executions",
)
def rerun_database(t: Tables):
    """All source rows of one database."""
    source = t.adapted("executions").select("example_id", "db_id")
    return latency.rerun_of_database(source, "db-7")


@query(
    "escalation_set",
    """, e AS (SELECT example_id, duration_ms FROM executions WHERE timed_out),
    s AS (SELECT example_id, 'SELECT ' || ord AS gold_sql FROM executions WHERE k % 2 = 0)
    SELECT example_id, duration_ms, gold_sql, gold_sql IS NOT NULL AS matched FROM e LEFT JOIN s USING (example_id)""",
    "executions",
)
def escalation_set(t: Tables):
    """All timeouts with their SQL, some of which the source no longer has."""
    log = t.adapted("executions")
    residual = log.filter("timed_out").select("example_id", "duration_ms")
    source = log.filter("k % 2 = 0").select(
        "example_id", F.concat(F.lit("SELECT "), "ord").alias("gold_sql")
    )
    return latency.escalation_set(residual, source)


@query(
    "mcnemar",
    """, c AS (SELECT count(*) FILTER (a AND NOT b) AS b, count(*) FILTER (b AND NOT a) AS c, count(*) AS n FROM arms),
    k AS (SELECT *, b + c AS d, least(b, c) AS k FROM c)
    SELECT b, c, d AS discordant, n, round(CASE WHEN d = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(d + 1)
      - lgamma(i + 1) - lgamma(d - i + 1) - d * ln(2))) FROM (SELECT unnest(range(k + 1)) AS i))) END, 9) AS p_value FROM k""",
    "arms",
)
def mcnemar(t: Tables):
    """Exact paired test of two arms."""
    arms = t.adapted("arms")
    test = stats.mcnemar(
        arms.select("example_id", F.col("a").alias("correct")),
        arms.select("example_id", F.col("b").alias("correct")),
    )
    return test.withColumn("p_value", F.round("p_value", 9))


# The 32-bit hash of the draws, step by step.
_MIXED = """
  {0}1 AS (SELECT * REPLACE (xor(x, x >> 16) * 2146121005 & 4294967295 AS x) FROM {0}),
  {0}2 AS (SELECT * REPLACE (xor(x, x >> 15) * 2221713035 & 4294967295 AS x) FROM {0}1),
  {0}3 AS (SELECT * REPLACE (xor(x, x >> 16) AS x) FROM {0}2)"""


@query(
    "bootstrap_ci",
    f""", counted AS (SELECT (a::INT - b::INT)::DOUBLE AS value, count(*) AS n FROM arms
      WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1),
  drawn AS (SELECT range AS rep, (range * 2654435769 & 4294967295)::UBIGINT AS x FROM range(2000)),
  {_MIXED.format("drawn")},
  named AS (SELECT value, n, rep, xor(x, ('0x' || md5('0:' || value)[:8])::UBIGINT) AS x FROM drawn3, counted),
  {_MIXED.format("named")},
  chances AS (SELECT n, k, sum(exp(k * ln(n) - n - lgamma(k + 1))) OVER (PARTITION BY n ORDER BY k) AS reached
    FROM (SELECT n, unnest(range(greatest(0, floor(n - 12 * sqrt(n) - 20))::BIGINT, ceil(n + 12 * sqrt(n) + 20)::BIGINT + 1)) AS k
      FROM (SELECT DISTINCT n FROM counted))),
  taken AS (SELECT rep, value, min(k) AS k FROM named3 JOIN chances USING (n) WHERE reached >= (x + 0.5) / 4294967296 GROUP BY ALL),
  means AS (SELECT sum(k * value) / sum(k) AS mean FROM taken GROUP BY rep)
  SELECT round(any_value(m), 9) AS mean_difference, round(quantile_cont(mean, 0.025), 9) AS ci_low,
    round(quantile_cont(mean, 0.975), 9) AS ci_high, 2000::INTEGER AS n_bootstrap, 0.05::DOUBLE AS alpha, any_value(n)::BIGINT AS n_pairs
  FROM means, (SELECT sum(n) AS n, sum(n * value) / sum(n) AS m FROM counted)""",
    "arms",
)
def bootstrap_ci(t: Tables):
    """Bootstrap interval of the accuracy difference, draw by draw the same in both engines."""
    difference = F.col("a").cast("int") - F.col("b").cast("int")
    interval = stats.bootstrap_ci(t.adapted("arms").select(difference.alias("difference")))
    rounded = {c: F.round(c, 9) for c in ("mean_difference", "ci_low", "ci_high")}
    return interval.withColumns(rounded)


@query(
    "bootstrap_variants",
    """, d AS (SELECT a::INT - b::INT AS x FROM arms)
    SELECT method, count(x) AS n_pairs, round(avg(x), 9) AS mean_difference, true AS as_expected
    FROM d, (VALUES ('poisson'), ('multinomial')) m(method) GROUP BY method""",
    "arms",
)
def bootstrap_variants(t: Tables):
    """Both kinds of resampling; their intervals are those of the normal distribution, give or take a quarter."""
    differences = t.adapted("arms").select((F.col("a").cast("int") - F.col("b").cast("int")).alias("difference"))
    spread = differences.agg((F.stddev_pop("difference") / F.sqrt(F.count("difference"))).alias("error"))
    intervals = [
        stats.bootstrap_ci(differences, seed=7, method=m).withColumn("method", F.lit(m))
        for m in ("poisson", "multinomial")
    ]
    half = 1.96 * F.col("error")
    near = [
        F.abs(F.col("mean_difference") + sign * half - F.col(c)) <= half / 4
        for sign, c in ((-1, "ci_low"), (1, "ci_high"))
    ]
    both = intervals[0].unionByName(intervals[1]).withColumn("one", F.lit(1))
    return both.join(spread.withColumn("one", F.lit(1)), "one").select(
        "method", "n_pairs", F.round("mean_difference", 9).alias("mean_difference"), (near[0] & near[1]).alias("as_expected")
    )


@query(
    "bootstrap_mean",
    "SELECT round(avg(a::INT - b::INT), 9) AS mean_difference, count(*) AS n_pairs FROM arms",
    "arms",
)
def bootstrap_mean(t: Tables):
    """The part of the bootstrap that is not random."""
    difference = F.col("a").cast("int") - F.col("b").cast("int")
    interval = stats.bootstrap_ci(t.adapted("arms").select(difference.alias("difference")))
    return interval.select(F.round("mean_difference", 9).alias("mean_difference"), "n_pairs")
