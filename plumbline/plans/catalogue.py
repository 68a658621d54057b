"""The library's queries over the driver tables, each over its whole table, with the SQL it must agree with.

Adapters give a table the shape of recorded episodes:
  embeddings  an episode a label, in order of vec_id; action = dims 1 to 32, state = dims 33 to 64; 30 a second by vec_id
  events      an episode a user, in order of event_id; state = event type, action = bucket of the value; one each 12,000 s
Doubles are rounded to six places on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exact, sequential, vectors
from ..functions.intervals import two_sided, trials_needed, wilson
from ..operators import describe, hashing, jitter, lag, report, sequence
from ..operators.frames import frames
from ..sources import episodes as sources
from ..sources import layout, ledger

FLAGSHIP = "audit_report"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}
PERIOD = 12_000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(c: Column | str, name: str | None = None) -> Column:
    out = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return out.alias(name or c) if name or isinstance(c, str) else out


def embedding_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return frames(e, F.lit("embeddings"), F.col("label"), F.col("vec_id"), F.col("vec_id") / 30.0, F.col("vec_id"), F.slice("embedding", 1, 32), F.slice("embedding", 33, 32), F.lit(30.0))


def event_seconds() -> Column:
    return F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))") / 1e6


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    state = F.array(F.conv(F.substring(F.md5("event_type"), 1, 8), 16, 10).cast("double"))
    return frames(e, F.lit("events"), F.col("user_id"), F.col("event_id"), event_seconds(), F.col("event_id"), F.array(F.floor(F.col("value") / 25).cast("double")), state, F.lit(1 / PERIOD))


# SQL that several oracles share

EV = f"""
ev as (
  select user_id as ep, event_id as pos, epoch_us(ts) / 1e6::double as t, event_type as st, floor(value / 25) as ac,
         1 / (1 / {PERIOD}::double) as period
  from events
),
es as (
  select *, row_number() over w > 1 as pair, t - lag(t) over w as dt, pos - lag(pos) over w as step,
         coalesce(st = lag(st) over w, false) as stuck, coalesce(ac = lag(ac) over w, false) as held
  from ev window w as (partition by ep order by pos)
)"""

MF = """
mf as (
  select label as ep, vec_id as pos, vec_id / 30.0::double as t, embedding[1:32] as a, embedding[33:64] as s from embeddings where label is not null
),
ms as (
  select *, row_number() over w > 1 as pair, t - lag(t) over w as dt, pos - lag(pos) over w as step, coalesce(s = lag(s) over w, false) as stuck
  from mf window w as (partition by ep order by pos)
)"""


def xcorr_sql(a: str = "a", s: str = "s", source: str = "mf", dims: int = 32, p: str = "") -> str:
    return f"""
{p}cells as (
  select ep, pos, d, cast({a}[d] as double) as a, cast({s}[d] as double) as s,
         count(*) over (partition by ep, d) as n, row_number() over (partition by ep, d order by pos) as i
  from {source}, range(1, {dims + 1}) r(d)
),
{p}centred as (
  select ep, d, i, n, a - avg(a) over (partition by ep, d) as a, s - avg(s) over (partition by ep, d) as s from {p}cells where n >= 30
),
{p}scales as (select ep, d, (stddev_pop(a) + 1e-9::double) * (stddev_pop(s) + 1e-9::double) as scale from {p}centred group by ep, d),
{p}dims as (
  select x.ep, x.d, k, avg(x.a * y.s) as m
  from {p}centred x, range(-5, 11) ks(k), {p}centred y
  where y.ep = x.ep and y.d = x.d and y.i = x.i + k group by x.ep, x.d, k
),
{p}rs as (select m.ep, k, avg(m / scale) as r from {p}dims m join {p}scales c on m.ep = c.ep and m.d = c.d group by m.ep, k),
{p}best as (
  select ep, arg_max(k, (r, -k)) as lag, max(r) filter (k = 0) as r_lag0, max(r) as r_best from {p}rs group by ep
)"""


def wilson_sql(s: str, n: str, z: float = two_sided(0.05)) -> tuple[str, str]:
    s, n, z2 = f"({s})::double", f"({n})::double", f"{z * z!r}::double"
    centre = f"(({s} / {n} + {z2} / (2 * {n})) / (1 + {z2} / {n}))"
    half = f"({z!r}::double * sqrt({s} / {n} * (1 - {s} / {n}) / {n} + {z2} / (4 * {n} * {n})) / (1 + {z2} / {n}))"
    return f"greatest(0.0::double, {centre} - {half})", f"least(1.0::double, {centre} + {half})"


# -- lag -----------------------------------------------------------------------------------------------------------


@query(f"with {MF}, {xcorr_sql()} select cast(ep as bigint) as episode, cast(lag as bigint) as lag, round(r_lag0, 6) as r_lag0, round(r_best, 6) as r_best from best")
def xcorr_lag_by_episode(spark, sf_dir):
    return lag.best_lag(embedding_frames(spark, sf_dir)).select("episode", F.col("lag").cast("bigint").alias("lag"), r6("r_lag0"), r6("r_best"))


@query(f"with {MF}, {xcorr_sql('s', 'a')} select cast(ep as bigint) as episode, cast(lag as bigint) as lag, round(r_lag0, 6) as r_lag0, round(r_best, 6) as r_best from best")
def xcorr_swapped(spark, sf_dir):
    return lag.best_lag(embedding_frames(spark, sf_dir), swapped=True).select("episode", F.col("lag").cast("bigint").alias("lag"), r6("r_lag0"), r6("r_best"))


@query(f"with {MF}, {xcorr_sql()} select cast(ep as bigint) as episode, cast(k as bigint) as lag, round(r, 6) as r from rs")
def xcorr_scores(spark, sf_dir):
    return lag.scores(embedding_frames(spark, sf_dir)).select("episode", F.col("lag").cast("bigint").alias("lag"), r6("r"))


@query(
    f"""with {MF}, {xcorr_sql()}, pooled as (select median(lag) as lag_frames, avg(r_lag0) as r_lag0, avg(r_best) as r_best from best)
select 'embeddings' as dataset, lag_frames::double as lag_frames, round(r_lag0, 6) as r_lag0, round(r_best, 6) as r_best,
       abs(r_best) >= 0.5 as gated, case when abs(r_best) >= 0.5 and lag_frames < 0 then 'negative_lag' when abs(r_best) >= 0.5 and lag_frames >= 3 then 'large_lag' else '' end as flag
from pooled"""
)
def lag_report(spark, sf_dir):
    got = report.lags(embedding_frames(spark, sf_dir))
    gated = F.abs(F.col("r_best")) >= 0.5
    flag = F.concat_ws("|", *[F.when(report.FLAGS[n].rule(report.DEFAULTS), n) for n in ("negative_lag", "large_lag")])
    return got.select("dataset", F.col("lag_frames").cast("double").alias("lag_frames"), r6("r_lag0"), r6("r_best"), gated.alias("gated"), flag.alias("flag"))


# -- steps ---------------------------------------------------------------------------------------------------------


@query(
    """with x as (select label, list_transform(embedding, lambda v: v::double) as a, list_transform(embedding, lambda v: round(v::double, 4)) as s from embeddings)
select cast(label as bigint) as episode, cast(count(*) as bigint) as n,
       cast(count(*) filter (len(list_filter(range(1, len(a) + 1), lambda i: not (a[i] = s[i] or abs(a[i] - s[i]) <= 1e-5::double * abs(s[i])))) = 0) as bigint) as identical
from x group by label"""
)
def identity_counts(spark, sf_dir):
    """Frames that equal their copy rounded to four places, within the tolerance."""
    e = table(spark, sf_dir, "embeddings")
    v = vectors.widen(F.col("embedding"))
    f = frames(e, F.lit("embeddings"), F.col("label"), F.col("vec_id"), action=v, state=F.transform(v, lambda x: F.round(x, 4)))
    return sequence.episodes(f).select("episode", F.col("n_identical").alias("n"), F.col("identical"))


@query(f"with {EV} select cast(ep as bigint) as episode, round(count(*) filter (pair and stuck) / nullif(count(*) filter (pair), 0)::double, 6) as stuck_state_frac, round(count(*) filter (pair and stuck and not held) / nullif(count(*) filter (pair), 0)::double, 6) as stuck_while_commanded from es group by ep")
def stuck_by_episode(spark, sf_dir):
    return sequence.per_episode(event_frames(spark, sf_dir)).select("episode", r6("stuck_state_frac"), r6("stuck_while_commanded"))


@query(f"with {EV} select 'events' as dataset, round(count(*) filter (pair and stuck and not held) / count(*) filter (pair)::double, 6) as stuck_while_commanded from es")
def stuck_while_commanded(spark, sf_dir):
    return report.pooled(event_frames(spark, sf_dir)).select("dataset", r6("stuck_while_commanded"))


@query(
    f"""with {EV}, isl as (select *, row_number() over (partition by ep order by pos) - row_number() over (partition by ep, stuck order by pos) as g from es where pair),
runs as (select ep, g, count(*) as n from isl where stuck group by ep, g)
select 'events' as dataset, cast(count(*) as bigint) as n_runs, median(n)::double as median_run, cast(max(n) as bigint) as longest_run, cast(count(*) filter (n = 1) as bigint) as single_runs from runs"""
)
def stuck_runs(spark, sf_dir):
    return sequence.stuck_runs(event_frames(spark, sf_dir)).withColumn("median_run", F.col("median_run").cast("double"))


@query(
    f"""with {EV}, p as (select avg(held::int) as h, avg(held::int) filter (stuck) as hs, avg(held::int) filter (not stuck) as hm from es where pair)
select 'events' as dataset, round(h, 6) as p_held, round(hs, 6) as p_held_stuck, round(hm, 6) as p_held_moving, round(hs / hm, 6) as ratio from p"""
)
def cofreeze(spark, sf_dir):
    return sequence.cofreeze(event_frames(spark, sf_dir)).select("dataset", *[r6(c) for c in ("p_held", "p_held_stuck", "p_held_moving", "ratio")])


@query(f"with {EV} select 'events' as dataset, round(count(*) filter (pair and abs(dt - period) > 0.25 * period) / count(*) filter (pair)::double, 6) as frac_bad_dt from es")
def bad_dt_pooled(spark, sf_dir):
    return report.pooled(event_frames(spark, sf_dir)).select("dataset", r6("frac_bad_dt"))


@query(
    f"""with {EV}, e as (select ep, count(*) filter (pair and abs(dt - period) > 0.25 * period) as b, count(*) filter (pair) as n from es group by ep)
select 'events' as dataset, round(sum(b) / sum(n)::double, 6) as pooled, round(avg(b / nullif(n, 0)::double), 6) as mean_of_ratios from e"""
)
def pooled_vs_mean_of_ratios(spark, sf_dir):
    e = sequence.episodes(event_frames(spark, sf_dir))
    return e.groupBy("dataset").agg(r6(F.sum("bad_dt") / F.sum("n_dt"), "pooled"), r6(F.avg(sequence.ratio("bad_dt", "n_dt")), "mean_of_ratios"))


@query(f"with {EV} select cast(ep as bigint) as episode, cast(coalesce(bool_or(pair and dt <= 0), false) as bigint) as ts_nonmonotonic, cast(coalesce(bool_or(pair and step <> 1), false) as bigint) as frame_gap from es group by ep")
def sequence_flags_by_episode(spark, sf_dir):
    return sequence.per_episode(event_frames(spark, sf_dir)).select("episode", F.col("ts_nonmonotonic").cast("bigint").alias("ts_nonmonotonic"), F.col("frame_gap").cast("bigint").alias("frame_gap"))


@query(f"with {EV} select 'events' as dataset, round(mad(dt) * (1 / {PERIOD}::double), 6) as dt_jitter_ratio from es where pair")
def dt_jitter_mad(spark, sf_dir):
    return sequence.jitter(event_frames(spark, sf_dir)).select("dataset", r6("dt_jitter_ratio"))


@query("select conv_id as episode, coalesce(bool_or(turn - prev <> 1), false) as frame_gap from (select conv_id, turn, lag(turn) over (partition by conv_id order by turn) as prev from conversations) group by conv_id")
def frame_gap_conversations(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return sequence.episodes(frames(c, F.lit("conversations"), F.col("conv_id"), F.col("turn"), frame_index=F.col("turn"))).select("episode", "frame_gap")


@query("with l as (select distinct l_orderkey, l_linenumber from lineitem) select l_orderkey as episode, coalesce(bool_or(l_linenumber - prev <> 1), false) as frame_gap from (select *, lag(l_linenumber) over (partition by l_orderkey order by l_linenumber) as prev from l) group by l_orderkey")
def frame_gap_orders(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return sequence.episodes(frames(lines, F.lit("lineitem"), F.col("l_orderkey"), F.col("l_linenumber"), frame_index=F.col("l_linenumber"))).select("episode", "frame_gap")


@query("select o_custkey as episode, coalesce(bool_or(epoch_us(o_orderdate) <= prev), false) as ts_nonmonotonic from (select *, lag(epoch_us(o_orderdate)) over (partition by o_custkey order by o_orderkey) as prev from orders) group by o_custkey")
def date_nonmonotonic(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    seconds = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(o_orderdate as timestamp_ntz))") / 1e6
    return sequence.episodes(frames(o, F.lit("orders"), F.col("o_custkey"), F.col("o_orderkey"), ts=seconds)).select("episode", "ts_nonmonotonic")


@query("select event_type, cast(count(*) as bigint) as kept from (select event_type, value, lag(floor(value / 25)) over w as p, row_number() over w as n from events window w as (partition by event_type order by event_id)) where n = 1 or p is distinct from floor(value / 25) group by event_type")
def consecutive_changes(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("bucket", F.floor(F.col("value") / 25))
    return sequence.changes(e.select("event_type", "event_id", "bucket"), ["event_type"], "event_id", "bucket").groupBy("event_type").agg(F.count("*").alias("kept"))


# -- hashes and samples --------------------------------------------------------------------------------------------


@query("select lang, cast(count(text) as bigint) as n, cast(count(distinct md5(text)) as bigint) as kinds, round(1 - count(distinct md5(text)) / count(text)::double, 6) as dup_frac from documents where text is not null group by lang")
def duplicate_frac(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.md5("text").alias("hash"))
    return hashing.duplicate_share(d, ["lang"]).select("lang", "n", "kinds", r6("dup_frac"))


def _paired_episodes(spark, sf_dir):
    """Every episode of the embeddings twice, as two files; in the second, odd labels are turned back to front."""
    e = table(spark, sf_dir, "embeddings")
    both = e.withColumn("part", F.explode(F.array(F.lit("a"), F.lit("b"))))
    pos = F.when((F.col("part") == "b") & (F.col("label") % 2 == 1), -F.col("vec_id")).otherwise(F.col("vec_id"))
    return frames(both, F.lit("embeddings"), F.col("label"), pos, action=F.col("embedding"), file=F.col("part"))


_TWICE = """
p as (select unnest(['a', 'b']) as part), x as (select part, label, case when part = 'b' and label % 2 = 1 then -vec_id else vec_id end as pos,
  list_transform(embedding, lambda v: round_even(v::double * 1e4, 0)) as a from embeddings, p where label is not null)"""


@query(f"with {_TWICE}, h as (select part, label, count(*) || ':' || string_agg(a::varchar, ';' order by pos) as h from x group by part, label) select 'embeddings' as dataset, cast(count(*) as bigint) as n, cast(count(distinct h) as bigint) as kinds, round(1 - count(distinct h) / count(*)::double, 6) as dup_frac from h")
def duplicate_episodes_vectors(spark, sf_dir):
    h = hashing.episode_hashes(_paired_episodes(spark, sf_dir))
    return hashing.duplicate_share(h, ["dataset"]).select("dataset", "n", "kinds", r6("dup_frac"))


@query(f"with {_TWICE}, f as (select *, row_number() over (partition by part, label order by pos) as i from x), h as (select part, label, string_agg(a::varchar, ';' order by pos) filter (i <= 50) as h from f group by part, label) select 'embeddings' as dataset, cast(count(*) as bigint) as n, cast(count(distinct h) as bigint) as kinds, round(1 - count(distinct h) / count(*)::double, 6) as dup_frac from h")
def head_hash(spark, sf_dir):
    h = hashing.episode_hashes(_paired_episodes(spark, sf_dir), head=50)
    return hashing.duplicate_share(h, ["dataset"]).select("dataset", "n", "kinds", r6("dup_frac"))


@query()
def sample_hash_rank(spark, sf_dir):
    """No oracle: DuckDB has no such hash. tests/test_checks.py holds the ranks against the standard library."""
    return hashing.sample(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id")), "id", 100, 20260905)


@query("select id, md5('20260905:' || id) as rank from (select distinct cast(c_custkey as varchar) as id from customer) order by rank, id limit 100")
def sample_md5_rank(spark, sf_dir):
    return hashing.sample(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id")), "id", 100, 20260905, "md5")


@query("select cast(count(*) as bigint) as n, sha256(string_agg(id, chr(10) order by id)) as sha256 from (select distinct cast(doc_id as varchar) as id from documents)")
def frame_fingerprint(spark, sf_dir):
    return hashing.fingerprint(table(spark, sf_dir, "documents"), "doc_id")


@query(
    """with s as (select id, row_number() over (order by md5('7:' || id), id) as n from (select distinct cast(c_custkey as varchar) as id from customer))
select cast(count(*) filter (n <= 50) as bigint) as small, cast(count(*) filter (n <= 120) as bigint) as large, cast(count(*) filter (n <= 50) as bigint) as shared from s"""
)
def sample_nesting(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    small, large = (hashing.sample(ids, "id", n, 7, "md5").select("id") for n in (50, 120))
    one = lambda d, n: d.agg(F.count("*").alias(n))
    return one(small, "small").crossJoin(one(large, "large")).crossJoin(one(small.intersect(large), "shared"))


# -- the report ----------------------------------------------------------------------------------------------------

_REPORT_SQL = f"""with {EV}, {MF}, {xcorr_sql()},
ex as (select user_id as ep, event_id as pos, [floor(value / 25)::double] as a, [cast(('0x' || substr(md5(event_type), 1, 8)) as bigint)::double] as s from events),
{xcorr_sql(source="ex", dims=1, p="e")},
ej as (select dt from es where pair), mj as (select dt from ms where pair),
lagged as (
  select 'embeddings' as of_dataset, median(lag)::double as lag_frames, avg(r_lag0) as r_lag0, avg(r_best) as r_best from best
  union all select 'events', median(lag)::double, avg(r_lag0), avg(r_best) from ebest
),
eh as (select ep, count(*) || ':' || string_agg(ac::varchar, ';' order by pos) as h from ev group by ep),
mh as (select ep, count(*) || ':' || string_agg(list_transform(a, lambda v: round_even(v::double * 1e4, 0))::varchar, ';' order by pos) as h from mf group by ep),
rows as (
  select 'events' as dataset, cast(count(distinct ep) as bigint) as episodes_sampled, cast(count(*) as bigint) as frames_sampled,
    cast(count(distinct ep) filter (pair and dt <= 0) as bigint) as ts_nonmonotonic_eps,
    count(*) filter (pair and abs(dt - period) > 0.25 * period) / count(*) filter (pair)::double as frac_bad_dt,
    (select mad(dt) from ej) * (1 / {PERIOD}::double) as dt_jitter_ratio,
    cast(count(distinct ep) filter (pair and step <> 1) as bigint) as frame_gap_eps,
    count(*) filter (pair and stuck) / count(*) filter (pair)::double as stuck_state_frac,
    (select count(*) filter (a[1] = s[1] or abs(a[1] - s[1]) <= 1e-5::double * abs(s[1])) / count(*)::double from ex) as identity_frac, (select 1 - count(distinct h) / count(*)::double from eh) as dup_episode_frac
  from es
  union all
  select 'embeddings', count(distinct ep), count(*), count(distinct ep) filter (pair and dt <= 0),
    count(*) filter (pair and abs(dt - 1 / 30.0::double) > 0.25 * (1 / 30.0::double)) / count(*) filter (pair)::double,
    (select mad(dt) from mj) * 30.0, count(distinct ep) filter (pair and step <> 1), count(*) filter (pair and stuck) / count(*) filter (pair)::double,
    count(*) filter (len(list_filter(range(1, 33), lambda i: not (a[i]::double = s[i]::double or abs(a[i]::double - s[i]::double) <= 1e-5::double * abs(s[i]::double)))) = 0) / count(*)::double,
    (select 1 - count(distinct h) / count(*)::double from mh)
  from ms
),
joined as (select rows.*, lag_frames, r_lag0, r_best from rows left join lagged on dataset = of_dataset)
select dataset, episodes_sampled, frames_sampled, ts_nonmonotonic_eps, round(frac_bad_dt, 6) as frac_bad_dt, round(dt_jitter_ratio, 6) as dt_jitter_ratio,
  frame_gap_eps, round(stuck_state_frac, 6) as stuck_state_frac, round(identity_frac, 6) as identity_frac, lag_frames, round(r_lag0, 6) as r_lag0, round(r_best, 6) as r_best,
  round(dup_episode_frac, 6) as dup_episode_frac,
  concat_ws('|', case when ts_nonmonotonic_eps > 0 then 'ts_nonmonotonic' end, case when frac_bad_dt > 0.05 then 'bad_dt' end, case when frame_gap_eps > 0 then 'frame_gaps' end,
    case when stuck_state_frac > 0.2 then 'stuck_state' end, case when identity_frac > 0.5 then 'action_equals_state' end,
    case when abs(r_best) >= 0.5 and lag_frames < 0 then 'negative_lag' end, case when abs(r_best) >= 0.5 and lag_frames >= 3 then 'large_lag' end,
    case when dup_episode_frac > 0 then 'duplicate_episodes' end) as flags
from joined"""


@query(_REPORT_SQL)
def audit_report(spark, sf_dir):
    """Both tables in their plain form; a measure that could not be taken is null."""
    got = report.report(embedding_frames(spark, sf_dir).unionByName(event_frames(spark, sf_dir)))
    doubles = ("frac_bad_dt", "dt_jitter_ratio", "stuck_state_frac", "identity_frac", "r_lag0", "r_best", "dup_episode_frac")
    return got.select("dataset", "episodes_sampled", "frames_sampled", "ts_nonmonotonic_eps", "frame_gap_eps", F.col("lag_frames").cast("double").alias("lag_frames"), *[r6(c) for c in doubles], "flags")


def _user_reports(spark, sf_dir):
    """Every user's events as a dataset of their own."""
    return report.pooled(event_frames(spark, sf_dir).withColumn("dataset", F.col("episode").cast("string"))).withColumn("flags", F.concat_ws("|", *[F.when(report.FLAGS[n].rule(report.DEFAULTS), n) for n in ("bad_dt", "frame_gaps", "stuck_state")]))


@query(
    f"""with {EV}, u as (select ep, count(*) filter (pair and stuck) / nullif(count(*) filter (pair), 0)::double as s from es group by ep), c as (select count(*) filter (s > 0.2) as k, count(*) as n from u)
select 'stuck_state' as flag, cast(k as bigint) as successes, cast(n as bigint) as n, round(k / n::double, 6) as rate, round({wilson_sql('k', 'n')[0]}, 6) as lo, round({wilson_sql('k', 'n')[1]}, 6) as hi from c"""
)
def prevalence_by_flag(spark, sf_dir):
    p = describe.prevalence(_user_reports(spark, sf_dir), "stuck_state")
    return p.select(F.lit("stuck_state").alias("flag"), "successes", "n", r6("rate"), r6("lo"), r6("hi"))


@query(
    """with f as (select * from embeddings where label = (select min(label) from embeddings) order by vec_id limit 1)
select 'embeddings' as dataset, cast(32 as bigint) as action_dims, (select count(*) from embeddings where label is not null) as n_frames,
  (select count(*) from embeddings where embedding[1:32] = embedding[33:64]) as n_identical, false as narrow,
  list_aggregate(list_transform(embedding[1:6], lambda v: printf('%.5f', v::double)), 'string_agg', ' ') as first_action from f"""
)
def evidence_preview(spark, sf_dir):
    e = report.evidence(embedding_frames(spark, sf_dir))
    return e.select("dataset", F.col("action_dims").cast("bigint").alias("action_dims"), "n_frames", "n_identical", "narrow", F.col("preview")[0]["action"].alias("first_action"))


# -- description ---------------------------------------------------------------------------------------------------


@query(f"with c as (select lang, count(*) filter (quality = 1) as k, count(*) as n from documents join labels using (doc_id) group by lang) select lang, cast(k as bigint) as successes, cast(n as bigint) as n, round(k / n::double, 6) as rate, round({wilson_sql('k', 'n')[0]}, 6) as lo, round({wilson_sql('k', 'n')[1]}, 6) as hi from c")
def wilson_by_lang(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return describe.share(d, F.col("quality") == 1, ["lang"]).select("lang", "successes", "n", r6("rate"), r6("lo"), r6("hi"))


def _counts_sql(column: str, name: str) -> str:
    lo, hi = wilson_sql("n", "t")
    return f"with c as (select {column} as value, count(*) as n, sum(count(*)) over () as t from {name} group by 1) select value, cast(n as bigint) as n, round(n / t::double, 6) as rate, round({lo}, 6) as lo, round({hi}, 6) as hi from c"


@query(_counts_sql("event_type", "events"))
def value_counts_wilson(spark, sf_dir):
    return describe.value_counts(table(spark, sf_dir, "events"), "event_type").select("value", "n", r6("rate"), r6("lo"), r6("hi"))


@query(_counts_sql("o_orderpriority", "orders"))
def value_counts_orders(spark, sf_dir):
    return describe.value_counts(table(spark, sf_dir, "orders"), "o_orderpriority").select("value", "n", r6("rate"), r6("lo"), r6("hi"))


@query("with c as (select o_custkey, count(*) as n from orders group by 1), l as (select list_sort(list(n)) as x from c) select cast(len(x) as bigint) as n, cast(x[least(len(x), floor(0.5 * len(x))::bigint + 1)] as bigint) as p50, cast(x[least(len(x), floor(0.9 * len(x))::bigint + 1)] as bigint) as p90, cast(x[len(x)] as bigint) as largest from l")
def order_stats(spark, sf_dir):
    c = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"))
    return describe.order_statistics(c, "orders")


@query(f"with c as (select count(*) filter (l.doc_id is null) as k, count(*) as n from documents d left join labels l using (doc_id) where length(d.text) < 500) select cast(k as bigint) as successes, cast(n as bigint) as n, round(k / n::double, 6) as rate, round({wilson_sql('k', 'n')[0]}, 6) as lo, round({wilson_sql('k', 'n')[1]}, 6) as hi from c")
def zero_share_conditional(spark, sf_dir):
    """Share of documents without a label among short ones."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.char_length("text").alias("size"))
    marked = d.select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("has")), "doc_id", "left")
    return describe.conditional(d, marked, "doc_id", F.col("size") < 500, F.col("has").isNull()).select("successes", "n", r6("rate"), r6("lo"), r6("hi"))


@query("select cast(count(*) as bigint) as kinds, cast(count(*) filter (n > 1) as bigint) as repeated from (select text, count(*) as n from documents group by text)")
def repeated_texts(spark, sf_dir):
    return describe.repeated(table(spark, sf_dir, "documents").select(F.md5("text").alias("h")), "h")


@query("select cast(o_orderkey as varchar) as repo, o_orderstatus as revision from orders o where not exists (select 1 from orders d where d.o_orderkey = o.o_orderkey and d.o_orderpriority like '1%' and d.o_orderstatus = o.o_orderstatus)")
def resume_anti_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("repo"), F.col("o_orderstatus").alias("revision"), "o_orderpriority")
    return ledger.still_to_do(o.select("repo", "revision"), o.where("o_orderpriority like '1%'"))


@query("select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 20")
def top_n(spark, sf_dir):
    return sources.top(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 20, "p_partkey")


_LISTING = "select o_orderpriority as dataset, printf('data/chunk-%03d/file-%06d.parquet', (o_orderkey % 3)::bigint, o_orderkey) as path, floor(o_totalprice * 10)::bigint as size from orders"


@query(f"with l as ({_LISTING}), c as (select *, regexp_extract(path, '^(data/[^/]+)/', 1) as chunk from l), f as (select *, min(chunk) over (partition by dataset) as first from c), k as (select *, row_number() over (partition by dataset order by path) as nth from f where chunk = first and size <= 2000000) select dataset, path, size, cast(nth as bigint) as nth from k where nth <= 25")
def file_limit(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    path = F.format_string("data/chunk-%03d/file-%06d.parquet", F.col("o_orderkey") % 3, F.col("o_orderkey"))
    listing = o.select(F.col("o_orderpriority").alias("dataset"), path.alias("path"), F.floor(F.col("o_totalprice") * 10).alias("size"))
    return sources.tree_sample(listing, None, 2.0).withColumn("nth", F.col("nth").cast("bigint"))


# -- layouts -------------------------------------------------------------------------------------------------------

_INFOS = [
    ("per_episode", "data/chunk-{episode_chunk:03d}/episode_{episode_index:06d}.parquet", 1000, 2500, None),
    ("packed", "data/chunk-{chunk_index:03d}/file-{file_index:03d}.parquet", 1000, 50, None),
    ("sharded", "data/shard-{shard_id:05d}-of-{num_shards:05d}.parquet", 0, 10, 64),
    ("other", "data/jaco_play.tsfile", None, None, None),
]


def _infos(spark, sf_dir):
    """One dataset for each region and layout, the number of episodes moved by the region's key."""
    known = spark.createDataFrame(_INFOS, "kind string, data_path string, chunks_size long, total_episodes long, num_shards long")
    r = table(spark, sf_dir, "region")
    return known.crossJoin(r).select(F.concat_ws("/", "r_name", "kind").alias("dataset"), "data_path", "chunks_size", (F.col("total_episodes") + F.col("r_regionkey")).alias("total_episodes"), "num_shards")


_INFOS_SQL = """i as (select r_name || '/' || kind as dataset, kind, n + r_regionkey as n, shards from region,
  (values ('per_episode', 2500, null), ('packed', 50, null), ('sharded', 10, 64), ('other', null, null)) v(kind, n, shards))"""


@query(f"with {_INFOS_SQL} select dataset, case when kind <> 'other' then kind else '' end as family, cast(case kind when 'per_episode' then n when 'sharded' then shards else -1 end as bigint) as files from i")
def layout_family(spark, sf_dir):
    family = layout.layout_family(F.col("data_path"))
    return _infos(spark, sf_dir).select("dataset", family.alias("family"), layout.file_count(family, F.col("total_episodes"), F.col("num_shards")).alias("files")).fillna(-1, ["files"]).fillna("", ["family"])


@query(
    f"""with {_INFOS_SQL}, c as (select *, case kind when 'per_episode' then n when 'sharded' then shards when 'packed' then 1 else 0 end as files from i),
e as (select dataset, kind, shards, unnest(range(0, files)) as p from c)
select dataset, cast(p as bigint) as place, case kind when 'per_episode' then printf('data/chunk-%03d/episode_%06d.parquet', p // 1000, p) when 'packed' then printf('data/chunk-%03d/file-%03d.parquet', 0, p)
  else printf('data/shard-%05d-of-%05d.parquet', p, shards::bigint) end as path from e"""
)
def derive_paths(spark, sf_dir):
    return layout.derive_paths(_infos(spark, sf_dir))


@query(f"with {_INFOS_SQL} select dataset, cast(p as bigint) as place, printf('data/chunk-%03d/file-%03d.parquet', 0, p) as path from i, range(0, 7) r(p) where kind = 'packed' and p < 3 + length(split_part(dataset, '/', 1)) % 3")
def derive_paths_to_first_gap(spark, sf_dir):
    """Packed datasets with listings that lack one file in the middle."""
    infos = _infos(spark, sf_dir).where("dataset like '%/packed'")
    gap = 3 + F.char_length(F.split("dataset", "/")[0]) % 3
    listing = infos.select("dataset", gap.alias("gap"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("f")).where("f <> gap").select("dataset", F.format_string("data/chunk-000/file-%03d.parquet", "f").alias("path"))
    return layout.derive_paths(infos, listing=listing)


@query("select k as feature, cast(count(*) as bigint) as n from (select unnest(json_keys(props::json)) as k from events) group by k")
def feature_schema(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.explode(F.map_keys(F.from_json("props", "map<string, string>"))).alias("feature"))
    return e.groupBy("feature").agg(F.count("*").alias("n"))


# -- statistics ----------------------------------------------------------------------------------------------------


def _cs_sql(s: str, t: str, alpha: float) -> str:
    """List of grid points inside the sequence."""
    import math

    beta = f"(lgamma({s} + 1.0::double) + lgamma({t} - {s} + 1.0::double) - lgamma({t} + 2.0::double))"
    return f"list_filter(list_transform(range(0, 2001), lambda i: 1e-6::double + i * {(1 - 2e-6) / 2000!r}::double), lambda p: {beta} - ({s} * ln(p) + ({t} - {s}) * ln(1 - p)) < {math.log(1 / alpha)!r}::double)"


_LANG = "c as (select lang, (count(*) filter (quality = 1))::double as s, count(*)::double as t from documents join labels using (doc_id) group by lang)"


@query(f"with {_LANG}, g as (select lang, s, t, {_cs_sql('s', 't', 0.05)} as x from c) select lang, cast(s as bigint) as s, cast(t as bigint) as t, round(x[1], 6) as lo, round(x[len(x)], 6) as hi from g")
def anytime_cs_by_lang(spark, sf_dir):
    return sequential.sequences(_judged(spark, sf_dir), "lang", "quality").select("lang", "s", "t", r6("lo"), r6("hi"))


def _judged(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")


@query(
    f"""with r as (select lang, doc_id, (sum(quality) over w)::double as s, (count(*) over w)::double as t from documents join labels using (doc_id) window w as (partition by lang order by doc_id)),
u as (select s, t, {_cs_sql('s', 't', 0.05)} as x from (select distinct s, t from r))
select lang, doc_id, cast(r.s as bigint) as s, cast(r.t as bigint) as t, round(x[1], 6) as lo, round(x[len(x)], 6) as hi from r join u on r.s = u.s and r.t = u.t"""
)
def anytime_cs_running(spark, sf_dir):
    return sequential.running(_judged(spark, sf_dir), "lang", "doc_id", "quality").select("lang", "doc_id", "s", "t", r6("lo"), r6("hi"))


def _pairs(spark, sf_dir):
    c = sequential.arms(_judged(spark, sf_dir), "lang", "quality")
    a = c.select(F.col("lang").alias("a"), F.col("s").alias("sa"), F.col("t").alias("ta"))
    return a.join(c.select(F.col("lang").alias("b"), F.col("s").alias("sb"), F.col("t").alias("tb")), F.col("a") < F.col("b"))


@query(
    f"""with {_LANG}, g as (select lang, s, t, {_cs_sql('s', 't', 0.025)} as x from c), b as (select lang, s, t, x[1] as lo, x[len(x)] as hi from g)
select p.lang as a, q.lang as b, round(p.s / p.t, 6) as rate_a, round(q.s / q.t, 6) as rate_b, case when p.lo > q.hi then 'A>B' when q.lo > p.hi then 'B>A' else 'continue' end as decision from b p join b q on p.lang < q.lang"""
)
def sequential_compare_langs(spark, sf_dir):
    return sequential.compare(_pairs(spark, sf_dir)).select("a", "b", r6("rate_a"), r6("rate_b"), "decision")


_ZA, _ZB = two_sided(0.1), two_sided(0.4)


@query(
    f"""with {_LANG}, p as (select x.lang as a, y.lang as b, x.s / x.t as p, y.s / y.t as q from c x join c y on x.lang < y.lang)
select a, b, case when p > 0 and p < 1 and q > 0 and q < 1 and p <> q then cast(ceil(pow({_ZA!r}::double * sqrt(2 * ((p + q) / 2) * (1 - (p + q) / 2)) + {_ZB!r}::double * sqrt(p * (1 - p) + q * (1 - q)), 2) / pow(p - q, 2)) as bigint) end as trials from p"""
)
def trials_needed_grid(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return p.select("a", "b", trials_needed(F.col("sa") / F.col("ta"), F.col("sb") / F.col("tb")).cast("bigint").alias("trials"))


@query(f"with g as (select unnest(range(0, 51)) as s) select cast(s as bigint) as s, cast(50 as bigint) as n, round({wilson_sql('s', '50')[0]}, 6) as lo, round({wilson_sql('s', '50')[1]}, 6) as hi from g")
def wilson_grid(spark, sf_dir):
    g = spark.range(0, 51).select(F.col("id").alias("s"), F.lit(50).cast("bigint").alias("n"))
    w = wilson(F.col("s"), F.col("n"))
    return g.select("s", "n", r6(w["lo"], "lo"), r6(w["hi"], "hi"))


@query()
def barnard_langs(spark, sf_dir):
    """No oracle: the tail is maximised over the nuisance rate. tests/test_statistics.py has brute force and vectors."""
    p = _pairs(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism)  # few rows, each of seconds of work
    cols = [F.col(c) for c in ("sa", "ta", "sb", "tb")]
    return p.select("a", "b", r6(exact.barnard_column(*cols), "p_greater"), r6(exact.barnard_column(*cols, alternative="two-sided", margins="arms"), "p_two_sided_arms"))


@query()
def bootstrap_diff(spark, sf_dir):
    """No oracle: the numbers are those of one generator's draws. tests/test_statistics.py has brute force."""
    j = _judged(spark, sf_dir)
    langs = j.select("lang").where("lang is not null").distinct()
    pairs = langs.select(F.col("lang").alias("a")).join(langs.select(F.col("lang").alias("b")), F.col("a") < F.col("b"))
    side = j.join(F.broadcast(pairs), (F.col("lang") == F.col("a")) | (F.col("lang") == F.col("b")))  # a row for each pair of languages
    sides = side.select(F.concat_ws("-", "a", "b").alias("pair"), F.when(F.col("lang") == F.col("a"), "a").otherwise("b").alias("side"), "doc_id", "quality")
    return exact.bootstrap_pairs(sides, "pair", "side", "doc_id", "quality").select("pair", "n_a", "n_b", r6("lo"), r6("hi"))


@query(
    """with g as (select event_type, floor(value)::bigint as v, event_id from events),
c as (select *, lag(v) over w as p, row_number() over w as n from g window w as (partition by event_type order by event_id)),
k as (select * from c where n = 1 or p <> v), d as (select *, abs((v - lag(v) over (partition by event_type order by event_id)) - 100000.0::double) as off from k)
select event_type, cast(count(*) as bigint) as samples, round(quantile_cont(off, 0.5), 6) as p50, round(quantile_cont(off, 0.99), 6) as p99, round(quantile_cont(off, 0.999), 6) as p999 from d group by event_type"""
)
def jitter_percentiles(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", "event_id", F.floor("value").alias("stamp"))
    return jitter.stream_jitter(e, ["event_type"], "event_id", "stamp", 10.0).select("event_type", "samples", *[r6(c) for c in ("p50", "p99", "p999")])


@query("select vec_id, round(list_sum(list_transform(range(1, 33), lambda i: embedding[i]::double + greatest(least(embedding[i + 32]::double - embedding[i]::double, 0.05::double), -0.05::double))), 6) as total from embeddings")
def clamp_step(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    now, target = vectors.widen(F.slice("embedding", 1, 32)), vectors.widen(F.slice("embedding", 33, 32))
    return e.select("vec_id", r6(F.aggregate(vectors.clamp_step(now, target, 0.05), F.lit(0.0), lambda a, x: a + x), "total"))


@query("select vec_id, sqrt(embedding[1]::double ** 2 + embedding[2]::double ** 2 + embedding[3]::double ** 2) > 0.2::double as over, round(least(greatest(embedding[1]::double, 0.0::double), 1.0::double), 6) as clipped from embeddings")
def force_norm(spark, sf_dir):
    v = vectors.widen(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", (vectors.norm(v) > 0.2).alias("over"), r6(vectors.clip_unit(F.get(v, F.lit(0))), "clipped"))
