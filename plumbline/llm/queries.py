"""Queries and SQL of this subpackage: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Scratch, remainder, table
from .decontaminate import report
from .licenses import scan_licenses
from .linededup import drop_repeated_lines
from .lm import language_scores
from .mixing import mix
from .neardup import near_duplicates
from .pii import pseudonymise
from .quality import quality_scores
from .tokens import read_tokens, write_tokens
from .vectors import near_vectors

#: The setting of the session that holds the key, and the key of sessions without it, with which reruns agree.
PII_SETTING, PII_KEY = "spark.plumbline.pii.key", "rotate-me-1"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get(PII_SETTING, PII_KEY))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), Scratch(spark, "mix")).drop("copies")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_lines(table(spark, sf_dir, "documents"), Scratch(spark, "lines"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_pii, op5_mixing, op9_line_dedup)}

ORACLE: dict[str, str] = {}

ORACLE["op9_line_dedup"] = r"""
with lines as (
  select doc_id, l.line as line, l.pos as pos,
         translate(trim(l.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(list_zip(parts, range(1, len(parts) + 1))) as z
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents)) d,
       lateral (select z[1] as line, z[2] as pos) l
),
keys as (
  select k, max(doc_id) as keeper from lines where length(k) >= 40
  group by k having count(distinct doc_id) >= 5
),
marked as (
  select lines.*, keys.k is not null and lines.doc_id <> keys.keeper as dropped
  from lines left join keys on lines.k = keys.k
)
select doc_id, cast(count(*) as bigint) as n_lines, cast(count(*) filter (dropped) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) as kept_sha256
from marked group by doc_id
"""

ORACLE["op5_mixing"] = r"""
with docs as (
  select doc_id, source,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         md5('17|' || coalesce(cast(doc_id as varchar) || '|', '') || md5(coalesce(text, ''))) as uid
  from documents
),
sized as (select source, cast(sum(size) as bigint) as source_size from docs group by source),
weighed as (
  select *, cast([1, 2, 3][(place % 3) + 1] as double) as weight, source_size * 3.0::double as cap
  from (select *, row_number() over (order by source nulls last) - 1 as place from sized)
),
levels as (
  select *, (cast((select sum(source_size) from sized) as double)
             - coalesce(sum(cap) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0.0::double))
            / sum(weight) over (order by cap / weight, place rows between current row and unbounded following) as level
  from weighed
),
water as (select arg_min(level, (cap / weight, place)) filter (not (cap <= level * weight)) as height from levels),
targets as (
  select source, source_size,
         case when cap <= level * weight or height is null then cap else height * weight end as target
  from levels, water
),
sizes as (
  select d.source, d.size, t.source_size, t.target, count(*) as n, d.size * count(*) as words, 1 / sqrt(sqrt(d.size::double)) as tilt
  from docs d join targets t on d.source is not distinct from t.source where d.size > 0 group by d.source, d.size, t.source_size, t.target
),
tried as (
  select *, (target - 3.0::double * coalesce(sum(words) over (partition by source order by size rows between unbounded preceding and 1 preceding), 0))
            / sum(tilt * words) over (partition by source order by size rows between current row and unbounded following) as rate
  from sizes
),
rates as (select source, coalesce(arg_min(rate, size) filter (rate * tilt < 3.0::double), 'inf'::double) as rate from tried group by source),
plan as (
  select t.source, t.source_size, t.target, coalesce(any_value(r.rate), 0.0::double) as rate,
         t.target - coalesce(sum(floor(least(3.0::double, r.rate * z.tilt)) * z.words), 0) as need
  from targets t left join rates r on t.source is not distinct from r.source left join sizes z on t.source is not distinct from z.source
  group by t.source, t.source_size, t.target
),
expected as (
  select d.doc_id, d.uid, d.size, p.source, p.source_size, p.target, p.need,
         case when d.size > 0 then least(3.0::double, p.rate * (1 / sqrt(sqrt(d.size::double)))) else 0.0::double end as e
  from docs d join plan p on d.source is not distinct from p.source
),
ranked as (
  select *, floor(e) as whole, case when e > floor(e) then
           ((cast(('0x' || substr(uid, 1, 13)) as bigint)::double + 0.5::double) / 4503599627370496.0::double)
           / (1 - ((cast(('0x' || substr(uid, 1, 13)) as bigint)::double + 0.5::double) / 4503599627370496.0::double))
           / ((e - floor(e)) / (1 - (e - floor(e)))) end as rank
  from expected
),
g as (
  select source, rank, uid, min(size) as size, sum(size) as words, any_value(need) as need from ranked where rank is not null group by source, rank, uid
),
c0 as (select *, sum(words) over (partition by source order by rank, uid) as cum from g),
t0 as (select * from c0 where cum <= need and need >= 0.5::double),
r0 as (select p.source, p.need - coalesce(max(t.cum), 0) as need from plan p left join t0 t on t.source is not distinct from p.source group by p.source, p.need),
left0 as (select g.source, g.rank, g.uid, g.size, r.need, abs(r.need - g.size) as off from g join r0 r on g.source is not distinct from r.source where not exists (select 1 from t0 t where t.uid = g.uid and t.source is not distinct from g.source)),
""" + "".join(
    f"""close{i + 1} as (select source, arg_min(uid, (off, rank, uid)) as uid, arg_min(size, (off, rank, uid)) as size from left{i} where (size <= need or {i} = 3) and off < need group by source),
r{i + 1} as (select r.source, r.need - coalesce(c.size, 0) as need from r{i} r left join close{i + 1} c on c.source is not distinct from r.source),
left{i + 1} as (select l.source, l.rank, l.uid, l.size, r.need, abs(r.need - l.size) as off from left{i} l join r{i + 1} r on l.source is not distinct from r.source where not exists (select 1 from close{i + 1} c where c.uid = l.uid and c.source is not distinct from l.source)),
"""
    for i in range(4)
) + r"""extra as (select source, uid from t0 union select source, uid from close1 union select source, uid from close2 union select source, uid from close3 union select source, uid from close4)
select r.doc_id, r.size, r.source_size, r.target, cast((r.whole + case when e.uid is not null then 1 else 0 end) * r.size as bigint) as taken
from ranked r left join extra e on r.source is not distinct from e.source and r.uid = e.uid
"""


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), Scratch(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json")))


QUERIES |= {f.__name__: f for f in (op3_decontamination, op8_token_output)}

ORACLE["op3_decontamination"] = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
),
b as (
  select coalesce(cast(item_id as varchar), '') as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
),
win as (
  select distinct item, 10 as k, array_to_string(list_slice(w, i, i + 9), ' ') as g
  from (select item, w, unnest(range(1, len(w) - 8)) as i from b where len(w) >= 10)
  union
  select distinct item, len(w) as k, array_to_string(w, ' ') as g from b where len(w) between 1 and 9
),
sizes as (select distinct k from win),
grams as (
  select doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') as g
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, sizes where len(w) >= k)
),
hits as (select doc_id, i, win.k as k, item from grams join win on grams.k = win.k and grams.g = win.g),
hit_words as (select doc_id, count(*) as n from (select distinct doc_id, unnest(range(i, i + k)) as p from hits) group by doc_id),
named as (select doc_id, count(*) as n, string_agg(item, ',' order by item) as names from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(h.n, 0) as bigint) as n_hit, cast(coalesce(m.n, 0) as bigint) as n_items,
       sha256(coalesce(m.names, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
from d left join hit_words h using (doc_id) left join named m using (doc_id)
"""


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "near"), k=2)


QUERIES["op6_near_duplicates"] = op6_near_duplicates


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = language_scores(table(spark, sf_dir, "documents"), Scratch(spark, "lm"), remainder("doc_id", 5) != 1)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "labels").where(remainder("doc_id", 4) != 2).select("doc_id", F.col("quality").alias("label"))
    scored = quality_scores(table(spark, sf_dir, "documents"), labelled)
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


QUERIES |= {f.__name__: f for f in (op4_language_model, op7_quality)}


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), Scratch(spark, "vectors"))


QUERIES["op10_near_vectors"] = op10_near_vectors


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no path; source and language stand for their directories."""
    docs = table(spark, sf_dir, "documents")
    return scan_licenses(docs, Scratch(spark, "licenses"), F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.col("doc_id").cast("string")))


QUERIES["op2_licenses"] = op2_licenses

ORACLE["op6_near_duplicates"] = r"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
),
s as (
  select doc_id, list_distinct(case when len(w) > 1 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) when len(w) = 1 then w else [] end) as s from d
),
n as (select doc_id, len(s) as n from s),
x as (select doc_id, unnest(s) as g from s),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as c
  from x a join x b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id
),
links as (
  select a, b from pairs join n p on p.doc_id = a join n q on q.doc_id = b where 100 * c >= 80 * (p.n + q.n - c)
),
edges as (select a, b from links union all select b, a from links),
reach(a, b) as (select doc_id, doc_id from n union select r.a, e.b from reach r join edges e on r.b = e.a)
select n.doc_id, cast(n.n as bigint) as n_shingles, r.c as component_id, n.doc_id = r.c as kept
from n join (select a, min(b) as c from reach group by a) r on r.a = n.doc_id
"""
ORACLE["op10_near_vectors"] = r"""
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
),
u as (
  select vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) as e from v
  where label is not null and e is not null and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0
),
links as (select a.vec_id as a, b.vec_id as b from u a join u b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id where list_inner_product(a.e, b.e) >= 0.98::double),
reach(a, b) as (select vec_id, vec_id from v union select r.a, l.b from reach r join links l on r.b = l.a),
c as (select a, min(b) as c from reach group by a),
n as (select a, count(*) as n from links group by a)
select v.vec_id, cast(coalesce(n.n, 0) as bigint) as n_links, c.c as component_id, v.vec_id = c.c as kept
from v join c on c.a = v.vec_id left join n on n.a = v.vec_id
"""


def _licenses_sql() -> str:
    from .licenses import CUES, FILE_NAMES, TEMPLATES

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, texts in TEMPLATES.items() for text in texts)
    word = r"'[^\x20\x09-\x0D]+'"
    return rf"""
with t(license, text) as (values {known}),
base as (
  select doc_id, concat_ws('/', coalesce(source, 'unknown'), coalesce(lang, 'unknown'), cast(doc_id as varchar)) as path, text from documents
),
lined as (select *, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, {quoted(CUES)})) as lines from base),
found as (
  select *, len(regexp_extract_all(array_to_string(lines, chr(10)), {word}))::double / greatest(len(regexp_extract_all(text, {word})), 1) as share
  from lined where len(lines) > 0
),
passages as (select distinct unnest(lines) as text from found),
rows as (select text as key, text, null as license from passages union all select license || text, text, license from t),
words as (select key, license, regexp_extract_all(lower(text), '[a-z0-9]+(?:\.[0-9]+)*') as w from rows),
terms as (
  select key, license, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) as term from words
),
tf as (select key, license, term, count(*) as tf from terms group by all),
df as (select term, count(*) as df from tf group by term),
x as (select key, license, tf.term, (1 + ln(tf)) * (ln(((select count(*) from rows) + 1)::double / (df + 1)) + 1) as x from tf join df on tf.term = df.term),
norms as (select key, license, sqrt(sum(x * x)) as norm from x group by key, license),
v as (select x.key, x.license, term, x / norm as x from x join norms on x.key = norms.key and x.license is not distinct from norms.license),
near as (
  select p.key, t.key as template, t.license, round(sum(p.x * t.x), 9) as score from v p join v t on p.term = t.term and p.license is null and t.license is not null
  group by p.key, t.key, t.license having round(sum(p.x * t.x), 9) >= 0.6::double
),
best as (select key, arg_min(license, (-score, license)) as license, max(score) as score from near group by key),
hits as (select doc_id, path, share, unnest(lines) as text from found),
own as (
  select doc_id, path, arg_min(best.license, (-score, best.license)) as license, max(score) as score, max(share) as share
  from hits join best on best.key = hits.text group by doc_id, path
),
given as (
  select regexp_replace(path, '/?[^/]*$', '') as dir, arg_min(license, (-score, license)) as license, max(score) as score
  from own where regexp_matches(path, {quoted(FILE_NAMES)}) or share >= 0.5 group by 1
),
dirs as (select distinct regexp_replace(path, '/?[^/]*$', '') as d from base),
up as (select d, i as depth, array_to_string(list_slice(string_split(d, '/'), 1, i), '/') as dir from (select d, unnest(range(0, len(string_split(d, '/')) + 1)) as i from dirs)),
nearest as (select d, arg_max(up.dir, depth) as dir, arg_max(license, depth) as license, arg_max(score, depth) as score from up join given on up.dir = given.dir group by d)
select b.doc_id, b.path, coalesce(o.license, n.license) as license, coalesce(o.score, n.score) as score,
  case when o.license is not null then 'own' when n.license is not null then 'inherited' end as origin, case when o.license is null then n.dir end as directory
from base b left join own o on b.doc_id = o.doc_id and b.path = o.path left join nearest n on n.d = regexp_replace(b.path, '/?[^/]*$', '')
"""


ORACLE["op2_licenses"] = _licenses_sql()
