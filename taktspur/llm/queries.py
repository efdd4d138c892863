"""The registered queries of the operators, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import crc_bucket, with_small_batches
from .contamination import contaminated, find_contamination
from .filter_audit import filter_audit
from .html_text import extract_text
from .lattice import lattice_scores
from .lexical import search
from .lines import drop_common_lines
from .near_dup import near_duplicates
from .packing import pack
from .pii import BASE_KINDS, find_personal_data
from .quality import fit_quality, rate_quality
from .spans import remove_repeats
from .tokens import count_tokens
from .toxicity import fit_toxicity, score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return with_small_batches(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def joined_spans(found: str) -> str:
    return f"array_join(transform({found}, s -> concat_ws(':', s.kind, s.start, s.`end`)), ',')"


@query
def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (extract_text(table(spark, sf_dir, "pages"))
            .withColumn("n_chars", F.char_length("text").cast("long")))


@query
def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    base = "filter(found, s -> s.kind in ({}))".format(", ".join(f"'{k}'" for k in BASE_KINDS))
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(found, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}")
          for k in BASE_KINDS],
        F.expr(f"sha2({joined_spans(base)}, 256)").alias("base_sha256"),
        F.expr(joined_spans("found")).alias("spans"),
    )


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"))
    return pieces.select(F.col("doc").alias("doc_id"), "start", "length",
                         F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated(found).alias("contaminated"))


ORACLE["op4_decontamination"] = r"""
with docs as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (
  select item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
spread as (
  select item_id, w, least(len(w), 13) as n, unnest(range(1, len(w) - least(len(w), 13) + 2)) as i
  from items where len(w) > 0),
runs as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as run from spread),
lengths as (select distinct n from runs),
places as (
  select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from docs, lengths where len(w) >= n),
windows as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as run from places),
found as (select doc_id, w.n, i, item_id from windows w join runs r on r.n = w.n and r.run = w.run),
hit as (
  select doc_id, count(distinct p) as n_hit
  from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, n, i from found))
  group by doc_id),
listed as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
  coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from docs d left join hit using (doc_id) left join listed using (doc_id)
"""


@query
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


ORACLE["op5_near_duplicates"] = r"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
sets as (
  select doc_id, unnest(case when len(w) >= 5
      then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
      when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s
  from words),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared
  from sets a join sets b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (
  select p.a, p.b from pairs p join sizes x on x.doc_id = p.a join sizes y on y.doc_id = p.b
  where 100 * shared >= 75 * (x.n + y.n - shared)),
reach(doc_id, other) as (
  select doc_id, doc_id from documents
  union select r.doc_id, l.b from reach r join links l on l.a = r.other)
select r.doc_id, coalesce(any_value(s.n), 0)::bigint as n_shingles, min(other) as component_id,
  r.doc_id = min(other) as kept
from reach r left join sizes s on s.doc_id = r.doc_id group by r.doc_id
"""


def _learned(column: str):
    return crc_bucket(column, 5) != 0


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels, usable=_learned)
    return (score_toxicity(docs, model)
            .select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", "predicted"))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return rate_quality(docs, fit_quality(docs, labels))


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


@query
def op9_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE["op9_repeated_spans"] = r"""
with docs as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
windows as (
  select doc_id, p, md5(substr(x, 2 * p + 1, 100)) as s
  from (select doc_id, x, unnest(range(0, length(x) // 2 - 49)) as p from docs)),
least as (select s, min(doc_id) as d from windows group by s having min(doc_id) < max(doc_id)),
hit as (select w.doc_id, w.p from windows w join least l on l.s = w.s where l.d < w.doc_id),
runs as (
  select doc_id, p, case when p <= lag(p) over (partition by doc_id order by p) + 50 then 0 else 1 end as new
  from hit),
numbered as (select doc_id, p, sum(new) over (partition by doc_id order by p) as k from runs),
spans as (select doc_id, k, min(p) as b, max(p) + 50 as e from numbered group by doc_id, k),
gaps as (
  select d.doc_id, coalesce(lag(e) over (partition by d.doc_id order by b), 0) as f, b as t, d.x
  from spans s join docs d using (doc_id)
  union all
  select d.doc_id, coalesce(max(e), 0), any_value(length(d.x) // 2), any_value(d.x)
  from docs d left join spans s using (doc_id) group by d.doc_id),
kept as (
  select doc_id, string_agg(substr(x, 2 * f + 1, 2 * (t - f)), '' order by f) as y from gaps group by doc_id)
select d.doc_id, (length(x) // 2)::bigint as n_bytes, ((length(x) - length(coalesce(y, ''))) // 2)::bigint as n_removed,
  coalesce(n, 0)::bigint as n_spans, sha256(unhex(coalesce(y, ''))) as kept_sha256
from docs d join kept using (doc_id)
left join (select doc_id, count(*) as n from spans group by doc_id) using (doc_id)
"""


@query
def op10_lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lattice_scores(table(spark, sf_dir, "documents"), crc_bucket("doc_id", 7) != 2)
    return scores.select("doc_id", (crc_bucket("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


ORACLE["op11_lexical_search"] = r"""
with doc_terms as (
  select doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from documents),
item_terms as (
  select item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
lengths as (select doc_id, count(*) as n from doc_terms group by doc_id),
totals as (select count(*)::bigint as docs, sum(n)::bigint as terms from lengths),
tfs as (select doc_id, t, count(*)::bigint as tf from doc_terms
        where t in (select t from item_terms) group by doc_id, t),
weights as (
  select t, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from tfs, totals group by t, docs),
adds as (
  select doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms))) as a
  from tfs join weights using (t) join lengths using (doc_id), totals),
scores as (select item_id, doc_id, sum(a)::bigint as score from item_terms join adds using (t) group by item_id, doc_id),
ranked as (
  select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score
  from scores where score > 0)
select item_id, rank::integer as rank, doc_id, score from ranked where rank <= 20
"""


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE["op12_filter_audit"] = r"""
with docs as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
firsts as (select text, min(doc_id) as least from docs group by text),
flags as (
  select part, coalesce(quality = 1, false) as good, coalesce(toxic = 1, false) as toxic,
    {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
     'C': 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text),
     'D': regexp_matches(text, '[#$%&*|]'), 'E': d.doc_id > least} as f
  from docs d join firsts using (text) left join labels l on l.doc_id = d.doc_id),
failed as (
  select part, good, toxic, case when f.A then 'A' else '' end || case when f.B then 'B' else '' end
    || case when f.C then 'C' else '' end || case when f.D then 'D' else '' end
    || case when f.E then 'E' else '' end as fails from flags),
counted as (
  select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic
  from failed group by all),
letters(x) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
orders as (
  select a.x || b.x || c.x || d.x || e.x as o from letters a, letters b, letters c, letters d, letters e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (select o, i as step, o[i] as x, o[1:i - 1] as earlier from orders, range(1, 6) r(i)),
applied as (
  select part, o, step, x, n, good, toxic, contains(fails, x) as here, fails = x as alone,
    translate(fails, earlier, '') <> fails as before
  from counted, steps),
summed as (
  select part, o, step, x, coalesce(sum(n) filter (not here and not before), 0) as kept,
    coalesce(sum(n) filter (here and not before), 0) as removed,
    coalesce(sum(n) filter (here and before), 0) as redundant, coalesce(sum(n) filter (alone), 0) as unique_fails,
    coalesce(sum(good) filter (here and not before), 0) as good_lost,
    coalesce(sum(toxic) filter (here and not before), 0) as toxic_lost
  from applied group by part, o, step, x)
select part, o as filter_order, step::integer as step, kept::bigint as kept, removed::bigint as removed,
  redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost,
  toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, x))::bigint as shapley
from summed
"""


@query
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_common_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE["op13_line_dedup"] = r"""
with lines as (
  select doc_id, unnest(range(1, len(l) + 1)) as i, unnest(l) as line
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents)),
keyed as (
  select doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
common as (
  select key, max(doc_id) as last from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
marked as (
  select doc_id, i, line, last is not null and doc_id <> last as dropped from keyed left join common using (key))
select doc_id, count(*)::bigint as n_lines, count(*) filter (dropped)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not dropped), '')) as kept_sha256
from marked group by doc_id
"""
