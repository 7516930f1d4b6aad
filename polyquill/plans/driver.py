"""The operators bound to the driver's tables, with the same computations as SQL.

orders stand for reads (o_orderstatus: class, o_orderpriority: quality tag, o_totalprice: length), lineitem for residues (l_returnflag: base,
l_quantity: position, l_suppkey: transcript), l_linestatus for the two conditions, events for signals.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import signal as K
from ..operators import stats
from ..operators import tables as T
from . import reads  # noqa: F401  (registers its queries)
from .movesql import moves_sql
from .registry import QUERIES, SQL, Query
from .registry import query as _query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


@_query("select o_orderstatus, count(*) as n from orders group by all")
def count_class(t):
    return T.count_by(t("orders"), "o_orderstatus")


@_query("select o_orderpriority, o_orderstatus, count(*) as n from orders group by all")
def count_class_grouped(t):
    return T.count_by(t("orders"), "o_orderstatus", "o_orderpriority")


@_query("select l_linestatus, l_returnflag, count(*) as n from lineitem group by all")
def count_residues(t):
    return T.count_by(t("lineitem"), "l_returnflag", "l_linestatus")


@_query("select o_orderpriority, count(*) as n from orders group by all")
def qc_tag_counts(t):
    return T.count_by(t("orders"), "o_orderpriority")


@_query("""select l_linestatus, case when k = 1 then 'single' when k = 2 then 'two' else 'more' end as instances, sum(k)::bigint as count
from (select l_linestatus, l_orderkey, count(*) as k from lineitem group by all) group by all""")
def abundance(t):
    return T.abundance(t("lineitem"), "l_linestatus", "l_orderkey")


_SPREAD = """select l_orderkey, l_linestatus, count(*) filter (l_returnflag = 'A') as "prediction_A", count(*) filter (l_returnflag = 'N') as "prediction_N", count(*) filter (l_returnflag = 'R') as "prediction_R",
string_agg(l_returnflag || l_quantity::int::varchar, ':' order by l_quantity::int, l_returnflag) as "nonA_residues" from lineitem group by all"""


def _spread(t):
    return T.spread(t("lineitem").withColumn("pos", F.col("l_quantity").cast("int")), ["l_orderkey", "l_linestatus"], "l_returnflag", "pos", ["A", "N", "R"])


@_query(_SPREAD)
def spread_residues(t):
    return _spread(t)


@_query(f"""select l_linestatus, median(o_totalprice) as polya_median, round(avg(o_totalprice), 4) as polya_mean, count(*) as counts_total, count(*) filter (a + n + r = 0) as counts_blank,
count(*) filter (a + n + r <> 0) as "counts_nonA", sum(a + n + r)::bigint as "hits_nonA", count(*) filter (n <> 0) as "counts_N", sum(n)::bigint as "hits_N"
from (select l_linestatus, o_totalprice, "prediction_A" a, "prediction_N" n, "prediction_R" r from ({_SPREAD}) join orders on l_orderkey = o_orderkey) group by all""")
def summarize(t):
    merged = _spread(t).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = T.summarize(merged, ["l_linestatus"], "o_totalprice", ["A", "N", "R"])
    return out.withColumn("polya_mean", F.round("polya_mean", 4)).select("l_linestatus", "polya_median", "polya_mean", "counts_total", "counts_blank", "counts_nonA", "hits_nonA", "counts_N", "hits_N")


@_query("select * from events where event_type <> 'view' and value <> 0 and user_id <> 0 and value >= 10")
def filter_summary(t):
    as_summary = t("events").withColumns({"alignment_direction": F.when(F.col("event_type") == "view", "*").otherwise("+"), "alignment_mapq": F.col("value"), "poly_tail_start": F.col("user_id"), "poly_tail_length": F.col("value")})
    return T.dorado_passed(as_summary).select(*t("events").columns)


@_query("""select code, case when code in ('MPU', 'MAU') then 'blank' else 'unclassified' end as class, count(*) as n from (select case when l_returnflag = 'A' and l_linenumber = 1 then 'UNM' when l_quantity < 10 then 'IRL'
when l_suppkey = 7 then 'BAC' when l_linestatus = 'F' then 'MPU' else 'MAU' end as code from lineitem) group by all""")
def comment_codes(t):
    li = t("lineitem").withColumn("direction", F.when(F.col("l_returnflag") == "A", "*").otherwise("+"))
    code = S.comment_code(F.col("direction"), F.col("l_linenumber") - 1, F.col("l_quantity"), F.col("l_suppkey") - 7, F.col("l_linestatus") == "F")
    return T.count_by(li.select(code.alias("code")).withColumn("class", S.class_of(F.col("code"))), "class", "code").select("code", "class", "n")


@_query("select distinct o_orderkey, o_orderstatus from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def semi_decorated(t):
    return t("orders").join(t("lineitem").where("l_returnflag = 'R'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey", "o_orderstatus").distinct()


@_query("select o_orderkey, o_orderstatus from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def anti_decorated(t):
    return t("orders").join(t("lineitem").where("l_returnflag = 'R'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey", "o_orderstatus")


@_query("select l_orderkey from lineitem group by 1 having min(l_returnflag) = 'A' and max(l_returnflag) = 'A'")
def all_a_reads(t):
    return T.only_value(t("lineitem"), "l_orderkey", "l_returnflag", "A")


@_query("select distinct l_orderkey, l_returnflag from lineitem")
def by_read_dedup(t):
    return t("lineitem").select("l_orderkey", "l_returnflag").distinct()


@_query("select o_orderpriority, o_orderstatus, count(*) as n, count(*) / sum(count(*)) over (partition by o_orderpriority) as share from orders group by o_orderpriority, o_orderstatus")
def class_proportion(t):
    return T.shares(t("orders"), "o_orderpriority", "o_orderstatus")


@_query("select l_linestatus, l_returnflag, count(*) as n, count(*) / sum(count(*)) over (partition by l_linestatus) as share from lineitem group by l_linestatus, l_returnflag")
def residue_frequency(t):
    return T.shares(t("lineitem"), "l_linestatus", "l_returnflag")


@_query("select l_returnflag, count(*) as n, round(avg(l_quantity), 2) as mean, round(median(l_quantity), 2) as median, round(stddev_samp(l_quantity), 2) as sd, round(stddev_samp(l_quantity) / sqrt(count(*)), 2) as sem from lineitem group by 1")
def length_stats(t):
    return T.length_stats(t("lineitem"), "l_returnflag", "l_quantity")


@_query("select l_returnflag, bin, n, sum(n) over (partition by l_returnflag order by bin desc)::bigint as n_at_least from (select l_returnflag, (5 * ceil(l_quantity / 5))::bigint as bin, count(*) as n from lineitem where l_quantity > 0 group by all)")
def binned_positions(t):
    li = t("lineitem").where("l_quantity > 0").withColumn("bin", S.position_bin(F.col("l_quantity")).cast("long"))
    return T.at_least(li, "l_returnflag", "bin")


@_query("select l_suppkey, count(*) as n, median(l_quantity) as median from lineitem group by 1")
def transcript_medians(t):
    return t("lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.median("l_quantity").alias("median"))


@_query("select p_partkey, reverse(translate(upper(p_name), 'ACGTN', 'TGCAN')) as rc, (length(p_name) - length(regexp_replace(p_name, 't+$', '')))::int as trailing from part")
def reverse_complement(t):
    return t("part").select("p_partkey", S.reverse_complement(F.col("p_name")).alias("rc"), S.count_trailing(F.col("p_name"), "t").alias("trailing"))


@_query("""select p_partkey, least(coalesce((select min(levenshtein('widget', substr(p_name, i::int, 6))) from range(1, length(p_name) - 4) g(i)), 999), levenshtein('widget', p_name))::int as distance from part""")
def hw_edit_distance(t):
    return t("part").select("p_partkey", S.edit_distance_hw(F.lit("widget"), F.col("p_name")).alias("distance"))


@_query("""select s_suppkey, case when a is null or b is null or least(a, b) < 100 or greatest(a, b) / least(a, b) < 1.5 then 'ambiguous' when a > b then 'polyA_layout' else 'polyT_layout' end as layout
from (select s_suppkey, (s_suppkey * 13 - 1)::double a, (2000 - s_suppkey * 17)::double b from supplier)""")
def layout_marker(t):
    k = F.col("s_suppkey").cast("double")
    return t("supplier").select("s_suppkey", S.layout(k * 13, k * 17, F.lit(2000.0)).alias("layout"))


@_query("select s_suppkey, s_name, n_name, n_regionkey from supplier left join nation on s_nationkey = n_nationkey")
def annotate(t):
    nation = t("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey")
    return T.annotated(t("supplier"), nation, "s_nationkey").select("s_suppkey", "s_name", "n_name", "n_regionkey")


@_query("select o_orderkey, o_orderstatus, 'wt' as sample_name from orders where o_orderstatus = 'F' union all select o_orderkey, o_orderstatus, 'ko' from orders where o_orderstatus <> 'F'")
def union_samples(t):
    o = t("orders").select("o_orderkey", "o_orderstatus")
    return T.union_samples([(o.where("o_orderstatus = 'F'"), {"sample_name": "wt"}), (o.where("o_orderstatus <> 'F'"), {"sample_name": "ko"})])


_FISHER = """with n as (select l_suppkey, count(*) filter (l_linestatus = 'F' and l_returnflag = 'R') a, count(*) filter (l_linestatus = 'F' and l_returnflag <> 'R') b, count(*) filter (l_linestatus = 'O' and l_returnflag = 'R') c, count(*) filter (l_linestatus = 'O' and l_returnflag <> 'R') d from lineitem group by 1),
w as (select *, unnest(range(greatest(0, 2 * a + b + c - a - b - c - d), least(a + b, a + c) + 1)) x from n), v as (select *, -(lgamma(x + 1) + lgamma(a + b - x + 1) + lgamma(a + c - x + 1) + lgamma(d - a + x + 1)) lw, -(lgamma(a + 1) + lgamma(b + 1) + lgamma(c + 1) + lgamma(d + 1)) la from w),
f as (select l_suppkey, a, b, c, d, least(1.0, sum(exp(lw - la)) filter (lw <= la + 1e-7) / sum(exp(lw - la))) as p from v group by all)"""


def _tested(t):
    c = lambda s, r: F.count_if((F.col("l_linestatus") == s) & ((F.col("l_returnflag") == "R") if r else (F.col("l_returnflag") != "R")))
    n = t("lineitem").groupBy("l_suppkey").agg(c("F", 1).alias("a"), c("F", 0).alias("b"), c("O", 1).alias("c"), c("O", 0).alias("d"))
    return n.withColumn("p", stats.fisher(F.col("a"), F.col("b"), F.col("c"), F.col("d")))


@_query(f"{_FISHER} select l_suppkey, a, b, c, d, round(p, 6) as p from f")
def fisher(t):
    return _tested(t).withColumn("p", F.round("p", 6))


@_query(f"{_FISHER}, r as (select *, p * count(*) over () / (rank() over (order by p) + count(*) over (partition by p) - 1) q from f) select l_suppkey, round(least(1.0, min(q) over (order by p desc)), 6) as padj from r")
def bh_adjust(t):
    return stats.adjusted(_tested(t), "p").select("l_suppkey", F.round("padj", 6).alias("padj"))


@_query("select l_suppkey, arg_min(x, row(-n, x)) as mode from (select l_suppkey, l_quantity::int x, count(*) n from lineitem where l_quantity >= 1 group by all) group by 1")
def value_mode(t):
    return t("lineitem").groupBy("l_suppkey").agg(S.integer_mode(F.col("l_quantity")).alias("mode"))


@_query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, round_even(100 + (60 - l_quantity) * 30, 0) as signal_pos from lineitem")
def signal_position(t):
    pos = S.signal_position(F.col("l_quantity"), F.lit(60.0), F.lit(100.0), F.lit(1900.0))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", pos.alias("signal_pos"))


def _signals(t):
    pairs = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value")))
    return t("events").groupBy("user_id").agg(F.transform(pairs, lambda x: x["value"]).alias("signal"))


_SIGNAL = "with s as (select user_id, value, row_number() over (partition by user_id order by ts, event_id, value) i, count(*) over (partition by user_id) n from events)"


def _samples(df, column):
    return df.select("user_id", F.posexplode(column).alias("i", "value"))


@_query(f"""{_SIGNAL}, q as (select user_id, quantile_cont(value, 0.005) lo, quantile_cont(value, 0.995) hi from s group by 1)
select user_id, (i - 1)::int as i, trunc(least(greatest(value, lo), hi))::bigint as value from s join q using (user_id)""")
def winsorize(t):
    return _samples(_signals(t), K.winsorized("signal"))


@_query(f"""{_SIGNAL}, g as (select user_id, n, ceil(0.2 * n)::bigint m from s group by all), p as (select user_id, j, case when m = 1 then 0 else j * ((n - 1)::double / (m - 1)) end x, n from g, range(0, 100000) r(j) where j < m),
f as (select *, least(floor(x)::bigint, n - 1) k from p)
select f.user_id, j::int as i, round_even(a.value + (x - k) * (coalesce(b.value, a.value) - a.value), 0)::bigint as value from f join s a on a.user_id = f.user_id and a.i = k + 1 left join s b on b.user_id = f.user_id and b.i = k + 2""")
def resample(t):
    return _samples(_signals(t), K.resampled("signal"))


@_query(f"{moves_sql('value')} select user_id, (i - 1)::int as i, move::bigint as move from filled")
def pseudomoves(t):
    return _signals(t).select("user_id", F.posexplode(K.moves("signal")).alias("i", "move"))


@_query("""with e as (select vec_id, unnest(embedding)::double v, generate_subscripts(embedding, 1) i from embeddings), m as (select *, min(v) over w lo, max(v) over w hi from e window w as (partition by vec_id)),
a as (select vec_id, i, acos(greatest(-1, least(1, 2 * (v - lo) / (hi - lo) - 1))) x from m), g as (select p.vec_id, (p.i - 1) * count(*) over (partition by p.vec_id, p.i) + q.i - 1 as i, cos(p.x + q.x) v from a p join a q using (vec_id)),
h as (select *, min(v) over w lo, max(v) over w hi from g window w as (partition by vec_id)) select vec_id, count(*)::int as n, round(sum(round((v - lo) / (hi - lo), 4)), 4) as total, round(sum(round((v - lo) / (hi - lo), 4) * (i % 1009)), 4) as weighted from h group by 1""")
def gaf(t):
    """Sums over each field's entries, plain and weighted by place."""
    g = t("embeddings").select("vec_id", K.gaf_rows("embedding").alias("g"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    weighted = F.transform("g", lambda x, i: x * (i % 1009))
    return g.select("vec_id", F.size("g").alias("n"), F.round(total(F.col("g")), 4).alias("total"), F.round(total(weighted), 4).alias("weighted"))


@_query(f"""{moves_sql('value')}, n as (select user_id, max(i) as n from later group by 1) select user_id, (i - 1)::int as i, case when i <= 5 or i > n - 6 then 0 else move end::bigint as move from filled join n using (user_id)""")
def training_moves(t):
    return _signals(t).select("user_id", F.posexplode(K.training_moves_rows("signal")).alias("i", "move"))


@_query(f"""{moves_sql('value')}, k as (select *, i - row_number() over (partition by user_id, move order by i) as k from filled) select user_id, (min(i) - 1)::int as start, count(*)::int as length, move::int as value from k group by user_id, move, k""")
def move_runs(t):
    return _signals(t).select("user_id", F.explode(K.run_rows(K.moves("signal"))).alias("r")).select("user_id", "r.*")


@_query("""with e as (select vec_id, unnest(embedding)::double v, generate_subscripts(embedding, 1) i from embeddings), m as (select *, min(v) over w lo, max(v) over w hi from e window w as (partition by vec_id)),
a as (select vec_id, i, asin(greatest(-1, least(1, 2 * (v - lo) / (hi - lo) - 1))) x from m), g as (select p.vec_id, sin(p.x + q.x) v from a p join a q using (vec_id)),
h as (select *, min(v) over w lo, max(v) over w hi from g window w as (partition by vec_id)) select vec_id, count(*)::int as n, round(sum(round((v - lo) / (hi - lo), 4)), 4) as total from h group by 1""")
def gaf_difference(t):
    g = t("embeddings").select("vec_id", K.gaf_d_rows("embedding").alias("g"))
    return g.select("vec_id", F.size("g").alias("n"), F.round(F.aggregate("g", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@_query(f"""{_SIGNAL} select user_id, (i - greatest(10 + user_id % 5 - 4, 1))::int as place, value from s where i between greatest(10 + user_id % 5 - 4, 1) and least(40 + user_id % 9 + 4, n)""")
def tail_crops(t):
    crop = K.tail_crop(F.col("signal"), 10 + F.col("user_id") % 5, 40 + F.col("user_id") % 9, 4)
    return _signals(t).select("user_id", F.posexplode(crop).alias("place", "value"))
