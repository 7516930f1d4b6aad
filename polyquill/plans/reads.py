"""Post-processing and run operators on a read table and a residue table made of orders and lineitem, with the same computations as SQL.

Orders stand for reads (group by parity of the key, 40 transcripts, tails of 5 to 101 nucleotides), lineitem for residues (A, N, R: C, G, U), chunks and predictions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import matching as M
from ..functions import scalar as S
from ..functions import signal as K
from ..operators import density as D
from ..operators import post as P
from ..operators import runs as R
from ..operators import scale
from ..operators import tables as T
from ..sources import bam, readers
from .movesql import moves_sql
from .registry import query as _query

_READ = """'t' || ({k} % 40) as transcript, ({k} % 97 + 5)::double as polya_length, case when {k} % 7 = 0 then 'SUFFCLIP' else 'PASS' end as qc_tag, case when {k} % 2 = 1 then 'KO' else 'WT' end as grp"""
_READS = f"""c as (select o_orderkey::varchar as readname, {_READ.format(k='o_orderkey')}, case o_orderstatus when 'F' then 'decorated' when 'O' then 'blank' else 'unclassified' end as class,
case o_orderstatus when 'F' then 'YAY' when 'O' then 'MAU' else 'IRL' end as comments from orders)"""
_RESIDUES = f"""r as (select l_orderkey::varchar as readname, {_READ.format(k='l_orderkey')}, case l_returnflag when 'A' then 'C' when 'N' then 'G' else 'U' end as prediction, l_quantity::double as est_nonA_pos from lineitem)"""
_SPREAD = """w as (select readname, transcript, polya_length, qc_tag, grp, count(*) filter (prediction = 'C') "prediction_C", count(*) filter (prediction = 'G') "prediction_G", count(*) filter (prediction = 'U') "prediction_U",
string_agg(prediction || est_nonA_pos::int::varchar, ':' order by est_nonA_pos, prediction) "nonA_residues" from r group by all)"""
_MERGED = f"""{_READS}, {_RESIDUES}, {_SPREAD}, m as (select coalesce(c.readname, w.readname) readname, coalesce(c.transcript, w.transcript) transcript, coalesce(c.polya_length, w.polya_length) polya_length, coalesce(c.qc_tag, w.qc_tag) qc_tag,
coalesce(c.grp, w.grp) grp, class, comments, coalesce("prediction_C", 0) "prediction_C", coalesce("prediction_G", 0) "prediction_G", coalesce("prediction_U", 0) "prediction_U", "nonA_residues"
from (select * from c where class <> 'unclassified' and qc_tag = 'PASS') c full join w on c.readname = w.readname and c.transcript = w.transcript and c.polya_length = w.polya_length and c.qc_tag = w.qc_tag and c.grp = w.grp)"""


def _common(k):
    k = F.col(k)
    return [F.concat(F.lit("t"), (k % 40).cast("string")).alias("transcript"), (k % 97 + 5).cast("double").alias("polya_length"), F.when(k % 7 == 0, "SUFFCLIP").otherwise("PASS").alias("qc_tag"), F.when(k % 2 == 1, "KO").otherwise("WT").alias("grp")]


def _classes(t):
    kind = F.col("o_orderstatus")
    return t("orders").select(
        F.col("o_orderkey").cast("string").alias("readname"), *_common("o_orderkey"), F.when(kind == "F", "decorated").when(kind == "O", "blank").otherwise("unclassified").alias("class"),
        F.when(kind == "F", "YAY").when(kind == "O", "MAU").otherwise("IRL").alias("comments"),
    )


def _residues(t):
    kind = F.col("l_returnflag")
    return t("lineitem").select(F.col("l_orderkey").cast("string").alias("readname"), *_common("l_orderkey"), F.when(kind == "A", "C").when(kind == "N", "G").otherwise("U").alias("prediction"), F.col("l_quantity").cast("double").alias("est_nonA_pos"))


def _merged(t):
    return P.merge_tables(_classes(t), _residues(t), group="grp", values=["C", "G", "U"])


@_query(f"with {_MERGED} select * from m")
def merge_tables(t):
    return _merged(t)


@_query(f"""with {_MERGED} select transcript, grp, median(polya_length) polya_median, round(avg(polya_length), 4) polya_mean, count(*) counts_total, count(*) filter ("prediction_C" + "prediction_G" + "prediction_U" = 0) counts_blank,
count(*) filter ("prediction_C" + "prediction_G" + "prediction_U" <> 0) "counts_nonA", sum("prediction_C" + "prediction_G" + "prediction_U")::bigint "hits_nonA", count(*) filter ("prediction_C" <> 0) "counts_C", sum("prediction_C")::bigint "hits_C",
count(*) filter ("prediction_G" <> 0) "counts_G", sum("prediction_G")::bigint "hits_G", count(*) filter ("prediction_U" <> 0) "counts_U", sum("prediction_U")::bigint "hits_U" from m group by all""")
def summarize_transcripts(t):
    return P.summarized(_merged(t), ["grp"], "transcript").withColumn("polya_mean", F.round("polya_mean", 4))


_METRICS = " union all ".join(f"""select grp, '{s}' as source, {e}::double as counts, '{'main' if s in ('counts_total', 'counts_blank', 'counts_nonA') else 'mods'}' as cat from m group by 1""" for s, e in [
    ("counts_total", "count(*)"), ("counts_blank", 'count(*) filter ("prediction_C" + "prediction_G" + "prediction_U" = 0)'), ("counts_nonA", 'count(*) filter ("prediction_C" + "prediction_G" + "prediction_U" <> 0)'),
    ("counts_C", 'count(*) filter ("prediction_C" <> 0)'), ("counts_G", 'count(*) filter ("prediction_G" <> 0)'), ("counts_U", 'count(*) filter ("prediction_U" <> 0)'),
])


@_query(f"with {_MERGED} {_METRICS}")
def panel_metrics(t):
    return P.metrics(P.summarized(_merged(t), ["grp"]), ["grp"])


def _edited_sql(where: str) -> str:
    """The rule for positions, with the whitelist that ``where`` gives."""
    return f"""{_READS}, {_RESIDUES}, dr as (select distinct * from r), dc as (select distinct * from c),
cs as (select grp, transcript, quantile_cont(polya_length, 0.05) seg_err_quart, count(*) "count" from dc group by all), ml as (select grp, transcript, arg_min(x, row(-n, x)) mode_len from (select grp, transcript, polya_length::int x, count(*) n from dc where polya_length >= 1 group by all) group by all),
rs as (select grp, transcript, prediction, quantile_cont("est_nonA_pos", 0.05) pos_err_quart, count(*) "count_nonA" from dr group by all), mp as (select grp, transcript, prediction, arg_min(x, row(-n, x)) mode_pos from (select grp, transcript, prediction, "est_nonA_pos"::int x, count(*) n from dr where "est_nonA_pos" >= 1 group by all) group by all),
e as (select dr.*, class, comments, case when {where} or "count_nonA" > 10 and "est_nonA_pos" > mode_pos and (mode_pos < pos_err_quart or mode_pos > pos_err_quart and "est_nonA_pos" - pos_err_quart > 4) or "count_nonA" > 10 and mode_pos > seg_err_quart
or "count_nonA" > 10 and "est_nonA_pos" > pos_err_quart and "est_nonA_pos" > seg_err_quart or "count_nonA" < 10 or "count_nonA" > 10 and dr.polya_length < 50 and "est_nonA_pos" / dr.polya_length * 100 < mode_len and "est_nonA_pos" > pos_err_quart and pos_err_quart > 10 then 'Y' else 'N' end qc_pos
from dr join rs using (grp, transcript, prediction) join mp using (grp, transcript, prediction) left join (dc join cs using (grp, transcript) join ml using (grp, transcript)) d on d.readname = dr.readname and d.transcript = dr.transcript and d.polya_length = dr.polya_length and d.qc_tag = dr.qc_tag and d.grp = dr.grp)"""


@_query(f"with {_edited_sql('false')} select transcript, grp, prediction, qc_pos, count(*) n from e group by all")
def correct_residues(t):
    return T.count_by(P.corrected_residues(_classes(t), _residues(t), "transcript", groups="grp"), "qc_pos", ["transcript", "grp", "prediction"])


_LISTED = ("t3", "t17")


@_query(f"with {_edited_sql('''dr.transcript in ('t3', 't17')''')} select transcript, qc_pos, count(*) n from e group by all")
def correct_listed(t):
    return T.count_by(P.corrected_residues(_classes(t), _residues(t), "transcript", groups="grp", listed=P.whitelist(None, _LISTED)), "qc_pos", "transcript")


_RECLASSED = """k as (select readname, count(*) n_resid, count(*) filter (qc_pos = 'N') n_bad from e group by 1), x as (select dc.*, n_resid, n_bad, case when n_resid = n_bad then 'blank' when n_resid > n_bad then 'decorated' else class end corr_class from dc left join k using (readname)),
y as (select *, case when class = corr_class then comments else 'MPU' end corr_comments from x)"""


@_query(f"with {_edited_sql('false')}, {_RECLASSED} select readname, n_resid, n_bad as \"no_qc_pos_N\", corr_class, corr_comments from y")
def correct_classes(t):
    edited = P.corrected_residues(_classes(t), _residues(t), "transcript", groups="grp")
    return P.corrected_classes(_classes(t).distinct(), edited).select("readname", "n_resid", "no_qc_pos_N", "corr_class", "corr_comments")


@_query(f"with {_edited_sql('false')}, {_RECLASSED} select readname, transcript, polya_length, qc_tag, grp, corr_class as class, corr_comments as comments from y")
def reclassify_reads(t):
    return P.reclassified(_classes(t), _residues(t), "transcript", "grp")[0]


@_query(f"with {_edited_sql('false')} select readname, transcript, polya_length, qc_tag, grp, prediction, \"est_nonA_pos\", class, comments from e where qc_pos = 'Y'")
def reclassify_residues(t):
    return P.reclassified(_classes(t), _residues(t), "transcript", "grp")[1]


_TESTS = f"""{_MERGED}, n as (select transcript, count(*) filter (grp = 'KO') n0, count(*) filter (grp = 'WT') n1, count(*) filter (grp = 'KO' and s = 0) a, count(*) filter (grp = 'KO' and "prediction_C" <> 0) b, count(*) filter (grp = 'WT' and s = 0) c,
count(*) filter (grp = 'WT' and "prediction_C" <> 0) d, count(*) filter (grp = 'KO' and s <> 0) x0, count(*) filter (grp = 'WT' and s <> 0) x1 from (select *, "prediction_C" + "prediction_G" + "prediction_U" s from m) group by 1 having greatest(x0, x1) >= 5),
z as (select *, case when n0 = 0 and n1 = 0 then 'DATA FOR BOTH GROUPS NOT AVAILABLE' when n0 = 0 or n1 = 0 then 'DATA FOR ONE GROUP NOT AVAILABLE' when n0 < 10 and n1 < 10 then 'LOW COUNTS FOR BOTH GROUPS' when n0 < 10 or n1 < 10 then 'LOW COUNT FOR ONE GROUP' else 'OK' end stats_code from n),
v as (select transcript, a, b, c, d, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) k from z where stats_code = 'OK'), l as (select *, -(lgamma(k + 1) + lgamma(a + b - k + 1) + lgamma(a + c - k + 1) + lgamma(d - a + k + 1)) lw, -(lgamma(a + 1) + lgamma(b + 1) + lgamma(c + 1) + lgamma(d + 1)) la from v),
p as (select transcript, least(1.0, sum(exp(lw - la)) filter (lw <= la + 1e-7) / sum(exp(lw - la))) p from l group by 1), q as (select transcript, p * count(*) over () / (rank() over (order by p) + count(*) over (partition by p) - 1) q, p from p),
h as (select transcript, p, least(1.0, min(q) over (order by p desc)) padj from q)"""


@_query(f"with {_TESTS} select transcript, round(p, 6) p_value, stats_code, round(padj, 6) padj, case when padj < 0.05 then 'FDR<0.05' else 'NotSig' end significance from z left join h using (transcript)")
def residue_tests(t):
    out = P.residue_tests(_merged(t), "transcript", "grp", ("KO", "WT"), min_reads=10, min_nonA_reads=5)
    return out.withColumns({"p_value": F.round("p_value", 6), "padj": F.round("padj", 6)})


@_query("""with k as (select l_linestatus, l_orderkey, count(*) k from lineitem group by all), a as (select l_linestatus, sum(k) filter (k = 1) s, sum(k) filter (k = 2) t, sum(k) filter (k > 2) m from k group by 1),
b as (select l_linestatus, coalesce(s, 0) s, coalesce(t, 0) t, coalesce(m, 0) m from a)
select l_linestatus, 'single' as instances, s / (s + t + m) as share from b union all select l_linestatus, 'two', t / (s + t + m) from b union all select l_linestatus, 'more', m / (s + t + m) from b""")
def abundance_shares(t):
    return P.instance_shares(T.abundance(t("lineitem"), "l_linestatus", "l_orderkey"), "l_linestatus")


@_query("""with n as (select l_linestatus, l_returnflag, count(*) n from lineitem group by all), g as (select distinct l_linestatus from lineitem), v as (select unnest(['A', 'N', 'R', 'Z']) l_returnflag)
select l_linestatus, l_returnflag, coalesce(n, 0) / sum(coalesce(n, 0)) over (partition by l_linestatus) as share from g cross join v left join n using (l_linestatus, l_returnflag)""")
def residue_shares(t):
    return P.residue_shares(t("lineitem"), "l_linestatus", "l_returnflag", ["A", "N", "R", "Z"])


@_query(f"with {_READS} select grp, count(*) filter (class = 'decorated') n, count(*) total, count(*) filter (class = 'decorated') / count(*) as share from c group by 1")
def decorated_share(t):
    return P.decorated_share(_classes(t), "grp")


def _panel_sql(position: str) -> str:
    """Each residue's bin, how many residues share it, and how many tails, of all residues, end in no lower bin."""
    upper = lambda x: f"case when round_even({x}, 0) > 0 then (ceil(round_even({x}, 0) / 5.0) * 5)::bigint end"
    return f"""{_RESIDUES}, b as (select prediction, {upper(position)} as bin, {upper("polya_length")} as lb from r), at_bin as (select bin, count(*) as n_bin from b where bin is not null group by bin),
pooled as (select a.bin, a.n_bin, (select count(*) from b where b.lb >= a.bin) as n_at_least, (select count(distinct lb) from b) as k from at_bin a)"""


_PANEL_ROWS = "select prediction, bin, count(*) n, any_value(n_bin) n_bin, any_value(n_at_least) n_at_least, any_value(n_bin / nullif(n_at_least, 0)) ratio, any_value(n_bin / nullif(n_at_least, 0) / k) normalised from b join pooled using (bin) group by all"
_FROM_3 = "polya_length - est_nonA_pos"


@_query(f"with {_panel_sql('est_nonA_pos')} {_PANEL_ROWS}")
def panel_bins(t):
    return P.panel(_residues(t), "prediction", "est_nonA_pos", "polya_length")


@_query(f"with {_panel_sql(_FROM_3)} {_PANEL_ROWS}")
def panel_bins_3_prime(t):
    return P.panel(_residues(t), "prediction", "est_nonA_pos", "polya_length", from_5_prime=False)


@_query(f"""with {_panel_sql(_FROM_3)}, h as (select prediction, lb as length_bin, round(sum(n_bin / nullif(n_at_least, 0) / k), 9) height from b join pooled using (bin) where lb is not null group by all)
select h.*, (select '(n=' || count(*) || ')' from b where b.prediction = h.prediction) as label from h""")
def panel_columns(t):
    return P.panel_columns(_residues(t), "prediction", "est_nonA_pos", "polya_length", from_5_prime=False).withColumn("height", F.round("height", 9))


@_query(f"""with {_MERGED}, u as (select *, 'total' as type from m union all select *, 'nonA' from m where "nonA_residues" is not null union all select *, 'blank' from m where "nonA_residues" is null)
select type, count(*) n, sum(polya_length) total, count(distinct readname) reads from u group by 1""")
def tail_types(t):
    return P.tail_types(_merged(t)).groupBy("type").agg(F.count("*").alias("n"), F.sum("polya_length").alias("total"), F.countDistinct("readname").alias("reads"))


@_query(f"with {_READS} select count(distinct grp) samples, count(distinct transcript) transcripts, count(*) reads, count(*) filter (class = 'blank') blank, count(*) filter (class = 'decorated') decorated from c")
def value_boxes(t):
    return P.value_boxes(_classes(t), "grp", "transcript")


@_query("select l_orderkey, l_linenumber, l_returnflag, count(*) over (partition by l_returnflag) as n from lineitem")
def counted_residues(t):
    return P.with_count(t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag")


# A plain sum of kernels at each of the 512 places, over all values.
_DENSITY = """f as (select event_type, count(*) n, 0.9 * least(stddev_samp(value), (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.34) * count(*) ^ -0.2 as h, min(value) lo, max(value) hi from events group by 1),
g as (select *, i as place, lo - 3 * h + i * (hi - lo + 6 * h) / 511 as x from f, range(512) as s(i)),
curve as (select g.event_type, g.place, g.x, sum(exp(-0.5 * ((g.x - e.value) / g.h) ^ 2)) / any_value(g.n * g.h * sqrt(2 * pi())) as density from g join events e using (event_type) group by all)"""


@_query(f"with {_DENSITY} select event_type, place::int as place, round(x, 6) as x, round(density, 6) as density from curve where place % 8 = 0")
def density_curves(t):
    return D.curves(t("events"), "event_type", "value").where("place % 8 = 0").select("event_type", "place", F.round("x", 6).alias("x"), F.round("density", 6).alias("density"))


@_query(f"with {_DENSITY}, top as (select event_type, arg_max(x, row(density, -place)) as mode from curve group by 1) select event_type, median(value) median, round(avg(value), 6) mean, round(any_value(mode), 6) as mode from events join top using (event_type) group by 1")
def central_tendency(t):
    return P.central_tendency(t("events"), "event_type", "value").select("event_type", "median", F.round("mean", 6).alias("mean"), F.round("mode", 6).alias("mode"))


@_query("select o_orderpriority, n, round(a, 6) a, round(b, 6) b, round(c, 6) c from (select o_orderpriority, count(*) n, quantile_cont(o_totalprice, 0.05) a, quantile_cont(o_totalprice, 0.5) b, quantile_cont(o_totalprice, 0.99) c from orders group by 1)")
def exact_quantiles(t):
    d = scale.exact_quantiles(t("orders"), "o_orderpriority", "o_totalprice", {"a": 0.05, "b": 0.5, "c": 0.99})
    return d.select("o_orderpriority", "n", *(F.round(c, 6).alias(c) for c in "abc"))


@_query(f"with {_RESIDUES} select readname read_id, prediction, est_nonA_pos, polya_length from r where readname = '7'")
def one_read(t):
    return P.one_read(_residues(t), "7").select("read_id", "prediction", "est_nonA_pos", "polya_length")


@_query("""with p as (select l_orderkey, l_linenumber, round_even(100 + (60 - l_quantity) * 30, 0) as place, l_returnflag from lineitem) select l_orderkey, l_linenumber, (place - 250) * 0.25 as xmin, (place + 250) * 0.25 as xmax, l_returnflag as label from p""")
def overlays(t):
    at = S.signal_position(F.col("l_quantity"), F.lit(60.0), F.lit(100.0), F.lit(1900.0))
    return t("lineitem").select("l_orderkey", "l_linenumber", K.overlay(at, F.col("l_returnflag"), 250, 0.25).alias("o")).select("l_orderkey", "l_linenumber", "o.*")


@_query(f"with {_RESIDUES}, k as (select transcript, count(*) n from r group by 1 having count(*) % 2 = 0) select r.readname, prediction, transcript in (select transcript from k) as listed from r")
def listed_transcripts(t):
    residues = _residues(t)
    even = residues.groupBy("transcript").agg(F.count("*").alias("n")).where("n % 2 = 0").select(F.lit("hsapiens").alias("species"), "transcript")
    listed = P.whitelist(even, "hsapiens").withColumn("listed", F.lit(True))
    return residues.join(listed, "transcript", "left").select("readname", "prediction", F.coalesce("listed", F.lit(False)).alias("listed"))


@_query("select o_orderstatus, o_orderkey from (select *, row_number() over (partition by o_orderstatus order by md5(o_orderkey || ':42'), o_orderkey) as k from orders) where k <= 25")
def seeded_sample(t):
    return P.seeded_sample(t("orders"), "o_orderstatus", "o_orderkey", 25).select("o_orderstatus", "o_orderkey")


@_query("select o_orderkey, lag(o_orderkey) over (order by o_orderkey) as previous, lead(o_orderkey) over (order by o_orderkey) as next from orders")
def read_neighbours(t):
    return P.neighbours(t("orders").select("o_orderkey"), "o_orderkey")


@_query("select event_type, count(*) n, round(100 * count(*) / sum(count(*)) over (), 2) percent from events group by 1")
def type_shares(t):
    return P.type_shares(t("events"), "event_type")


@_query(f"with {_READS}, {_RESIDUES} select c.* from c where grp = 'KO' and class in ('decorated', 'blank') and polya_length between 20 and 60 and readname in (select readname from r where prediction = 'U')")
def chosen_reads(t):
    return P.chosen(_classes(t), {"grp": "KO"}, {"class": ["decorated", "blank"]}, {"polya_length": (20, 60)}, _residues(t), "U")


@_query(f"with {_READS} select class, comments, min(readname) as readname from c group by all")
def first_of_each_class(t):
    one = P.first_of_each(_classes(t).select("class", "comments", "readname").withColumn("both", F.concat_ws("/", "class", "comments")), "both", ["readname"])
    return one.select("class", "comments", "readname")


@_query(f"with {_READS} select c.readname, class, case when c.readname::bigint % 3 = 0 then 'polyA' when c.readname::bigint % 3 = 1 then 'polyT' else 'unidentified' end tail_type from c")
def oriented_reads(t):
    k = F.col("readname").cast("long") % 3
    calls = _classes(t).where(k < 2).select(F.col("readname").alias("read_id"), S.tail_type(F.when(k == 0, "A").otherwise("T")).alias("tail_type"))
    return P.with_orientation(_classes(t).withColumnRenamed("readname", "read_id"), calls).select(F.col("read_id").alias("readname"), "class", "tail_type")


_CHUNKS = """ch as (select l_orderkey::varchar read_id, l_orderkey || '_' || l_linenumber chunkname, min(l_suppkey % 4) p, min(l_partkey % 1500) as a from lineitem group by l_orderkey, l_linenumber), d as (select *, case p when 0 then 'A' when 1 then 'C' when 2 then 'G' else 'U' end base from ch)"""
_ORIGINAL = """o as (select o_orderkey::varchar read_id, (o_orderkey % 97 + 5)::int len, (o_custkey % 30)::int s, (o_custkey % 30 + 20 * (o_orderkey % 97 + 5))::int e, 'g' || (o_orderkey % 40) genome, case when o_orderkey % 11 = 0 then '*' else '+' end dir,
case when o_orderkey % 11 = 0 then 0 else 60 end mapq from orders), q as (select * from o where dir <> '*' and mapq <> 0 and s <> 0 and len >= 10)"""
_PLACED = f"""{_CHUNKS}, {_ORIGINAL}, aa as (select read_id from d group by 1 having min(base) = 'A' and max(base) = 'A'), m as (select d.read_id, base, genome, len, mapq, round_even(len - len * (a + 49.5) / (0.2 * (e - s)), DIGITS) as est from d join q using (read_id) where base <> 'A'),
bad as (select *, est < 2 or est > len - 2 as edge from m where est is not null), good as (select * from bad where not edge), blank as (select read_id from aa union select read_id from bad where edge)"""


def _chunk_table(t):
    one = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.col("l_partkey") % 1500).alias("chunk_start_pos"), F.min(F.col("l_suppkey") % 4).cast("int").alias("prediction"))
    return one.select(F.col("l_orderkey").cast("string").alias("read_id"), F.concat_ws("_", "l_orderkey", "l_linenumber").alias("chunkname"), "chunk_start_pos", (F.col("chunk_start_pos") + 99).alias("chunk_end_pos"), "prediction")


def _summary_table(t):
    k, s = F.col("o_orderkey"), F.col("o_custkey") % 30
    length = k % 97 + 5
    return t("orders").select(
        F.lit("f").alias("input_filename"), k.cast("string").alias("read_id"), length.cast("int").alias("poly_tail_length"), s.cast("int").alias("poly_tail_start"), (s + 20 * length).cast("int").alias("poly_tail_end"),
        F.concat(F.lit("g"), (k % 40).cast("string")).alias("alignment_genome"), F.when(k % 11 == 0, "*").otherwise("+").alias("alignment_direction"), F.when(k % 11 == 0, 0).otherwise(60).alias("alignment_mapq"),
    )


def _dorado(t, **how):
    chunks = _chunk_table(t)
    return R.dorado_outputs(chunks.select("chunkname", "prediction"), chunks, R.dorado_summary(_summary_table(t)), R.dorado_summary(_summary_table(t), qc=False), **how)


@_query(f"""with {_PLACED.replace('DIGITS', '0')}, rest as (select o.*, b.read_id is not null is_blank from o left join blank b using (read_id) where read_id not in (select read_id from good)),
coded as (select *, case when dir = '*' and mapq = 0 then 'UNM' when len < 10 then 'IRL' when s = 0 then 'BAC' when is_blank then 'MPU' else 'MAU' end comments from rest)
select read_id readname, genome contig, len polya_length, mapq qc_tag, case when comments in ('MPU', 'MAU') then 'blank' else 'unclassified' end as class, comments from coded union all select read_id, genome, len, mapq, 'decorated', 'YAY' from q where read_id in (select read_id from good)""")
def dorado_reads(t):
    return _dorado(t)[0]


@_query(f"with {_PLACED.replace('DIGITS', '0')} select read_id readname, genome contig, base prediction, est \"est_nonA_pos\", len polya_length, mapq qc_tag from good")
def dorado_residues(t):
    return _dorado(t)[1]


# All known reads take part, also those of no quality; a residue at an end makes its read blank whatever else it has.
_CDNA = f"""{_CHUNKS}, {_ORIGINAL}, m as (select o.*, base, round_even(len - len * (a + 49.5) / (0.2 * (e - s)), 2) as est from d join o using (read_id) where base <> 'A'),
e as (select *, est < 2 or est > len - 2 as edge from m where est is not null), k as (select read_id, bool_or(edge) as doubtful, bool_or(not edge) as good from e group by 1)"""
_TYPE = "case when read_id::bigint % 2 = 0 then 'polyA' else 'polyT' end"


def _cdna(t):
    known = R.dorado_summary(_summary_table(t), qc=False).withColumn("tail_type", F.when(F.col("read_id").cast("long") % 2 == 0, "polyA").otherwise("polyT"))
    chunks = _chunk_table(t)
    return R.cdna_outputs(chunks.select("chunkname", "prediction"), chunks, known, known)


@_query(f"with {_CDNA} select read_id readname, genome contig, base prediction, est \"est_nonA_pos\", len polya_length, mapq qc_tag, {_TYPE} tail_type from e where not edge")
def cdna_residues(t):
    return _cdna(t)[1]


@_query(f"""with {_CDNA}, c as (select o.*, case when len < 10 then 'IRL' when doubtful then 'MPU' when good then 'YAY' else 'MAU' end as comments from o left join k using (read_id))
select read_id readname, genome contig, len polya_length, mapq qc_tag, case comments when 'IRL' then 'unclassified' when 'YAY' then 'decorated' else 'blank' end as class, comments, {_TYPE} tail_type from c""")
def cdna_reads(t):
    return _cdna(t)[0]


@_query(f"""with {_CDNA}, n as (select {_TYPE} tail_type, 1 reads, 0 residues from o union all select {_TYPE}, 0, 1 from e where not edge), g as (select coalesce(tail_type, 'total') tail_type, sum(reads)::bigint reads, sum(residues)::bigint residues from n group by grouping sets ((tail_type), ()))
select tail_type, reads, round(100 * reads / max(reads) over (), 2) as percent, residues from (select * from g union all select 'unidentified', 0, 0)""")
def cdna_statistics(t):
    classes, residues = _cdna(t)
    kind = lambda k: classes.where(F.col("tail_type") == k)
    return R.merged_statistics(kind("polyA"), kind("polyT"), None, residues)


# Reads made of the two primers with a few letters changed, digits of a digest as bases between them.
_SEQ = """p as (select c_custkey as id, translate(md5(c_custkey::varchar) || md5(c_name), '0123456789abcdef', 'ACGTACGTACGTACGT') as body, overlay_front as f, overlay_rear as r from (select *, 'FRONT' as overlay_front, 'REAR' as overlay_rear from customer)),
q as (select id, case id % 5 when 0 then f || body || RC_REAR when 1 then r || body || RC_FRONT when 2 then body when 3 then left(f, 15) || body || left(RC_REAR, 30) else left(r, 24) || body || RC_FRONT end as seq from p),"""


def _orientation_sql() -> str:
    rear = M.REAR.rstrip("T")
    front_rc, rear_rc, whole_rc = M.reverse_complement(M.FRONT), M.reverse_complement(rear), M.reverse_complement(M.REAR)
    hw = lambda q, target: f"least(levenshtein('{q}', {target}), list_min(list_transform(range(1, greatest(length({target}) - {len(q)} + 1, 0) + 1), lambda i: levenshtein('{q}', substr({target}, i::bigint, {len(q)})))))"
    made = _SEQ.replace("'FRONT'", f"'{M.FRONT}'").replace("'REAR'", f"'{M.REAR}'").replace("RC_REAR", f"'{whole_rc}'").replace("RC_FRONT", f"'{front_rc}'")
    return f"""with {made} w as (select id, seq, left(seq, 150) as top, right(seq, 150) as bottom from q),
d as (select id, {hw(M.FRONT, 'top')} + {hw(rear_rc, 'bottom')} as v1, {hw(rear, 'top')} + {hw(front_rc, 'bottom')} as v2 from w)
select id, case when 1 - least(v1, v2) / {len(M.FRONT) + len(rear)}.0 < 0.6 or abs(v1 - v2) <= 10 then 'unidentified' when v1 < v2 then 'polyA' else 'polyT' end as tail_type from d"""


@_query(_orientation_sql())
def orientation(t):
    k, rc = F.col("c_custkey"), M.reverse_complement
    front, rear = F.lit(M.FRONT), F.lit(M.REAR)
    body = F.translate(F.concat(F.md5(k.cast("string").cast("binary")), F.md5(F.col("c_name").cast("binary"))), "0123456789abcdef", "ACGTACGTACGTACGT")
    made = [F.concat(front, body, F.lit(rc(M.REAR))), F.concat(rear, body, F.lit(rc(M.FRONT))), body, F.concat(F.left(front, F.lit(15)), body, F.left(F.lit(rc(M.REAR)), F.lit(30)))]
    sequence = F.when(k % 5 == 0, made[0]).when(k % 5 == 1, made[1]).when(k % 5 == 2, made[2]).when(k % 5 == 3, made[3]).otherwise(F.concat(F.left(rear, F.lit(24)), body, F.lit(rc(M.FRONT))))
    return M.with_tail_type(t("customer").select(k.alias("id"), sequence.alias("sequence"))).select("id", "tail_type")


_GUPPY = f"""{_CHUNKS}, n as (select o_orderkey::varchar readname, 'g' || (o_orderkey % 40) contig, (o_orderkey % 97 + 5)::double polya_length, case o_orderkey % 5 when 0 then 'SUFFCLIP' when 1 then 'ADAPTER' else 'PASS' end qc_tag, (307 + 4 * (o_custkey % 2))::bigint sl from orders),
aa as (select read_id readname from d group by 1 having min(base) = 'A' and max(base) = 'A'), m as (select d.read_id readname, base, n.contig, n.polya_length, n.qc_tag, round_even(polya_length - polya_length * (a + 50) / sl, 2) + 0 est from d left join n on n.readname = d.read_id where base <> 'A'),
t as (select *, coalesce(est < 2 or est > polya_length - 2, false) edge from m), w as (select readname, min(edge) all_edge from t group by 1)"""


def _guppy(t):
    k = F.col("o_orderkey")
    nano = t("orders").select(k.cast("string").alias("readname"), F.concat(F.lit("g"), (k % 40).cast("string")).alias("contig"), (k % 97 + 5).cast("double").alias("polya_length"), F.when(k % 5 == 0, "SUFFCLIP").when(k % 5 == 1, "ADAPTER").otherwise("PASS").alias("qc_tag"))
    tails = t("orders").select(k.cast("string").alias("readname"), (307 + 4 * (F.col("o_custkey") % 2)).alias("signal_length"))
    chunks = _chunk_table(t).withColumnRenamed("read_id", "readname")
    return R.guppy_outputs(chunks.select("chunkname", "prediction"), chunks, tails, nano)


@_query(f"with {_GUPPY} select distinct readname, contig, case when edge then base || '-WARN' else base end prediction, est \"est_nonA_pos\", polya_length, qc_tag from t")
def guppy_residues(t):
    return _guppy(t)[1]


@_query(f"""with {_GUPPY}, x as (select n.*, case when polya_length < 10 then 'IRL' when qc_tag = 'SUFFCLIP' then 'NIN' when qc_tag in ('ADAPTER', 'NOREGION', 'READ_FAILED_LOAD') then 'QCF' when readname in (select readname from aa) then 'MPU' else 'MAU' end comments from n where readname not in (select readname from w))
select distinct readname, contig, polya_length, qc_tag, case when comments in ('MPU', 'MAU') then 'blank' else 'unclassified' end as class, comments from x
union all select distinct n.readname, contig, polya_length, qc_tag, case when all_edge then 'decorated-WARN' else 'decorated' end, 'YAY' from n join w using (readname)""")
def guppy_reads(t):
    return _guppy(t)[0]


@_query("""select o_orderkey::varchar as readname, 'tailfindr_out' as contig, o_custkey as polya_start, o_custkey + 50 as tail_end, o_custkey + 51 as transcript_start, (o_orderkey % 30)::double as polya_length, case when o_orderkey % 30 >= 10 then 'PASS' else 'NOREGION' end as qc_tag from orders""")
def tailfindr_reads(t):
    given = t("orders").select(F.col("o_orderkey").cast("string").alias("read_id"), F.col("o_custkey").alias("tail_start"), (F.col("o_custkey") + 50).alias("tail_end"), F.lit(8.5).alias("samples_per_nt"), (F.col("o_orderkey") % 30).cast("double").alias("tail_length"))
    return readers.tail_lengths(given.sparkSession, given)[0]


@_query("""select distinct o_orderkey::varchar as readname, o_custkey as polya_start, o_custkey + 900 as transcript_start, (o_orderkey % 30)::double as polya_length, case when o_orderkey % 4 = 0 then 'SUFFCLIP' else 'PASS' end as qc_tag, case when o_orderkey % 3 = 0 then 'f' || o_custkey end as filename
from orders where o_orderkey % 4 <> 0 and o_orderkey % 30 >= 10""")
def polya_reads(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    nano = t("orders").select(k.cast("string").alias("readname"), c.alias("polya_start"), (c + 900).alias("transcript_start"), (k % 30).cast("double").alias("polya_length"), F.when(k % 4 == 0, "SUFFCLIP").otherwise("PASS").alias("qc_tag"))
    summary = t("orders").where(k % 3 == 0).select(k.cast("string").alias("read_id"), F.concat(F.lit("f"), c.cast("string")).alias("filename"))
    return readers.polya(nano, summary)


@_query("""select l_orderkey, l_linenumber, round_even(60 - 60 * (l_partkey % 1500 + 49.5) / (0.2 * 2100), 0) + 0 as pos, round_even(60 - 60 * (l_partkey % 1500 + 49.5) / (0.2 * 2100), 2) + 0 as pos2, round_even(60 - 60 * (l_partkey % 1500 + 50) / 400.0, 2) + 0 as pos_guppy,
case when l_returnflag = 'R' then '?' when l_returnflag = 'A' and l_linestatus = 'F' or l_returnflag = 'N' and l_linestatus <> 'F' then '=' when l_returnflag in ('A', 'N') then 'x' end as marker,
case when l_linestatus = 'F' then 'decorated' else 'blank' end as label, case when l_quantity < 10 then 'IRL' when l_returnflag = 'A' then 'MPU' when l_linestatus = 'F' then 'YAY' else 'MAU' end as cdna_code, regexp_replace(l_shipdate::varchar, '[^A-Za-z0-9]', '_', 'g') as safe from lineitem""")
def scalar_columns(t):
    li, flag, line = t("lineitem"), F.col("l_returnflag"), F.col("l_linestatus")
    start, length = F.col("l_partkey") % 1500, F.lit(60.0)
    inferred = F.when(flag == "R", "ambiguous").when(flag == "A", "polyA_layout").otherwise("polyT_layout")
    return li.select(
        "l_orderkey", "l_linenumber", S.position_estimate(length, F.lit(0.0), F.lit(2100.0), start).alias("pos"), S.position_estimate(length, F.lit(0.0), F.lit(2100.0), start, 2).alias("pos2"), S.guppy_position(length, F.lit(400.0), start).alias("pos_guppy"),
        S.agreement(F.when(line == "F", "polyA").otherwise("polyT"), inferred).alias("marker"), S.corrected_label(F.when(line == "F", "modified").otherwise("unmodified")).alias("label"),
        S.cdna_code(line == "F", flag == "A", F.col("l_quantity")).alias("cdna_code"), S.safe_id(F.col("l_shipdate").cast("string")).alias("safe"),
    )


@_query(f"""{moves_sql('trunc(value)')}, tail as (select user_id, i, case when i > max(i) over (partition by user_id) - 3 then 0 else move end as move from filled),
run as (select user_id, i, move, i - row_number() over (partition by user_id, move order by i) as k from tail), runs as (select user_id, move, min(i) as a, count(*) as n from run where move <> 0 group by user_id, move, k having count(*) >= 5),
numbered as (select user_id::varchar as read_id, a + n // 2 - 50 as first, row_number() over (partition by user_id order by a) as k from runs)
select read_id, k::int as chunk_idx, read_id || '_' || k as chunkname, first::int as chunk_start_pos, (first + 99)::int as chunk_end_pos from numbered""")
def tail_chunks(t):
    pairs = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value")))
    tails = t("events").groupBy(F.col("user_id").cast("string").alias("read_id")).agg(F.transform(pairs, lambda x: x["value"].cast("int")).alias("tail_signal"))
    return R.chunk_rows(tails).select("read_id", "chunk_idx", "chunkname", "chunk_start_pos", "chunk_end_pos")


@_query("""with s as (select user_id, value, row_number() over (partition by user_id order by ts, event_id, value) i from events) select user_id, (i - 1)::int as position, (value + 10) * 0.25 as pa, case when i - 1 < 20 then 'adapter' when i - 1 <= 60 then 'poly(A)' else 'transcript' end as segment from s""")
def signal_trace(t):
    pairs = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value")))
    d = t("events").groupBy("user_id").agg(K.calibrated(F.transform(pairs, lambda x: x["value"]), F.lit(10), F.lit(0.25)).alias("signal"))
    return d.select("user_id", F.posexplode("signal").alias("position", "pa")).withColumn("segment", K.segment(F.col("position"), F.lit(20), F.lit(60)))


def _event_tails(t):
    pairs = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value")))
    return t("events").groupBy(F.col("user_id").cast("string").alias("read_id")).agg(F.transform(pairs, lambda x: x["value"].cast("int")).alias("tail_signal"))


@_query(f"""{moves_sql('trunc(value)')}, run as (select user_id, i, move, i - row_number() over (partition by user_id, move order by i) as k from filled), runs as (select user_id, move, min(i) as a, count(*) as n from run where move <> 0 group by user_id, move, k having count(*) >= 5),
found as (select user_id, a + n // 2 - 50 as first, row_number() over (partition by user_id order by a) as k from runs), kept as (select * from found f where exists (select 1 from filled m where m.user_id = f.user_id and m.move <> 0 and m.i between f.first and f.first + 99))
select user_id::varchar as read_id, row_number() over (partition by user_id order by k)::int as chunk_idx, first::int as chunk_start_pos, (first + 99)::int as chunk_end_pos from kept""")
def guppy_chunk_places(t):
    return R.chunk_rows(_event_tails(t), chunks=K.guppy_chunks).select("read_id", "chunk_idx", "chunk_start_pos", "chunk_end_pos")


@_query("""with s as (select user_id, trunc(value * 10) as v, row_number() over (partition by user_id order by ts, event_id, value) as i, count(*) over (partition by user_id) as n from events),
w as (select *, 5 + user_id % 7 as a, 35 + user_id % 50 as b from s where user_id % 13 <> 0), cut as (select user_id, v, i - a as i, b - a as len from w where b <= n and i > a and i <= b),
q as (select user_id, quantile_cont(v, 0.005) as lo, quantile_cont(v, 0.995) as hi from cut group by 1), c as (select user_id, i, len, trunc(least(greatest(v, lo), hi)) as v from cut join q using (user_id)),
g as (select user_id, len, ceil(0.2 * len)::bigint as m from c group by all), p as (select user_id, len, j, case when m = 1 then 0 else j * ((len - 1)::double / (m - 1)) end as x from g, range(0, 1000) r(j) where j < m), f as (select *, least(floor(x)::bigint, len - 1) as k from p)
select f.user_id::varchar as read_id, j::int as i, round_even(l.v + (x - k) * (coalesce(r.v, l.v) - l.v), 0)::bigint as value from f join c l on l.user_id = f.user_id and l.i = k + 1 left join c r on r.user_id = f.user_id and r.i = k + 2""")
def tail_signals(t):
    pairs = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value")))
    signals = t("events").groupBy(F.col("user_id").cast("string").alias("read_id")).agg(F.transform(pairs, lambda x: (x["value"] * 10).cast("int")).alias("signal"))
    k = F.col("user_id")
    summary = t("events").select("user_id").distinct().select(k.cast("string").alias("read_id"), F.when(k % 13 == 0, 10).otherwise(11).alias("poly_tail_length"), (5 + k % 7).cast("int").alias("poly_tail_start"), (35 + k % 50).cast("int").alias("poly_tail_end"))
    return R.tail_signals(summary, signals).select("read_id", F.posexplode("tail_signal").alias("i", "value"))


@_query("""with a as (select l_orderkey, l_linenumber, l_partkey % 4096 as flag, case when l_suppkey % 10 = 0 then '*' else 'r' || l_suppkey % 10 end as reference, l_partkey as pos, case when l_quantity > 5 then l_quantity::int end as pt, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey * 100 + l_quantity::bigint as place from lineitem),
g as (select * from a where pt is not null and flag & 4 = 0 and flag & 2304 = 0 and reference <> '*' and l_orderkey % 3 > 0) select l_orderkey::varchar as read_id, reference, pos, pt, 'f' || l_orderkey % 3 as filename from g qualify row_number() over (partition by l_orderkey order by place) = 1""")
def tailed_reads(t):
    k = F.col("l_orderkey")
    aligned = t("lineitem").select(
        k.cast("string").alias("read_id"), F.lit("a.bam").alias("file"), (F.col("l_linenumber") * F.lit(10**12) + F.col("l_partkey") * 1_000_000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("long")).alias("place"), (F.col("l_partkey") % 4096).cast("int").alias("flag"), F.when(F.col("l_suppkey") % 10 == 0, "*").otherwise(F.concat(F.lit("r"), (F.col("l_suppkey") % 10).cast("string"))).alias("reference"),
        F.col("l_partkey").alias("pos"), F.when(F.col("l_quantity") > 5, F.col("l_quantity").cast("int")).alias("pt"), F.array(F.lit(1)).alias("pa"), F.lit("ACGT").alias("sequence"),
    )
    files = t("orders").select(F.col("o_orderkey").alias("k")).where("k % 3 > 0").select(F.col("k").cast("string").alias("read_id"), F.concat(F.lit("f"), (F.col("k") % 3).cast("string")).alias("filename"))
    return bam.tailed_reads(aligned, files).select("read_id", "reference", "pos", "pt", "filename")


@_query("select l_orderkey::varchar as read_id, l_linenumber from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus = 'F')")
def split_reads(t):
    part = t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("read_id"))
    return bam.split_by_reads(t("lineitem").select(F.col("l_orderkey").cast("string").alias("read_id"), "l_linenumber"), part)


@_query(f"with {_READS} select o_orderkey::varchar as read_id, o_totalprice, class, comments from orders left join c on c.readname = o_orderkey::varchar and o_orderkey % 2 = 0")
def signals_with_class(t):
    even = _classes(t).where(F.col("readname").cast("long") % 2 == 0)
    return P.with_class(t("orders").select(F.col("o_orderkey").cast("string").alias("read_id"), "o_totalprice"), even.unionByName(even))


@_query("select distinct o_orderpriority from orders where o_orderpriority is not null")
def pick_list(t):
    return P.pick_list(t("orders"), "o_orderpriority")
