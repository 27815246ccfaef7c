"""One query per operator over the driver's tables, each over whole tables and texts, with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import lines, newlines, ratio
from ..functions.storage import settled, spread
from ..operators import align, corpus, issues, report, risk, rules, sampling, stats
from ..operators.lines import line_structure
from ..schemas import RISK_WEIGHTS
from .pairs import CTE, pairs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = f"with {CTE}{oracle}" if oracle.startswith(",") or oracle.startswith("\nselect") else oracle
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- rules -------------------------------------------------------------------------------------------------------------

W_ = r"[\p{L}\p{M}\p{N}_]"
#: The rules in RE2's syntax; look-ahead and back-references spelled out.
RE2 = {
    "S1": {"L": r"(?m)^[ \t]+", "T": r"(?m)[ \t]+$", "W": r"[ \t]{2,}", "SP": r"[ \t]+[.,;:!?]", "C": r"[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]", "P": r"[.,;:!?]{2,}", "G": r"[^\p{Latin}\p{N}\p{P}\p{Zs}\n\r\t]", "M": r"\x{FFFD}", "MP": rf"{W_}[.,;:!?]{W_}"},
    "S3": {"Q": r"(?i)(?:^|[^\p{L}\p{M}\p{N}_])qu(?:[^eiEI]|$)", "WK": "(?i)[wk]", "DC": "(?i)" + "|".join(c * 2 for c in "bdfghjkmpqstvwxyz"), "E": rf"(?i){W_}+[cfkmp](?:[^\p{{L}}\p{{M}}\p{{N}}_]|$)", "T": "(?i)" + "|".join(c * 3 for c in "abcdefghijklmnopqrstuvwxyz")},
}


def _counts_sql(step: str) -> str:
    each = " union all ".join(f"select style, '{step}{code}' as tag, len(regexp_extract_all(htr, '{p}'))::bigint as n from pairs" for code, p in RE2[step].items())
    return f", c as ({each})\nselect style, tag, sum(n)::bigint as n from c group by all having sum(n) > 0"


@query(_counts_sql("S1"))
def step1_issue_counts(spark, sf):
    return rules.rule_counts(pairs(spark, sf), "S1")


@query(_counts_sql("S3"))
def step3_issue_counts(spark, sf):
    return rules.rule_counts(pairs(spark, sf), "S3")


@query(", c as (select style, " + ", ".join(f"len(regexp_extract_all(htr, '{p}')) as n{code}" for code, p in RE2["S1"].items()) + " from pairs)\nselect style, " + ", ".join(f"sum(n{code})::bigint as S1{code}" for code in RE2["S1"]) + " from c group by style")
def step1_summary_pivot(spark, sf):
    return rules.tag_pivot(rules.rule_counts(pairs(spark, sf), "S1"), "S1")


_SPANS = "L", "T", "W", "SP", "P"


def _spans_sql(codes=_SPANS, step="S1") -> str:
    each = " union all ".join(f"select pair_id, htr, '{step}{c}' as tag, string_split_regex(htr, '{RE2[step][c]}') as g, regexp_extract_all(htr, '{RE2[step][c]}') as m from pairs" for c in codes)
    return f""", s as ({each}),
 x as (select pair_id, htr, tag, g, m, unnest(range(1, len(m) + 1)) as i from s),
 y as (select pair_id, htr, tag, m[i] as htr_text, (coalesce(list_sum([length(v) for v in g[1:i]]), 0) + coalesce(list_sum([length(v) for v in m[1:i - 1]]), 0))::int as a from x),
 spans as (select *, a + length(htr_text)::int as b, length(left(htr, a)) - length(replace(left(htr, a), chr(10), '')) as line0,
   length(left(htr, greatest(b - 1, a))) - length(replace(left(htr, greatest(b - 1, a)), chr(10), '')) as line1 from y),
 located as (select *, coalesce(list_sum([length(v) + 1 for v in string_split(htr, chr(10))[1:line0]]), 0)::int as base, coalesce(list_sum([length(v) + 1 for v in string_split(htr, chr(10))[1:line1]]), 0)::int as base1 from spans)"""


@query(_spans_sql() + "\nselect pair_id, tag, a as start, b as \"end\", (line0 + 1)::int as line, (a - base + 1)::int as char_start, (greatest(b - 1, a) - base1 + 1)::int as char_end from located")
def step1_whitespace_spans(spark, sf):
    return rules.rule_issues(pairs(spark, sf), "S1", list(_SPANS)).select("pair_id", "tag", "start", "end", "line", "char_start", "char_end")


_WHERE = "\nselect pair_id, tag, a as start, b as \"end\", (line0 + 1)::int as line, (a - base + 1)::int as char_start, (greatest(b - 1, a) - base1 + 1)::int as char_end from located"


@query(_spans_sql(("C", "G", "M", "MP")) + _WHERE)
def step1_character_spans(spark, sf):
    return rules.rule_issues(pairs(spark, sf), "S1", ["C", "G", "M", "MP"]).select("pair_id", "tag", "start", "end", "line", "char_start", "char_end")


#: the step 3 rules without look-around, whose spans SQL finds as they are
_STEP3 = ("WK", "DC", "T")


@query(_spans_sql(_STEP3, "S3") + _WHERE)
def step3_letter_spans(spark, sf):
    return rules.rule_issues(pairs(spark, sf), "S3", list(_STEP3)).select("pair_id", "tag", "start", "end", "line", "char_start", "char_end")


@query(
    _spans_sql(tuple(RE2["S1"]))
    + ", one as (select pair_id, a, b from located)"
    + _spans_sql(_STEP3, "S3").replace(", s as (", ", s3 as (").replace("from s)", "from s3)").replace(" x as (", " x3 as (").replace("from x)", "from x3)").replace(" y as (", " y3 as (").replace("from y)", "from y3)").replace(" spans as (", " spans3 as (").replace("from spans)", "from spans3)").replace(" located as (", " located3 as (")
    + ", t as (select l.pair_id, l.tag, l.a, (select count(*) from one o where o.pair_id = l.pair_id and greatest(o.a, l.a) < least(o.b, l.b)) as n from located3 l)\nselect p.style, tag, sum(n)::bigint as s1_overlaps, sum((n > 0)::int)::bigint as with_s1 from t join pairs p on p.pair_id = t.pair_id group by p.style, tag"
)
def step3_touches_step1(spark, sf):
    rows = issues.orthographic_overlap_totals(align.orthographic_overlaps(pairs(spark, sf)))
    return rows.filter(F.col("tag").isin(*["S3" + c for c in _STEP3])).select("style", "tag", "s1_overlaps", "with_s1")


@query(
    _spans_sql(("W", "P"))
    + """, p as (select pair_id, tag, a, b, length(htr) as dl, length(string_split(htr, chr(10))[line0 + 1]) as ll, (a - base + 1)::double as cs, (greatest(b - 1, a) - base1 + 1)::double as ce from located),
 r as (select *, case when b > a then a + (b - a) / 2.0 else a end as mid, case when ce > cs then cs + (ce - cs) / 2.0 else cs end as cm from p)
select pair_id, tag, a as start, round(case when ll > 0 then least(greatest(greatest(cm - 0.5, 0) / ll, 0), 1) end, 6) as relative_line_position, round(case when dl > 0 then least(greatest(mid / dl, 0), 1) end, 6) as relative_document_position,
 case when dl > 0 then concat((least(floor(mid / dl * 10), 9) * 10)::int, '-', (least(floor(mid / dl * 10), 9) * 10 + 10)::int, '%') end as document_position_bin from r"""
)
def issue_positions(spark, sf):
    return rounded(rules.rule_issues(pairs(spark, sf), "S1", ["W", "P"]).select("pair_id", "tag", "start", "relative_line_position", "relative_document_position", "document_position_bin"))


@query(_spans_sql(("W", "SP")) + "\nselect pair_id, tag, a as start, b as \"end\", substr(sha1(concat_ws('|', pair_id, tag, a, b)), 1, 12) as issue_id from located")
def issue_ids(spark, sf):
    return rules.rule_issues(pairs(spark, sf), "S1", ["W", "SP"]).select("pair_id", "tag", "start", "end", "issue_id")


@query()
def step3_issues(spark, sf):
    return rounded(rules.rule_issues(pairs(spark, sf), "S3").drop("review"))


# ---- split and pairing -------------------------------------------------------------------------------------------------

_SPLIT = ", s as (select style, pair_id::varchar as pair_id, case when ('0x' || substr(md5(style || ':' || pair_id), 1, 8))::bigint / 4294967295.0 < 0.2 then 'test' else 'train' end as split from pairs)"


@query(_SPLIT + "\nselect * from s")
def hash_split(spark, sf):
    return corpus.split(pairs(spark, sf))


@query(_SPLIT + "\nselect style, count(*) filter (split = 'train') as train, count(*) filter (split = 'test') as test, count(*) as total, least(count(*) filter (split = 'train'), count(*) filter (split = 'test')) < 10 as low_count from s group by style")
def split_summary(spark, sf):
    return corpus.split_summary(corpus.split(pairs(spark, sf)))


@query(_SPLIT + ", o as (select style, pair_id, 'test' as split from s where try_cast(pair_id as bigint) % 7 = 0 union all select 'gone', 'x1', 'train')\nselect coalesce(s.style, o.style) as style, coalesce(s.pair_id, o.pair_id) as pair_id, coalesce(o.split, s.split) as split from s full join o on s.style = o.style and s.pair_id = o.pair_id")
def split_with_previous(spark, sf):
    p = pairs(spark, sf)
    old = corpus.split(p).filter(F.col("pair_id").cast("bigint") % 7 == 0).withColumn("split", F.lit("test"))
    return corpus.split(p, old.unionByName(spark.createDataFrame([("gone", "x1", "train")], "style string, pair_id string, split string")))


_STEMS = """with gt as (select source || '_' || (doc_id % 50) as stem from documents group by all), htr as (select source || '_' || (doc_id % 60) || '_' || doc_id as stem from documents),
 p as (select stem as htr_stem, string_split(stem, '_') as parts from htr), x as (select htr_stem, array_to_string(parts[1:i], '_') as stem from (select htr_stem, parts, unnest(range(1, len(parts) + 1)) as i from p)),
 j as (select gt.stem as gt_stem, htr_stem from gt join x on gt.stem = x.stem)"""


def _stems(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    s, d = F.col("source"), F.col("doc_id")
    return docs.select(F.concat(s, F.lit("_"), d % 50).alias("stem")).distinct(), docs.select(F.concat(s, F.lit("_"), d % 60, F.lit("_"), d).alias("stem"))


@query(_STEMS + "\nselect gt_stem, htr_stem from j")
def prefix_pairing(spark, sf):
    return corpus.prefix_pairs(*_stems(spark, sf))[0]


@query(_STEMS + "\nselect stem from gt where stem not in (select gt_stem from j)")
def missing_htr(spark, sf):
    return corpus.prefix_pairs(*_stems(spark, sf))[1]


@query(_STEMS + "\nselect stem from htr where stem not in (select htr_stem from j)")
def missing_gt(spark, sf):
    return corpus.prefix_pairs(*_stems(spark, sf))[2]


# ---- lines -------------------------------------------------------------------------------------------------------------

_LINES = r""", l as (select pair_id, style, string_split(gt, chr(10)) as g0, string_split(htr, chr(10)) as h0 from pairs),
 m as (select pair_id, style, g0[1:len(g0) - (g0[len(g0)] = '')::int] as g, h0[1:len(h0) - (h0[len(h0)] = '')::int] as h from l),
 z as (select *, [i for i in range(1, len(g) + 1) if trim(g[i]) = ''] as gb, [i for i in range(1, len(h) + 1) if trim(h[i]) = ''] as hb from m),
 shape as (select pair_id, style, len(g)::int as gl, len(h)::int as hl, len(gb)::int as gr, len([i for i in hb if list_contains(gb, i)])::int as hr, len([i for i in hb if not list_contains(gb, i)])::int as un from z),
 lined as (select *, gl - gr as ga, hl - hr as ha, abs((gl - gr) - (hl - hr)) as d, case when d = 0 then 'Stable' when d <= 1 then 'Minor mismatch' when d <= 3 then 'Moderate instability' else 'Severe instability' end as band,
   case when d > 3 then 'review_line_structure' when d > 1 or un > 0 then 'monitor_line_structure' else 'line_structure_ok' end as flag from shape)"""


@query(_LINES + "\nselect pair_id, style, gl as gt_original_line_count, hl as htr_original_line_count, gr as gt_blank_removed_count, hr as htr_blank_removed_matching_gt_count, un as htr_blank_preserved_unmatched_count, ga - ha as adjusted_delta_gt_minus_htr, band as line_structure_band, flag as line_structure_flag from lined")
def line_structure_counts(spark, sf):
    return line_structure(pairs(spark, sf)).select("pair_id", "style", "gt_original_line_count", "htr_original_line_count", "gt_blank_removed_count", "htr_blank_removed_matching_gt_count", "htr_blank_preserved_unmatched_count", "adjusted_delta_gt_minus_htr", "line_structure_band", "line_structure_flag")


@query(
    _LINES
    + """\nselect style, count(*) as docs, round(avg((band = 'Stable')::int), 6) as stable_share, round(avg((band = 'Minor mismatch')::int), 6) as minor_share, round(avg((band = 'Moderate instability')::int), 6) as moderate_share, round(avg((band = 'Severe instability')::int), 6) as severe_share,
 round(avg((un > 0)::int), 6) as unmatched_blank_share, median(d)::double as median_delta, list_sort(list(d))[least(count(*), ceil(0.9 * count(*))::bigint)]::double as p90_delta from lined group by style"""
)
def line_structure_by_style(spark, sf):
    return rounded(risk.line_structure_summary(line_structure(pairs(spark, sf))))


@query(_LINES + "\nselect pair_id, style, d::int as adjusted_line_delta_abs, band as line_structure_band from lined where band <> 'Stable' or un > 0")
def line_structure_flags(spark, sf):
    return risk.line_structure_flags(line_structure(pairs(spark, sf))).select("pair_id", "style", "adjusted_line_delta_abs", "line_structure_band")


# ---- corpus ------------------------------------------------------------------------------------------------------------


@query("\nselect style, count(*) as docs, round(count(*) / sum(count(*)) over (), 6) as share from pairs group by style")
def train_distribution(spark, sf):
    return rounded(corpus.distribution(pairs(spark, sf)))


@query("\nselect pair_id, style, row_number() over (order by style, pair_id) - 1 as pair_ord from pairs")
def pair_order(spark, sf):
    return corpus.ordered(pairs(spark, sf).select("pair_id", "style"))


def _p(x: str, p: float) -> str:
    return f"list_sort(list({x}))[least(floor(count(*) * {p})::bigint, count(*) - 1) + 1]::bigint"


@query(
    _LINES.split(",\n z as")[0]
    + f""", n as (select pair_id, style, [x for x in g if trim(x) <> ''] as l from m), d as (select style, len(l) as dl, list_sum([len([w for w in string_split_regex(x, '\\s+') if w <> '']) for x in l]) as dt, list_sum([length(x) for x in l]) as dc from n),
 e as (select style, unnest([length(x) for x in l]) as ll from n), q as (select style, {_p("ll", 0.25)} as line_len_p25, {_p("ll", 0.5)} as line_len_median, {_p("ll", 0.75)} as line_len_p75 from e group by style)
select d.style, count(*) as docs, sum(dl)::bigint as total_lines, sum(dt)::bigint as total_tokens, sum(dc)::bigint as total_chars, {_p("dl", 0.25)} as doc_lines_p25, {_p("dl", 0.5)} as doc_lines_median, {_p("dl", 0.75)} as doc_lines_p75,
 {_p("dt", 0.25)} as doc_tokens_p25, {_p("dt", 0.5)} as doc_tokens_median, {_p("dt", 0.75)} as doc_tokens_p75, any_value(line_len_p25) as line_len_p25, any_value(line_len_median) as line_len_median, any_value(line_len_p75) as line_len_p75 from d join q on d.style = q.style group by d.style"""
)
def corpus_geometry(spark, sf):
    return corpus.geometry(pairs(spark, sf))


def _at(p: float) -> str:
    return f"l[least(floor(n * {p})::bigint, n - 1) + 1]"


_TEXT_STATS = {"total": "n::double", "min": "l[1]", "median": "med", "p90": _at(0.9), "p95": _at(0.95), "max": "l[n]", **{f"percentile_{int(p * 100)}": f"case when metric = 'document' then {_at(p)} end" for p in corpus.PERCENTILES}}


@query(
    _LINES.split(",\n z as")[0]
    + """, n as (select [length(x) for x in h if trim(x) <> ''] as l from m), u as (select 'line' as metric, unnest(l)::double as v from n union all select 'document', len(l)::double from n),
 s as (select metric, list_sort(list(v)) as l, count(*) as n, median(v) as med from u group by metric), t as (select metric, unnest(["""
    + ", ".join(f"{{'stat': '{k}', 'value': {v}}}" for k, v in _TEXT_STATS.items())
    + """]) as x from s), k as (select metric, v, count(*) as c, row_number() over (partition by metric order by count(*) desc, v) as r from u group by metric, v)
select metric, x.stat as stat, x.value as value from t where x.value is not null union all select metric || '_length', v::bigint::varchar, c::double from k where r <= 20 union all
select 'line_bucket', case when v = 1 then '1' when v <= 3 then '2-3' when v <= 6 then '4-6' when v <= 10 then '7-10' when v <= 15 then '11-15' when v <= 25 then '16-25' else '26-999' end, count(*)::double from u where metric = 'document' and v between 1 and 999 group by 2"""
)
def text_diagnostics(spark, sf):
    return corpus.text_diagnostics(pairs(spark, sf))


# ---- alignment ---------------------------------------------------------------------------------------------------------


def step2(spark, sf):
    return align.alignment_issues(pairs(spark, sf))


_FOLD = "regexp_replace(lower({}), '[^a-z ]', '', 'g')"


@query(f", c as (select pair_id, {_FOLD.format('gt')} as a, {_FOLD.format('htr')} as b from pairs)\nselect pair_id, levenshtein(a, b)::int as distance from c")
def char_edit_distance(spark, sf):
    fold = lambda c: F.regexp_replace(F.lower(c), "[^a-z ]", "")
    return spread(pairs(spark, sf), "pair_id").select("pair_id", align.edit_distance(fold("gt"), fold("htr")).alias("distance"))


@query()
def step2_issues(spark, sf):
    return rounded(step2(spark, sf).drop("review"))


@query()
def step2_issue_counts(spark, sf):
    return issues.tag_histogram(step2(spark, sf))


@query()
def word_alignment_ops(spark, sf):
    return align.word_operations(pairs(spark, sf)).groupBy("style", "op").agg(F.count(F.lit(1)).alias("n"), F.sum("run").alias("words"))


@query()
def confusion_matrix(spark, sf):
    return issues.confusion_matrix(step2(spark, sf))


@query()
def dense_confusion_matrix(spark, sf):
    return issues.dense_matrix(settled(issues.confusion_matrix(step2(spark, sf))))


@query()
def char_confusions(spark, sf):
    return rounded(issues.char_confusions(step2(spark, sf)))


@query()
def bigram_confusions(spark, sf):
    return rounded(issues.bigram_confusions(step2(spark, sf)))


@query()
def word_confusions(spark, sf):
    return rounded(issues.word_confusions(step2(spark, sf)))


@query()
def confusion_contexts(spark, sf):
    return issues.confusion_contexts(settled(step2(spark, sf).select("pair_id", "style", "ordinal", "tag", "gt_text", "htr_text", "word_gt", "word_htr")))


@query()
def step1_step2_overlap(spark, sf):
    return issues.overlap_totals(step2(spark, sf))


@query()
def step1_step3_overlap(spark, sf):
    return issues.orthographic_overlap_totals(align.orthographic_overlaps(pairs(spark, sf)))


@query()
def posthoc_summary(spark, sf):
    p = pairs(spark, sf)
    return rounded(issues.posthoc(align.alignment_issues(p), align.orthographic_overlaps(p)))


def all_issues(spark, sf):
    p = pairs(spark, sf)
    keep = ["pair_id", "style", "tag", "start", "end"]
    rows = [rules.rule_issues(p, "S1"), align.alignment_issues(p), rules.rule_issues(p, "S3")]
    return rows[0].select(keep).unionByName(rows[1].select(keep)).unionByName(rows[2].select(keep))


@query()
def issue_index(spark, sf):
    return issues.issue_index(all_issues(spark, sf))


def _stage_sql(step: str) -> str:
    return " + ".join(f"len(regexp_extract_all(htr, '{p}'))" for p in RE2[step].values())


@query(f", c as (select pair_id, style, ({_stage_sql('S1')})::bigint as S1, ({_stage_sql('S3')})::bigint as S3 from pairs)\nselect pair_id, style, S1 + S3 as total_issues, S1, 0::bigint as S2, S3 from c where S1 + S3 > 0")
def issue_index_rules(spark, sf):
    p = pairs(spark, sf)
    return issues.issue_index(rules.rule_issues(p, "S1").select("pair_id", "style", "tag").unionByName(rules.rule_issues(p, "S3").select("pair_id", "style", "tag")))


@query()
def alignment_diagnostics(spark, sf):
    return issues.alignment_diagnostics(step2(spark, sf))


@query()
def drift_histogram(spark, sf):
    return issues.drift_histogram(issues.alignment_diagnostics(step2(spark, sf)))


@query()
def drift_rate(spark, sf):
    return issues.drift_report(settled(issues.alignment_diagnostics(step2(spark, sf))))[0]


@query()
def drift_top20(spark, sf):
    return issues.drift_report(settled(issues.alignment_diagnostics(step2(spark, sf))))[1]


@query()
def stage_overview(spark, sf):
    return rounded(issues.stage_overview(all_issues(spark, sf)))


@query(f", c as (select style, {_stage_sql('S1')} as n from pairs), s as (select style, sum(n) as issues, count(*) as docs from c group by style), p as (select *, issues / sum(issues) over () * 100 - docs / sum(docs) over () * 100 as pp from s)\nselect style, issues::bigint as issues, docs, round(pp, 6) as weight_pp, case when pp > 1 then 'Overweight' when pp < -1 then 'Underweight' else 'Balanced' end as weight from p")
def issue_distribution_by_style(spark, sf):
    p = pairs(spark, sf)
    return rounded(issues.issue_distribution(rules.rule_issues(p, "S1").select("style", "tag"), p))


# ---- topology ----------------------------------------------------------------------------------------------------------


def _events(spark, sf):
    return settled(step2(spark, sf).select("style", issues.operation().alias("op"), "line_bin", "document_bin"))


@query()
def line_topology(spark, sf):
    return rounded(issues.topology(_events(spark, sf), pairs(spark, sf), "line_bin"))


@query()
def document_topology(spark, sf):
    return rounded(issues.topology(_events(spark, sf), pairs(spark, sf), "document_bin"))


@query()
def topology_peaks(spark, sf):
    e, p = _events(spark, sf), pairs(spark, sf)
    rows = [issues.topology_peaks(issues.topology(e, p, f"{k}_bin")).withColumn("position", F.lit(k)) for k in ("line", "document")]
    return rounded(rows[0].unionByName(rows[1]))


@query(
    _spans_sql(("W", "P"))
    + ", e as (select p.style, tag as op, least(floor((a + (b - a) / 2.0) / length(l.htr) * 10), 9)::int as bin from located l join pairs p on p.pair_id = l.pair_id), d as (select style, count(*) as docs from pairs group by style), c as (select style, op, bin, count(*) as n from e group by all), q as (select style, unnest(['S1W', 'S1P']) as op from d)\nselect q.style, q.op, b.bin::int as bin, coalesce(n, 0)::bigint as n, round(coalesce(n, 0) / docs, 6) as events_per_doc from q cross join range(10) as b(bin) join d on d.style = q.style left join c on c.style = q.style and c.op = q.op and c.bin = b.bin"
)
def rule_topology(spark, sf):
    p = pairs(spark, sf)
    return rounded(issues.topology(rules.rule_issues(p, "S1", ["W", "P"]).select("style", "tag", "document_bin"), p, "document_bin", "tag", ops=("S1W", "S1P")))


@query()
def topology_profiles(spark, sf):
    e, p = _events(spark, sf), pairs(spark, sf)
    return issues.topology_profiles(*[settled(issues.topology(e, p, f"{k}_bin")) for k in ("line", "document")])


# ---- document metrics, risk, governance --------------------------------------------------------------------------------


def metrics(spark, sf):
    return align.document_metrics(pairs(spark, sf))


def summary(spark, sf):
    return risk.corpus_summary(settled(metrics(spark, sf).select(*risk.SUMMARY_COLUMNS)))


@query()
def doc_alignment_metrics(spark, sf):
    return rounded(metrics(spark, sf))


#: Latin letters beyond ASCII in the tables, and one-byte stand-ins: DuckDB's distance compares bytes
_NORM = "translate(regexp_replace(replace(lower({}), 'ß', 'ss'), '[^a-zéèñêíçóöüäáúàùôîâûëïœæ]', '', 'g'), 'éèñêíçóöüäáúàùôîâûëïœæ', 'ABCDEFGHIJKLMNOPQRSTUV')"
_WORDS = "len(regexp_extract_all(replace(lower({}), 'ß', 'ss'), '[a-zéèñêíçóöüäáúàùôîâûëïœæ]+'))"
_EDITS_SQL = f", n as (select pair_id, style, {_NORM.format('gt')} as ga_, {_NORM.format('htr')} as ha_ from pairs), e as (select pair_id, style, length(ga_)::int as ref_chars_norm, levenshtein(ga_, ha_)::int as edits, case when length(ga_) > 0 then levenshtein(ga_, ha_) / length(ga_)::double else 0.0 end as cer_norm from n)"


@query(_EDITS_SQL + "\nselect pair_id, style, ref_chars_norm, edits, round(cer_norm, 6) as cer_norm from e")
def cer(spark, sf):
    return rounded(metrics(spark, sf).select("pair_id", "style", "ref_chars_norm", "edits", "cer_norm"))


@query(
    _LINES
    + f""", c as (select pair_id, length(gt)::int as gt_chars, ({_stage_sql("S1")})::bigint as s1_issues, ({_stage_sql("S3")})::bigint as s3_issues, length({_NORM.format("gt")})::int as ref_chars_norm, {_WORDS.format("gt")}::int as ref_tokens_norm,
 len(regexp_extract_all(gt, '\\S+'))::int as gt_tokens, len(regexp_extract_all(htr, '\\S+'))::int as htr_tokens from pairs), w as (select *, case when ref_chars_norm > 0 then greatest(100, ceil(ref_chars_norm / 10.0))::int else 0 end as window_size from c)
select l.pair_id, l.style, gt_chars, ref_chars_norm, ref_tokens_norm, gt_tokens, htr_tokens, s1_issues, s3_issues, round(case when ref_chars_norm > 0 then s1_issues / ref_chars_norm::double * 1000 else 0 end, 6) as basic_anomaly_density,
 round(case when ref_chars_norm > 0 then s3_issues / ref_chars_norm::double * 1000 else 0 end, 6) as orthographic_violation_density, window_size, case when window_size > 0 then ceil(ref_chars_norm / window_size::double)::int else 0 end as window_count, ga::int as line_count,
 round(case when greatest(ga, ha) > 0 then least(ga, ha) / greatest(ga, ha)::double else 0 end, 6) as line_count_ratio, round(case when ga > 0 then un / ga::double else 0 end, 6) as unmatched_htr_blank_density, d::double as adjusted_line_delta from lined l join w on w.pair_id = l.pair_id"""
)
def document_sizes_and_densities(spark, sf):
    own = ["pair_id", "style", "gt_chars", "ref_chars_norm", "ref_tokens_norm", "gt_tokens", "htr_tokens", "s1_issues", "s3_issues", "basic_anomaly_density", "orthographic_violation_density", "window_size", "window_count", "line_count", "line_count_ratio", "unmatched_htr_blank_density", "adjusted_line_delta"]
    return rounded(metrics(spark, sf).select(own))


@query(
    _EDITS_SQL
    + "\nselect style, count(*) as docs, sum(ref_chars_norm)::bigint as ref_chars_norm, round(median(cer_norm), 6) as median_cer, round(list_sort(list(cer_norm))[least(count(*), ceil(0.9 * count(*))::bigint)], 6) as p90_cer, "
    + ", ".join(f"round(avg((cer_norm < {p / 100})::int), 6) as clean_lt_{p}_pct" for p in (1, 2, 5))
    + " from e group by style"
)
def style_cer(spark, sf):
    return rounded(risk.style_rows(settled(governed(spark, sf))).select("style", "docs", "ref_chars_norm", "median_cer", "p90_cer", "clean_lt_1_pct", "clean_lt_2_pct", "clean_lt_5_pct"))


@query(_EDITS_SQL + f"\nselect count(*) as docs, sum(ref_chars_norm)::bigint as ref_chars_norm, sum(edits)::bigint as edits, (select sum({_WORDS.format('gt')})::bigint from pairs) as tokens, round(avg(cer_norm), 6) as mean_cer, round(median(cer_norm), 6) as median_cer from e")
def corpus_cer(spark, sf):
    return rounded(summary(spark, sf).select("docs", "ref_chars_norm", "edits", "tokens", "mean_cer", "median_cer"))


@query(_EDITS_SQL + ", k as (select *, row_number() over (partition by style order by cer_norm desc, pair_id) as rank from e)\nselect style, pair_id, round(cer_norm, 6) as value, rank::int as rank from k where rank <= 10")
def top_cer_by_style(spark, sf):
    return rounded(risk.per_group_top(metrics(spark, sf), "style", {"top_cer": risk.STYLE_RANKINGS["top_cer"]}, "pair_id").drop("metric"))


@query()
def wer(spark, sf):
    return rounded(metrics(spark, sf).select("pair_id", "style", "wer_edits", "ref_tokens_norm", "wer_norm"))


@query()
def boundary_events(spark, sf):
    return metrics(spark, sf).groupBy("style").agg(*[F.sum(c).alias(c) for c in ("splits", "merges", "complex_boundary", "boundary_events", "gt_tokens", "htr_tokens")])


@query()
def boundary_examples(spark, sf):
    return align.boundary_examples(pairs(spark, sf))


@query()
def windowed_cer(spark, sf):
    return rounded(metrics(spark, sf).select("pair_id", "style", "window_size", "window_count", "window_max_cer", "window_sd_cer", "window_max_sdr"))


def governed(spark, sf):
    return risk.governance(risk.risk_index(metrics(spark, sf)))


@query()
def wide_risk(spark, sf):
    return rounded(risk.wide_risk(metrics(spark, sf)).select("pair_id", "style", "wide_risk_score", "wide_risk_rank", "wide_risk_band"))


@query()
def risk_index(spark, sf):
    return rounded(risk.risk_index(metrics(spark, sf)).select("pair_id", "style", *[f"risk_index_{m}_z" for m in RISK_WEIGHTS], "risk_score", "risk_rank_within_style", "risk_band", "risk_rank"))


#: The index, its weights and its flags over stand-ins for the four metrics that SQL can work out from whole texts: letters that are too many or
#: too few, the difference of lengths, lines that differ, the line delta.
_LETTERS = "aeonrt"
_NATIVE_SQL = (
    _LINES
    + ", q as (select pair_id, greatest(len(g), len(h)) as n_lines, len([i for i in range(1, greatest(len(g), len(h)) + 1) if g[i] is distinct from h[i]]) as n_other from m)"
    + ", v0 as (select p.pair_id, p.style, l.d::double as adjusted_line_delta_abs, l.band, l.flag, case when length(gt) > 0 then ("
    + " + ".join(f"abs((length(gt) - length(replace(gt, '{c}', ''))) - (length(htr) - length(replace(htr, '{c}', ''))))" for c in _LETTERS)
    + ") / length(gt)::double else 0.0 end as cer_norm, case when greatest(length(gt), length(htr)) > 0 then abs(length(gt) - length(htr)) / greatest(length(gt), length(htr))::double else 0.0 end as indel_disruption_rate, case when n_lines > 0 then n_other / n_lines::double else 0.0 end as continuity_risk, case when length(gt) > 0 then (" + _stage_sql("S1") + ") / length(gt)::double * 1000 else 0.0 end as basic_anomaly_density, case when length(gt) > 0 then (" + _stage_sql("S3") + ") / length(gt)::double * 1000 else 0.0 end as orthographic_violation_density from pairs p join lined l on p.pair_id = l.pair_id join q on p.pair_id = q.pair_id)"
    + ", v1 as (select *, "
    + ", ".join(f"median({m}) over (partition by style) as m_{m}" for m in RISK_WEIGHTS)
    + " from v0), v2 as (select *, "
    + ", ".join(f"median(abs({m} - m_{m})) over (partition by style) as d_{m}" for m in RISK_WEIGHTS)
    + " from v1), v3 as (select *, round("
    + " + ".join(f"({m} - m_{m}) / (case when d_{m} > 0 then d_{m} else 1 end) * {w}" for m, w in RISK_WEIGHTS.items())
    + ", 9) as risk_score from v2), v4 as (select *, row_number() over (partition by style order by risk_score desc, pair_id) as r, count(*) over (partition by style) as n, row_number() over (order by risk_score desc, pair_id) as risk_rank from v3), scored as (select *, case when n <= 3 then (case r when 1 then 'High' when 2 then 'Medium' else 'Low' end) when r <= ceil(n / 3) then 'High' when r <= ceil(2 * n / 3) then 'Medium' else 'Low' end as risk_band from v4)"
    + ", gov as (select *, concat_ws(';', case when indel_disruption_rate >= 0.15 then 'high_idr' end, case when flag = 'review_line_structure' or band = 'Severe instability' then 'severe_line_instability' end, case when 1 - continuity_risk <= 0.15 then 'very_low_continuity' end) as escalation_flags, case risk_band when 'Low' then 'Stable' when 'Medium' then 'Review' else 'Exclude' end as base, case when escalation_flags = '' then base when base = 'Stable' then 'Review' else 'Exclude' end as governance_status from scored)"
)


def native(spark, sf):
    p = line_structure(pairs(spark, sf), ("gt", "htr"))
    a, b, g, h = F.length("gt"), F.length("htr"), lines(newlines(F.col("gt"))), lines(newlines(F.col("htr")))
    letters = F.lit(0)
    for c in _LETTERS:
        letters = letters + F.abs((a - F.length(F.replace("gt", F.lit(c), F.lit("")))) - (b - F.length(F.replace("htr", F.lit(c), F.lit("")))))
    other = F.size(F.filter(F.arrays_zip(g.alias("g"), h.alias("h")), lambda x: ~x["g"].eqNullSafe(x["h"])))
    rows = p.select("pair_id", "style", "adjusted_line_delta_abs", "line_structure_band", "line_structure_flag", ratio(letters, a).alias("cer_norm"), ratio(F.abs(a - b), F.greatest(a, b)).alias("indel_disruption_rate"), ratio(other, F.greatest(F.size(g), F.size(h))).alias("continuity_risk"), *[(ratio(rules.rule_densities(step), a) * 1000).alias(name) for step, name in (("S1", "basic_anomaly_density"), ("S3", "orthographic_violation_density"))])
    return risk.governance(risk.risk_index(rows.withColumn("continuity", 1 - F.col("continuity_risk"))))


@query(_NATIVE_SQL + "\nselect pair_id, style, round(risk_score, 6) as risk_score, r as risk_rank_within_style, risk_band, risk_rank from scored")
def native_risk_index(spark, sf):
    return rounded(native(spark, sf).select("pair_id", "style", "risk_score", "risk_rank_within_style", "risk_band", "risk_rank"))


@query(_NATIVE_SQL + "\nselect style, count(*) as docs, count(*) filter (risk_band = 'High') as high, count(*) filter (risk_band = 'Medium') as medium, count(*) filter (risk_band = 'Low') as low, round(avg((risk_band = 'High')::int), 6) as high_share, round(avg((risk_band = 'Medium')::int), 6) as medium_share, round(avg((risk_band = 'Low')::int), 6) as low_share from scored group by style")
def risk_bands(spark, sf):
    return rounded(risk.band_summary(native(spark, sf), "risk_band", ["High", "Medium", "Low"]))


@query(_NATIVE_SQL + "\nselect pair_id, style, base as base_governance_status, escalation_flags, governance_status from gov")
def governance_status(spark, sf):
    return native(spark, sf).select("pair_id", "style", "base_governance_status", "escalation_flags", "governance_status")


@query(_NATIVE_SQL + ", f as (select style, unnest(string_split(case when escalation_flags = '' then 'no_escalation' else escalation_flags end, ';')) as flag from gov)\nselect style, flag, count(*) as docs from f group by all")
def escalation_summary(spark, sf):
    return risk.escalation_summary(native(spark, sf))


@query(_NATIVE_SQL + "\nselect style, count(*) as docs, count(*) filter (governance_status = 'Stable') as stable, count(*) filter (governance_status = 'Review') as review, count(*) filter (governance_status = 'Exclude') as exclude, round(avg((governance_status = 'Stable')::int), 6) as stable_share, round(avg((governance_status = 'Review')::int), 6) as review_share, round(avg((governance_status = 'Exclude')::int), 6) as exclude_share from gov group by style")
def governance_summary(spark, sf):
    return rounded(risk.band_summary(native(spark, sf), "governance_status", ["Stable", "Review", "Exclude"]))


@query()
def document_status_index(spark, sf):
    return rounded(governed(spark, sf).select("pair_id", "style", "governance_status", "index_derived_risk_band", "escalation_flags", "risk_score", "risk_rank_within_style", "cer_norm", "indel_disruption_rate", "continuity", "adjusted_line_delta_abs", "line_structure_band"))


@query()
def style_rows(spark, sf):
    return rounded(risk.style_rows(settled(governed(spark, sf))))


@query()
def corpus_summary(spark, sf):
    return rounded(summary(spark, sf))


@query()
def style_metrics(spark, sf):
    return rounded(risk.style_metrics(settled(risk.wide_risk(metrics(spark, sf)))))


@query()
def style_rankings(spark, sf):
    return rounded(risk.per_group_top(risk.wide_risk(metrics(spark, sf)), "style", risk.STYLE_RANKINGS, "pair_id"))


@query()
def report_metadata(spark, sf):
    docs = settled(metrics(spark, sf))
    return report.metadata(docs, all_issues(spark, sf), corpus.split(pairs(spark, sf)), "today", "documents", "2")


@query(
    _EDITS_SQL
    + """, o as (select style, edits as v, row_number() over (partition by style order by edits) as i, row_number() over (partition by style order by edits desc) as j, count(*) over (partition by style) as n from e)
select style, count(*) as docs, sum(v)::double as total_edits, round(case when sum(v) > 0 then 2 * sum(i * v) / (count(*) * sum(v)) - (count(*) + 1) / count(*) else 0 end, 6) as gini, round(sum(v) filter (j <= greatest(1, ceil(n * 0.10))) / sum(v), 6) as top_10pct_docs_share, round(sum(v) filter (j <= 5) / sum(v), 6) as top_5_docs_share from o group by style"""
)
def error_concentration(spark, sf):
    return rounded(stats.concentration(metrics(spark, sf), "style", "edits"))


@query(
    """with o as (select l_returnflag, l_quantity as v, row_number() over (partition by l_returnflag order by l_quantity) as i, row_number() over (partition by l_returnflag order by l_quantity desc) as j, count(*) over (partition by l_returnflag) as n from lineitem)
select l_returnflag, count(*) as docs, sum(v) as total_edits, round(2 * sum(i * v) / (count(*) * sum(v)) - (count(*) + 1) / count(*), 6) as gini, round(sum(v) filter (j <= ceil(n * 0.10)) / sum(v), 6) as top_10pct_docs_share, round(sum(v) filter (j <= 5) / sum(v), 6) as top_5_docs_share from o group by l_returnflag"""
)
def quantity_concentration(spark, sf):
    return rounded(stats.concentration(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_returnflag", "l_quantity"))


@query("with s as (select o_orderpriority as style, list_sort(list(o_totalprice)) as l, count(*) as n, median(o_totalprice) as med from orders group by all), d as (select o_orderpriority as style, median(abs(o_totalprice - med)) as mad from orders join s on o_orderpriority = style group by all)\nselect s.style, round(med, 6) as med, round(mad, 6) as mad, round(l[least(floor(n * 0.9)::bigint, n - 1) + 1], 6) as p1_90, round(l[least(n, ceil(n * 0.9)::bigint)], 6) as p2_90 from s join d on s.style = d.style")
def order_price_statistics(spark, sf):
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderpriority").alias("style"), "o_totalprice")
    center = stats.robust_center(rows, ["style"], ["o_totalprice"]).drop("metric")
    tails = stats.order_statistics(rows, ["style"], ["o_totalprice"], p1_90=stats.percentile(0.9), p2_90=stats.percentile_ceil(0.9)).drop("metric")
    return rounded(center.join(tails, "style"))


@query(_NATIVE_SQL + "\nselect pair_id, style, round(risk_score, 6) as risk_score from scored order by risk_score desc, style, pair_id limit 25")
def top_risk(spark, sf):
    return rounded(risk.top_by(native(spark, sf), [F.desc("risk_score"), F.col("style"), F.col("pair_id")], 25).select("pair_id", "style", "risk_score"))


@query(_NATIVE_SQL + ", u as (select style, pair_id, 'risk_score' as metric, risk_score as value from scored union all select style, pair_id, 'cer_norm', cer_norm from scored), k as (select *, row_number() over (partition by style, metric order by value desc, pair_id) as rank from u)\nselect style, pair_id, metric, round(value, 6) as value, rank::int as rank from k where rank <= 10")
def per_style_top10(spark, sf):
    return rounded(risk.per_group_top(native(spark, sf), "style", ["risk_score", "cer_norm"], "pair_id"))


# ---- sampling ----------------------------------------------------------------------------------------------------------

_SAMPLE_SQL = _NATIVE_SQL + ", t as (select *, row_number() over (partition by style, governance_status, risk_band order by risk_score desc, pair_id) as turn from gov), layer1 as (select * from t order by turn, style, governance_status, risk_band limit 75)"


@query(_SAMPLE_SQL + "\nselect pair_id, style, governance_status, risk_band, turn::int as turn from layer1")
def governance_sample(spark, sf):
    return sampling.governance_sample(native(spark, sf)).select("pair_id", "style", "governance_status", "risk_band", "turn")


@query(_SAMPLE_SQL + ", rest as (select *, row_number() over (partition by style order by md5('20260101:' || pair_id), pair_id) as place from gov where pair_id not in (select pair_id from layer1))\nselect pair_id, style, place::int as turn from rest where place <= 5")
def random_control(spark, sf):
    df = settled(native(spark, sf))
    return sampling.random_control(df, sampling.governance_sample(df)).select("pair_id", "style", "turn")


def layers(spark, sf):
    return sampling.layers(settled(governed(spark, sf)))


@query(_SAMPLE_SQL.replace("order by risk_score desc, pair_id) as turn", "order by md5('20260101:' || pair_id), pair_id) as turn") + "\nselect pair_id, style, governance_status, risk_band, turn::int as turn from layer1")
def governance_sample_random(spark, sf):
    return sampling.governance_sample(native(spark, sf), method="random").select("pair_id", "style", "governance_status", "risk_band", "turn")


@query()
def review_sample(spark, sf):
    return rounded(sampling.review_tables(layers(spark, sf))["review_sample_all"])


@query()
def review_packet(spark, sf):
    return sampling.review_tables(layers(spark, sf))["reviewer_1_packet"]


@query()
def review_label_schema(spark, sf):
    return sampling.review_tables(layers(spark, sf).limit(0))["review_label_schema"]


@query()
def file_copy_warnings(spark, sf):
    there = pairs(spark, sf).filter("pair_id % 2 = 0").select(F.concat(F.lit("files/"), F.col("pair_id").cast("string"), F.lit("_GT.txt")).alias("path"))
    return sampling.review_tables(layers(spark, sf), listing=there)["file_copy_warnings"]


_CASES = (
    ("flag = 'review_line_structure'", "5.0", "review_line_structure"),
    ("band = 'Severe instability'", "5.0", "severe_line_instability"),
    ("adjusted_line_delta_abs >= 4", "least(adjusted_line_delta_abs, 10)", "high_adjusted_line_delta"),
    ("1 - continuity_risk <= 0.15", "4.0", "very_low_continuity"),
    ("1 - continuity_risk > 0.15 and 1 - continuity_risk <= 0.35", "2.0", "low_continuity"),
    ("indel_disruption_rate >= 0.15", "3.0", "high_idr"),
    ("indel_disruption_rate < 0.15 and indel_disruption_rate >= 0.08", "1.5", "elevated_idr"),
    ("cer_norm >= 0.35", "3.0", "high_cer"),
    ("basic_anomaly_density > 0", "least(basic_anomaly_density / 5.0, 2)", "surface_anomaly_density"),
    ("orthographic_violation_density >= 10", "least(orthographic_violation_density / 10.0, 2)", "orthographic_violation_density"),
)
_CASE_SQL = _SAMPLE_SQL + ", sc as (select *, round(" + " + ".join(f"case when {t} then {x} else 0.0 end" for t, x, _ in _CASES) + ", 4) as score, concat_ws(';', " + ", ".join(f"case when {t} then '{n}' end" for t, _, n in _CASES) + ") as reasons from gov)"


@query(_CASE_SQL + "\nselect pair_id, style, score as diagnostic_case_score, reasons as selection_reason from sc")
def diagnostic_case_scores(spark, sf):
    score, reasons = sampling.case_score()
    return native(spark, sf).select("pair_id", "style", F.round(score, 4).alias("diagnostic_case_score"), reasons.alias("selection_reason"))


_LAYERS_SQL = (
    _CASE_SQL
    + ", r2 as (select *, row_number() over (partition by style order by md5('20260101:' || pair_id), pair_id) as place from gov where pair_id not in (select pair_id from layer1)), layer2 as (select * from r2 where place <= 5)"
    + ", r3 as (select *, row_number() over (partition by style order by score desc, pair_id) as turn from sc where score > 0 and pair_id not in (select pair_id from layer1) and pair_id not in (select pair_id from layer2)), layer3 as (select * from r3 where turn <= 10 order by (turn = 1) desc, score desc, pair_id limit 10)"
    + ", every as (select pair_id, style, governance_status, risk_band, 'governance_validation' as selection_layer from layer1 union all select pair_id, style, governance_status, risk_band, 'random_control' from layer2 union all select g.pair_id, g.style, g.governance_status, g.risk_band, 'diagnostic_case_study' from layer3 join gov g on g.pair_id = layer3.pair_id)"
)


@query(_LAYERS_SQL + "\nselect * from every")
def sample_layers(spark, sf):
    return sampling.layers(settled(native(spark, sf))).select("pair_id", "style", "governance_status", "risk_band", "selection_layer")


@query(
    _LAYERS_SQL
    + "\nselect 'total' as dimension, 'documents' as value, count(*) as docs from every union all select 'layer', selection_layer, count(*) from every group by 2 union all select 'style', style, count(*) from every group by 2 union all select 'document_status', governance_status, count(*) from every group by 2 union all select 'risk_band', risk_band, count(*) from every group by 2"
)
def layer_summary(spark, sf):
    return sampling.summary(sampling.layers(settled(native(spark, sf))).withColumn("reviewer_id", F.lit("none"))).filter("dimension <> 'reviewer'")


@query(_NATIVE_SQL + "\nselect pair_id, style, governance_status, risk_band as index_derived_risk_band, escalation_flags, round(risk_score, 6) as risk_score, r as risk_rank_within_style, adjusted_line_delta_abs::int as adjusted_line_delta_abs, band as line_structure_band, flag as line_structure_flag from gov")
def status_index(spark, sf):
    return rounded(native(spark, sf).select("pair_id", "style", "governance_status", "index_derived_risk_band", "escalation_flags", "risk_score", "risk_rank_within_style", "adjusted_line_delta_abs", "line_structure_band", "line_structure_flag"))


@query(_NATIVE_SQL + "\nselect pair_id, style, risk_band, governance_status as document_status from gov where governance_status = 'Review'")
def review_subset(spark, sf):
    return sampling.subsets(native(spark, sf))["Review"].select("pair_id", "style", "risk_band", "document_status")


@query()
def diagnostic_cases(spark, sf):
    df = settled(governed(spark, sf))
    return rounded(sampling.diagnostic_cases(df, sampling.governance_sample(df)).select("pair_id", "style", "diagnostic_case_score", "selection_reason"))


@query()
def reviewer_assignment(spark, sf):
    return sampling.assign_reviewers(layers(spark, sf))


@query()
def sample_summary(spark, sf):
    return sampling.review_tables(layers(spark, sf))["review_sample_summary"]


@query(_NATIVE_SQL + ", g as (select governance_status as s, style as y, count(*) as n from gov group by all)\nselect 'total' as category, '' as value, sum(n)::bigint as docs from g union all select 'status', s, sum(n)::bigint from g group by s union all select 'style', y, sum(n)::bigint from g group by y union all select 'status_style', s || ':' || y, n from g")
def subsets_summary(spark, sf):
    return sampling.subsets_summary(native(spark, sf))


@query(_NATIVE_SQL + ", k as (select *, row_number() over (partition by style order by risk_score desc, pair_id) - 1 as i from scored), w as (select distinct style, round_even(x.i * (n - 1) / 7.0, 0)::bigint as i from (select distinct style, n from scored) cross join range(8) as x(i))\nselect k.pair_id, k.style from k join w on k.style = w.style and k.i = w.i")
def evenly_spaced_sample(spark, sf):
    return sampling.evenly_spaced(native(spark, sf), 8).select("pair_id", "style")


@query("\nselect role as style, '' as tag, 0::bigint as n from conversations where false")
def empty_rule_counts(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").filter("false").select(F.col("role").alias("style"), F.col("text").alias("htr"))
    return rules.rule_counts(turns, "S1")

