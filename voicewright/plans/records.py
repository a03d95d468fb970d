"""Registered queries of record checks, responses, gates, codec rows and further text functions, with DuckDB SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import audio, codec, evaluation, hooks, intervals, items, pairing, quiet, scans, weighting
from ..sources import manifest
from . import catalog
from .catalog import CLIPS, GROUPED, PRIMARY, SPANS, UTT, clips, query, spans, table, utterances

# --- records ------------------------------------------------------------------------------------


@query("select o_orderkey as id, o_totalprice::double as duration from orders where (o_orderstatus = 'P' or o_totalprice between 50000 and 250000) and o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus <> 'F'".replace("o_totalprice::double", "case when o_orderstatus = 'P' then null else o_totalprice end::double"))
def filter_source_records(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice").cast("double")).alias("duration"), F.col("o_orderpriority").alias("language_id"), F.when(F.col("o_orderstatus") == "F", "valid").alias("split"))
    return manifest.filter_source_records(rows, ["1-URGENT", "2-HIGH"], "train", 50_000, 250_000).select("id", "duration")


@query("select l_orderkey as k, l_linenumber as n, 0.05::double as loss_weight, case when l_discount is not null and abs(l_discount - 0.05) > 1e-12 then 'source_weight_conflict' end as weight_error from lineitem")
def check_weight_conflict(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_discount").cast("double").alias("pseudo_label_weight"))
    return manifest.check_weight_conflict(rows, 0.05).select("k", "n", "loss_weight", "weight_error")


@query("select d.doc_id as id, case when l.quality is not null then 'label ' || l.quality else d.text end as text, l.toxic as toxic, case when l.quality is null then d.source end as loss_weight from documents d left join labels l on d.doc_id = l.doc_id")
def unwrap_label(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.struct(F.concat(F.lit("label "), "quality").alias("text"), "toxic").alias("label"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("loss_weight")).join(labels, "id", "left")
    return manifest.unwrap_label(rows).select("id", "text", "toxic", "loss_weight")


@query("""with e as (select event_id, value, case when event_type = 'error' then 1 - value else value end as s, value * 2 - 40 as t from events)
select event_id, case when t > s and s >= 0 and t >= 0 then round_even(s * 1000, 0)::bigint end as start_ms, case when t > s and s >= 0 and t >= 0 then round_even(t * 1000, 0)::bigint end as end_ms,
 case when s < 0 or t < 0 then 'bound_invalid' when t <= s then 'end_not_after_start' end as interval_error from e""")  # fmt: skip
def normalize_interval(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "error", 1 - F.col("value")).otherwise(F.col("value")).alias("start"), F.lit(7).alias("start_time"), ((F.col("value") * 2 - 40) * 1000).alias("end_ms"))
    return manifest.normalize_interval(rows).select("event_id", "start_ms", "end_ms", "interval_error")


@query("select o_orderkey as k, case when o_orderstatus = 'P' then 'p-' || o_custkey else 'c-' || o_custkey end as row_id from orders")
def resolve_row_id(spark, sf_dir):
    p = F.col("o_orderstatus") == "P"
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.when(~p, F.concat(F.lit("c-"), "o_custkey")).alias("id"), F.when(p, F.concat(F.lit("p-"), "o_custkey")).otherwise(F.concat(F.lit("c-"), "o_custkey")).alias("target_id"))
    return manifest.resolve_row_id(rows).select("k", "row_id")


@query("""with s as (select 'turns/' || (case when l.quality = 1 then 'v' || l.doc_id else 'stem-' || l.doc_id end) || '.json' as path from labels l), f as (select path, regexp_replace(split_part(path, '/', 2), '\\.[^.]*$', '') as b from s)
select d.doc_id, coalesce(x.path, y.path) as sidecar, case when x.path is null and y.path is null then 'sidecar_missing' end as sidecar_error from documents d left join f x on x.b = 'v' || d.doc_id left join f y on y.b = 'stem-' || d.doc_id""")  # fmt: skip
def locate_sidecar(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    files = labels.select(F.concat(F.lit("turns/"), F.when(F.col("quality") == 1, F.concat(F.lit("v"), "doc_id")).otherwise(F.concat(F.lit("stem-"), "doc_id")), F.lit(".json")).alias("path"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("v"), "doc_id").alias("video_id"), F.concat(F.lit("stem-"), "doc_id", F.lit(".mp4")).alias("name"))
    return manifest.locate_sidecar(docs, files).select("doc_id", "sidecar", "sidecar_error")


@query(f"""with {SPANS}, p as (select video_id, count(*) as n, count(*) filter (speaker = 'error') as o from iv group by 1)
select video_id, (case when video_id % 3 = 0 then n else n + o end)::int as regular, n::int as exclusive, null::varchar as timeline_error from p""")  # fmt: skip
def normalize_timeline_payload(spark, sf_dir):
    s, turn = spans(spark, sf_dir), F.struct("start_ms", "end_ms", "speaker")
    per = s.groupBy("video_id").agg(F.collect_list(turn).alias("t"), F.collect_list(F.when(F.col("speaker") == "error", turn)).alias("overlap_intervals"))
    rows = per.select("video_id", F.col("t").alias("turns"), "overlap_intervals", F.when(F.col("video_id") % 3 == 0, F.col("t")).alias("regular_timeline"))
    return intervals.normalize_timeline_payload(rows).select("video_id", F.size("regular_turns").alias("regular"), F.size("exclusive_turns").alias("exclusive"), "timeline_error")


@query(f"with {CLIPS} select item_id, case when duration_ms / 1000 >= 5 and duration_ms / 1000 < 10 then 0 when duration_ms / 1000 >= 10 then 1 else 2 end as band from clips order by band, item_id")
def priority_order(spark, sf_dir):
    return pairing.priority_order(clips(spark, sf_dir), F.col("duration_ms") / 1000, "5-10,10-").select("item_id", "band")


@query("select l_orderkey as k, l_linenumber as n from lineitem where l_tax > 0 and l_quantity / (l_tax * 100) between 2.0 and 10.0".replace("l_quantity / (l_tax * 100)", "l_quantity::double / (l_tax::double * 100)"))
def length_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("double").alias("samples"), (F.col("l_tax").cast("double") * 100).alias("rate"))
    return pairing.length_filter(rows, "samples", "rate", 2.0, 10.0).select("k", "n")


_CACHED = PRIMARY + """, old as (select id, model_id, status from sec where status = 'success'), new as (select id, 'fresh' as model_id, 'ok' as status from prim where length(text) > 60)"""


@query(f"with {_CACHED} select id as item_id, model_id, status from new union all select id, model_id, status from old anti join new using (id)")
def merge_reused_fresh(spark, sf_dir):
    old = catalog.secondary(spark, sf_dir).filter("status = 'success'").select(F.col("id").alias("item_id"), "model_id", "status")
    new = catalog.primary(spark, sf_dir).filter(F.length("text") > 60).select(F.col("id").alias("item_id"), F.lit("fresh").alias("model_id"), F.lit("ok").alias("status"))
    return pairing.merge_reused_fresh(old, new)


@query(f"""with {PRIMARY}, asr as (select id, hypothesis from sec where status = 'success'), todo as (select p.id, p.audio_sha256, a.hypothesis, p.text from prim p join asr a on a.id = p.id)
select id as item_id, hypothesis = text and length(text) > 20 as reused from todo""")  # fmt: skip
def reuse_quality_results(spark, sf_dir):
    prim = catalog.primary(spark, sf_dir)
    run = F.struct(F.when(F.col("status") == "success", "ok").otherwise("error").alias("status"), F.col("hypothesis").alias("transcript"))
    asr = catalog.secondary(spark, sf_dir).select(F.col("id").alias("item_id"), F.array(run).alias("runs"))
    seen = F.when(F.length("text") > 20, F.struct(F.lit(True).alias("speech_complete")))
    cached = prim.select(F.col("id").alias("item_id"), "audio_sha256", F.sha2("text", 256).alias("primary_transcript_sha256"), F.lit("ok").alias("status"), seen.alias("quality_assessment"), F.lit("Q").alias("prompt_id"), F.lit("y").alias("prompt_sha256"))
    old, new = pairing.reuse_quality_results(prim.select(F.col("id").alias("item_id"), "audio_sha256"), asr, cached, "Q", "y")
    return old.select("item_id", F.lit(True).alias("reused")).unionByName(new.select("item_id", F.lit(False).alias("reused")))


@query("""select d.doc_id as item_id, l.doc_id is not null and (l.quality = 0 or d.n_chars > 300) as reused from documents d left join labels l on l.doc_id = d.doc_id""")
def reuse_recovery_results(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.select(F.col("doc_id").alias("item_id"), F.sha2("text", 256).alias("audio_sha256"), "n_chars")
    initial = rows.select("item_id", F.lit(True).alias("detected"))
    cached = rows.join(labels.withColumnRenamed("doc_id", "item_id"), "item_id").select("item_id", F.col("audio_sha256").alias("original_audio_sha256"), F.lit(True).alias("initial_detected"), F.lit("c").alias("config_sha256"), F.when(F.col("quality") == 0, "rejected").otherwise("recovered").alias("status"), F.lit("a").alias("recovered_audio_sha256"), F.when(F.col("n_chars") > 300, "a").alias("present_sha256"))
    old, new = pairing.reuse_recovery_results(rows.drop("n_chars"), initial, cached, "c")
    return old.select("item_id", F.lit(True).alias("reused")).unionByName(new.select("item_id", F.lit(False).alias("reused")))


@query(f"""with {PRIMARY}, w as (select *, length(text) % 5 as k from prim) select id, case k when 1 then 'manifest_mixes_stages' when 2 then 'weight_violates_formula' when 3 then 'conflicting_weight_aliases' end as reason from w where k in (1, 2, 3)
union all select null, 'manifest_count_mismatch'""")  # fmt: skip
def verify_manifest(spark, sf_dir):
    k = F.length("text") % 5
    rows = catalog.primary(spark, sf_dir).select("id", F.when(k == 2, 0.9).otherwise(0.512).alias("pseudo_label_weight"), F.when(k == 3, 0.1).when(k != 0, F.when(k == 2, 0.9).otherwise(0.512)).alias("loss_weight"), F.struct(F.when(k == 1, "S").otherwise("R").alias("stage"), F.lit(0.2).alias("disagreement")).alias("reliability"))
    return weighting.verify_manifest(rows, accepted=1)


# --- gates and items ----------------------------------------------------------------------------


def gate_sql(candidates: str, turns: str) -> str:
    """Common table expressions of the gate over ``candidates`` (id, video_id, start_ms, end_ms), up to ``gate``."""
    return f"""tl as (select video_id, max(struct_pack(e := end_ms, s := start_ms, i := id)) as t from {candidates} group by 1),
cd as (select c.*, c.id = tl.t.i as is_tail, c.end_ms - c.start_ms as len from {candidates} c join tl on tl.video_id = c.video_id),
nd as (select *, least(100, greatest(0, len - greatest(case when is_tail then 300 else 200 end, least(len, 1)))) as col from cd),
ev as materialized (select *, 2 * start_ms + col as s, 2 * end_ms - col as e from nd),
tn as materialized (select video_id, 2 * start_ms as s, 2 * end_ms as e, case when speaker not in ('view', 'purchase') then speaker end as who, speaker = 'purchase' as forced from {turns}),
ht as materialized (select ev.id, greatest(ev.s, tn.s) as s, least(ev.e, tn.e) as e, who, forced from ev join tn on tn.video_id = ev.video_id and tn.s < ev.e and ev.s < tn.e),
bd as (select id, s as t from ev union select id, e from ev union select id, s from ht union select id, e from ht),
pc as (select * from (select id, t as s, lead(t) over (partition by id order by t) as e from bd) where e is not null),
ats as materialized (select pc.id, pc.s, pc.e, pc.e - pc.s as n, coalesce(list_sort(list_distinct(list(who) filter (who is not null))), []) as w, coalesce(bool_or(forced), false) as f from pc left join ht on ht.id = pc.id and ht.s < pc.e and pc.s < ht.e group by 1, 2, 3, 4),
st2 as materialized (select *, case when f or len(w) > 1 then 'overlap' when len(w) = 1 then 'single' else 'unknown' end as state from ats),
ex as (select id, w[1] as who, sum(n) as n from st2 where state = 'single' group by 1, 2),
tp as (select id, max(struct_pack(n := n, w := who)) as top, sum(n) as single from ex group by 1),
al as (select id, sum(n) as a, sum(case when state = 'overlap' then n else 0 end) as o, sum(case when state = 'unknown' then n else 0 end) as u, max(e) as fin, max(case when state <> 'unknown' then e end) as v, arg_max(struct_pack(s := state, w := w), e) filter (state <> 'unknown') as lv from st2 group by 1),
lim as (select ev.*, top.w as dom, coalesce(top.n, 0) as dn, coalesce(single, 0) as single, a, o, u, case when v is null then u else fin - v end as tr, lv, case when is_tail then 0.92 else 0.90 end as md, case when is_tail then 0.0 else 0.02 end as mo, case when is_tail then 300 else 200 end as ms from ev join al on al.id = ev.id left join tp on tp.id = ev.id),
sg as (select l.id, list(ex.who) as sig from lim l join ex on ex.id = l.id and ex.who is distinct from l.dom where ex.n / 2 > 100 and ex.n / l.a > 0.02 group by 1),
gate as (select l.*, list_filter([case when len < 200 then 'duration_too_short' end,
 case when dom is null then case when is_tail then 'tail_no_explicit_speaker' else 'no_explicit_speaker' end when dn / 2 < ms then case when is_tail then 'tail_speaker_evidence_too_short' else 'speaker_evidence_too_short' end end,
 case when (dom is not null)::int + coalesce(len(sig), 0) > 1 then 'multiple_speakers' end,
 case when dn / a + 1e-9 < md then p || 'dominant_coverage_below_min' end, case when (single - dn) / 2 > 100 and (single - dn) / a > 0.02 then p || 'other_speaker_ratio_exceeded' end,
 case when o / a > mo + 1e-9 then p || 'overlap_ratio_exceeded' end, case when u / a > 0.08 + 1e-9 then p || 'unknown_ratio_exceeded' end, case when is_tail and tr / 2 > 200 then 'tail_trailing_unknown_exceeded' end,
 case when is_tail and not coalesce(lv.s = 'single' and len(lv.w) = 1 and (lv.w[1] = dom or not list_contains(coalesce(sig, []), lv.w[1])), false) then 'tail_last_voice_not_dominant' end], lambda x: x is not null) as reasons
 from (select *, case when is_tail then 'tail_' else '' end as p from lim) l left join sg on sg.id = l.id)"""


def _gate_turns(spark, sf_dir):
    """Turns of which some name nobody and some are marked as crosstalk."""
    kind = F.col("speaker")
    return spans(spark, sf_dir).withColumns({"speaker": F.when(kind == "view", "UNK").when(kind == "purchase", "OVL").otherwise(kind)})


@query(f"with {SPANS}, {gate_sql('iv', 'iv')} select id, is_tail, array_to_string(reasons, ',') as reasons, dom as dominant_speaker, round_even(dn / a, 6) as dominant_ratio, round_even((single - dn) / a, 6) as other_speaker_ratio, round_even(o / a, 6) as overlap_ratio, round_even(u / a, 6) as unknown_ratio, tr / 2 as trailing_unknown_ms, lv.s as last_voice_state from gate")
def speaker_gate(spark, sf_dir):
    g = intervals.speaker_gate(spans(spark, sf_dir).select("id", "video_id", "start_ms", "end_ms"), _gate_turns(spark, sf_dir))
    return g.select("id", "is_tail", F.array_join("gate.reasons", ",").alias("reasons"), *(f"gate.{c}" for c in ("dominant_speaker", "dominant_ratio", "other_speaker_ratio", "overlap_ratio", "unknown_ratio", "trailing_unknown_ms", "last_voice_state")))


_REFRESHED = GROUPED + f""", it as (select video_id, first_id, min(struct_pack(s := start_ms, e := end_ms, i := id)).s as start_ms, max(struct_pack(s := start_ms, e := end_ms, i := id)).e as end_ms, bool_or(overlapped) as crossed from grouped group by 1, 2),
cand as (select video_id || '-' || first_id as id, video_id, start_ms, end_ms, crossed from it), {gate_sql('cand', 'iv')},
rf as (select gate.id, crossed, list_filter([case when crossed then 'overlap_detected' end, case when len(reasons) > 0 then 'speaker_gate_failed' end, case when len(list_filter(reasons, lambda r: r = 'multiple_speakers' or contains(r, 'other_speaker') or contains(r, 'overlap'))) > 0 then 'broadcast_crosstalk_detected' end], lambda x: x is not null) as sf,
 list_filter([case when len < 1000 then 'too_short' end, case when len > 15000 then 'too_long' end], lambda x: x is not null) as df, list_filter([case when len < 500 then 'below_asr_min_duration' end, case when len > 15000 then 'too_long' end], lambda x: x is not null) as af, len from gate)"""


def _refreshed(spark, sf_dir):
    grouped = intervals.group_candidates(intervals.overlap_flags(spans(spark, sf_dir))).withColumn("text", F.lit("said"))
    built = items.build_items(grouped)
    gate = intervals.speaker_gate(built.select(F.col("group_id").alias("id"), "video_id", "start_ms", "end_ms"), _gate_turns(spark, sf_dir)).select(F.col("id").alias("group_id"), F.col("gate.reasons").alias("gate_reasons"))
    return items.refresh_eligibility(built.join(gate, "group_id"))


@query(f"with recursive {_REFRESHED} select id, array_to_string(sf, ',') as speaker_flags, array_to_string(list_concat(sf, df), ',') as quality_flags, len(sf) = 0 and len(af) = 0 as asr_eligible, array_to_string(list_concat(sf, af), ',') as asr_ineligible_reasons from rf")
def refresh_eligibility(spark, sf_dir):
    r = _refreshed(spark, sf_dir)
    return r.select(F.col("group_id").alias("id"), F.array_join("speaker_quality_flags", ",").alias("speaker_flags"), F.array_join("quality_flags", ",").alias("quality_flags"), "asr_eligible", F.array_join("asr_ineligible_reasons", ",").alias("asr_ineligible_reasons"))


@query(f"with recursive {_REFRESHED} select id from rf where len(af) = 0")
def select_asr_attempts(spark, sf_dir):
    return items.select_asr_attempts(_refreshed(spark, sf_dir), include_speaker_rejected=True).select(F.col("group_id").alias("id"))


@query(f"""with {SPANS}, sp as (select id, video_id, start_ms - 300 as start_ms, end_ms + 300 as end_ms from iv where speaker = 'view'),
ht as materialized (select sp.id, sp.video_id, greatest(sp.start_ms, iv.start_ms) as s, least(sp.end_ms, iv.end_ms) as e, speaker from sp join iv on iv.video_id = sp.video_id and iv.start_ms < sp.end_ms and sp.start_ms < iv.end_ms),
bd as (select id, video_id, start_ms as t from sp union select id, video_id, end_ms from sp union select id, video_id, s from ht union select id, video_id, e from ht),
pc as (select * from (select id, video_id, t as s, lead(t) over (partition by id order by t) as e from bd) where e is not null),
fp as (select pc.id, pc.video_id, pc.s, pc.e, coalesce(list_sort(list_distinct(list(speaker) filter (speaker is not null))), []) as w from pc left join ht on ht.id = pc.id and ht.s < pc.e and pc.s < ht.e group by 1, 2, 3, 4),
n as (select *, row_number() over (partition by video_id order by s, e, id) as piece, count(*) over (partition by video_id) as many from fp)
select id as segment_id, video_id, s as start_ms, e as end_ms, case len(w) when 0 then 'unknown' when 1 then 'single' else 'overlap' end as state, array_to_string(w, '+') as speakers, piece, piece = many as is_last from n""")  # fmt: skip
def fuse_speech(spark, sf_dir):
    s = spans(spark, sf_dir)
    speech = s.filter("speaker = 'view'").withColumns({"start_ms": F.col("start_ms") - 300, "end_ms": F.col("end_ms") + 300})
    return intervals.fuse_timelines(speech, s).withColumn("speakers", F.array_join("speakers", "+"))


@query(f"""with {SPANS}, sp as (select id, video_id, start_ms - 300 as start_ms, end_ms + 300 as end_ms from iv where speaker = 'view'),
ht as materialized (select sp.id, greatest(sp.start_ms, iv.start_ms) as s, least(sp.end_ms, iv.end_ms) as e, iv.start_ms as f, iv.end_ms as t, speaker from sp join iv on iv.video_id = sp.video_id and iv.start_ms < sp.end_ms and sp.start_ms < iv.end_ms),
b as (select id, start_ms as pl from sp union all select id, end_ms from sp union all select id, s from ht union all select id, e from ht),
r as (select *, case when pl - lag(pl) over (partition by id order by pl) <= 150 then 0 else 1 end as f from b), c as (select *, sum(f) over (partition by id order by pl rows unbounded preceding) as k from r),
m as (select c.id, case when min(pl) = any_value(sp.start_ms) then any_value(sp.start_ms)::double when max(pl) = any_value(sp.end_ms) then any_value(sp.end_ms)::double else avg(pl) end as pl from c join sp on sp.id = c.id group by c.id, k),
p as (select id, pl from m union select id, start_ms::double from sp union select id, end_ms::double from sp), q as (select id, pl, lead(pl) over (partition by id order by pl) as nx from p),
z as (select q.id, pl, nx, coalesce(list_sort(list_distinct(list(speaker) filter (speaker is not null))), []) as w from q left join ht on ht.id = q.id and ht.f <= (pl + nx) / 2 and ht.t > (pl + nx) / 2 where nx is not null group by 1, 2, 3),
n as (select z.id, video_id, round_even(pl, 0)::bigint as start_ms, round_even(nx, 0)::bigint as end_ms, w from z join sp on sp.id = z.id),
o as (select *, row_number() over (partition by video_id order by start_ms, end_ms, id) as piece, count(*) over (partition by video_id) as many from n)
select id as segment_id, video_id, start_ms, end_ms, case len(w) when 0 then 'unknown' when 1 then 'single' else 'overlap' end as state, array_to_string(w, '+') as speakers, piece, piece = many as is_last from o""")  # fmt: skip
def fuse_with_tolerance(spark, sf_dir):
    s = spans(spark, sf_dir)
    speech = s.filter("speaker = 'view'").withColumns({"start_ms": F.col("start_ms") - 300, "end_ms": F.col("end_ms") + 300})
    return intervals.fuse_timelines(speech, s, 150).withColumn("speakers", F.array_join("speakers", "+"))


# --- models of the caller -----------------------------------------------------------------------


def _reader():
    """A stand-in for a recogniser: it refuses whole batches with shouted texts, and such a text alone."""
    def read(rows: list[dict]) -> list[dict]:
        if any("!!" in (r["text"] or "") for r in rows):
            raise ValueError("shouting")
        return [{"n_words": len((r["text"] or "").split(" ")), "start": (r["text"] or "")[:12]} for r in rows]

    return read


@query("""select doc_id, case when contains(coalesce(text, ''), '!!') then null else len(string_split(coalesce(text, ''), ' ')) end as n_words, case when contains(coalesce(text, ''), '!!') then null else left(coalesce(text, ''), 12) end as start,
 case when contains(coalesce(text, ''), '!!') then 'error' else 'ok' end as status, case when contains(coalesce(text, ''), '!!') then 'ValueError: shouting' end as error, 'reader-1' as model_id from documents""")
def with_model(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return hooks.with_model(docs, _reader, ("text",), "n_words long, start string", "reader-1", batch_bytes=50_000, keys={"model_id": "reader-1"}).drop("text")


@query("""select event_id as id, array_to_string(list_filter(list_transform(range(1, 6), lambda i: case when l[i] is not null and l[i] <> 'click' and list_position(l, l[i]) = i then l[i] end), lambda x: x is not null), ',') as found
from (select event_id, [case when value > 50 then 'loud' end, event_type, case when value > 20 then 'view' end, 'seen', case when value > 80 then 'loud' end] as l from events)""")
def ordered_distinct_reasons(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    one = lambda *rules: F.array_compact(F.array(*rules))
    a, b = one(F.when(F.col("value") > 50, "loud"), F.col("event_type")), one(F.when(F.col("value") > 20, "view"), F.lit("seen"), F.when(F.col("value") > 80, "loud"))
    return e.select(F.col("event_id").alias("id"), F.array_join(evaluation.ordered_reasons(a, b, without=F.array(F.lit("click"))), ",").alias("found"))


@query("select c_custkey as id, c_nationkey as nation from customer")
def assert_unique(spark, sf_dir):
    return weighting.once(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation")), what="customers")


@query("""with s as (select vec_id, i, least(1.0, greatest(-1.0, embedding[i + 1]::double * 8)) as x from (select vec_id, embedding, unnest(range(64)) as i from embeddings)),
l as (select *, abs(x) >= 0.999 as fl, 10 * log10(greatest(x * x, 1e-12)) as level from s), r as (select *, i - row_number() over (partition by vec_id, fl order by i) as run from l),
m as (select vec_id, coalesce(max(n), 0) as longest from (select vec_id, run, count(*) filter (fl) as n from r group by 1, 2, fl) group by 1),
q as (select vec_id, avg(fl::int) as ratio, quantile_cont(level, 0.9) - quantile_cont(level, 0.2) as snr from l group by 1)
select q.vec_id::varchar as item_id, array_to_string(list_filter([case when ratio > 0.01 or longest > 0.192 then 'clipping_detected' end, case when snr < 8 then 'low_snr_detected' end], lambda x: x is not null), ',') as reasons, round(ratio, 9) as clipped_ratio, round(snr, 6) as snr_db from q join m on m.vec_id = q.vec_id""")
def audio_quality(spark, sf_dir):
    scaled = F.transform("embedding", lambda x: F.least(F.lit(1.0), F.greatest(F.lit(-1.0), x.cast("double") * 8)))
    clips_ = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.lit(64).alias("rate"), scaled.alias("samples"))
    return audio.audio_quality(clips_).select("item_id", F.array_join("reasons", ",").alias("reasons"), F.round("clipped_ratio", 9).alias("clipped_ratio"), F.round("snr_db", 6).alias("snr_db"))


@query("""with d as (select doc_id, lang as mode, n_chars / 100.0::double as s from documents), o as (select mode, list({'no': null::bigint, 'open': doc_id, 'used': s::double} order by s desc, doc_id) as rs from d group by 1),
f as (select mode, rs, list_reduce(list_prepend([{'no': null::bigint, 'open': 0::bigint, 'used': 0.0::double}], list_transform(rs, lambda r: [r])), lambda a, y:
  case when y[1].used > 60 then list_append(a, {'no': null::bigint, 'open': a[-1].open, 'used': a[-1].used}) when a[-1].used + y[1].used > 60 then list_append(a, {'no': a[-1].open + 1, 'open': a[-1].open + 1, 'used': y[1].used})
  else list_append(a, {'no': a[-1].open, 'open': a[-1].open, 'used': a[-1].used + y[1].used}) end) as b from o),
u as (select mode, unnest(range(1, len(rs) + 1)) as i, unnest(rs) as r, unnest(b[2:]) as x from f)
select r.open as item_id, mode || '-0-' || coalesce(x.no::varchar, 'alone-' || (row_number() over (partition by mode, x.no is null order by i) - 1)) as batch from u""")
def duration_batches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("lang").alias("mode"), (F.col("n_chars") / 100).alias("seconds"))
    return audio.duration_batches(docs, 60.0).select("item_id", "batch")


# --- responses ----------------------------------------------------------------------------------


@query(r"""select event_id, case when event_type in ('view', 'click') then trim('said ' || event_id || ' ') end as transcript, case when event_type in ('view', 'click') then (case when event_type = 'view' then 0 else 2 end) end as spans,
 case when event_type in ('view', 'click') then null when event_type = 'purchase' then 'transcript_not_a_string' when event_type = 'error' then 'uncertain_spans_not_a_string_array' else 'no_json_object' end as error from events""")  # fmt: skip
def parse_asr_response(spark, sf_dir):
    kind, said = F.col("event_type"), F.concat(F.lit("said "), "event_id")
    answer = (
        F.when(kind == "view", F.concat(F.lit('```json\n{"transcript": " '), said, F.lit(' ", "uncertain_spans": []}\n```')))
        .when(kind == "click", F.concat(F.lit('Here: {"language": "my", "transcript": "'), said, F.lit('", "uncertain_spans": ["a", "b"]} done')))
        .when(kind == "purchase", '{"transcript": 5, "uncertain_spans": []}')
        .when(kind == "error", '{"transcript": "x", "uncertain_spans": [1]}')
        .otherwise("no object at all")
    )
    r = table(spark, sf_dir, "events").select("event_id", text.parse_asr_response(answer).alias("r"))
    return r.select("event_id", "r.transcript", F.when(F.col("r.error").isNull(), F.size("r.uncertain_spans")).alias("spans"), "r.error")


@query(r"""select event_id, case when event_type in ('view', 'click') then event_type = 'view' end as low_snr, case when event_type in ('view', 'click') then null when event_type = 'purchase' then 'clipping_not_a_boolean' when event_type = 'error' then 'quality_assessment_missing' else 'no_json_object' end as error from events""")
def parse_quality_response(spark, sf_dir):
    kind = F.col("event_type")
    whole = lambda low, clip: '{"quality_assessment": {' + ", ".join(f'"{f}": {low if f == "low_snr" else clip if f == "clipping" else "false"}' for f in text.QUALITY_FIELDS) + "}}"
    answer = F.when(kind == "view", whole("true", "true")).when(kind == "click", whole("false", "true")).when(kind == "purchase", whole("true", '"no"')).when(kind == "error", '{"quality": 1}').otherwise("[1]")
    r = table(spark, sf_dir, "events").select("event_id", text.parse_quality_response(answer).alias("r"))
    return r.select("event_id", "r.assessment.low_snr", "r.error")


# --- codec rows ---------------------------------------------------------------------------------

_TOKENS = "tok as (select vec_id, list_transform(range(0, 4), lambda k: list_transform(embedding[k * 8 + 1 : k * 8 + 8], lambda x: floor(abs(x::double) * 2000)::int)) as t from embeddings)"


def _tokens(spark, sf_dir):
    row = lambda k: F.transform(F.slice("embedding", k * 8 + 1, 8), lambda x: F.floor(F.abs(x.cast("double")) * 2000).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array(*(row(k) for k in range(4))).alias("target_tokens"))


@query(f"""with {_TOKENS}, j as (select vec_id, list_max(flatten(t)) as most from tok) select vec_id, case when vec_id % 7 = 0 then 'needs_explicit_target_and_reference' when vec_id % 5 = 0 then 'target_and_reference_same_audio' when vec_id % 50 > 40 then 'target_duration_out_of_range' when vec_id % 30 > 20 then 'prompt_duration_out_of_range'
 when most >= 1024 then 'invalid_target_tokens' when vec_id % 11 = 0 then 'invalid_prompt_tokens' end as reason from j""")  # fmt: skip
def validate_codec_rows(spark, sf_dir):
    v, given = F.col("vec_id"), F.lit("x")
    rows = _tokens(spark, sf_dir).withColumns({
        "audio_path": F.when(v % 7 != 0, given), "prompt_audio_path": given, "text": given, "prompt_text": given, "audio_sha256": given, "prompt_audio_sha256": F.when(v % 5 == 0, given).otherwise("y"),
        "duration": (v % 50) / 2, "prompt_duration": (v % 30 + 2) / 2, "prompt_tokens": F.when(v % 11 != 0, F.array(*[F.array(F.lit(1), F.lit(2))] * 4)).otherwise(F.array(F.array(F.lit(1)))),
    })
    rows = rows.withColumn("duration", F.when(v % 50 > 40, 21.0).otherwise(5.0)).withColumn("prompt_duration", F.when(v % 30 > 20, 0.5).otherwise(5.0))
    return rows.select("vec_id", codec.validate_codec_rows(4, 1024).alias("reason"))


_U = "(('0x' || substr(sha256({}), 1, 16))::ubigint::double / 18446744073709551616.0)"


@query(f"""with {_TOKENS}, r as (select vec_id, t, {_U.format("'ratio:3:' || vec_id")} as ratio, {_U.format("'drop:3:' || vec_id")} < 0.1 as dropped from tok),
x as (select vec_id, ratio, dropped, k, unnest(t[k + 1]) as v, generate_subscripts(t[k + 1], 1) - 1 as i from (select *, unnest(range(0, 4)) as k from r)),
m as (select *, {_U.format("'mask:3:' || vec_id || ':' || k || ':' || i")} < ratio as masked from x)
select vec_id, round(any_value(ratio), 9) as ratio, any_value(dropped) as condition_dropped, sum(case when masked then 1024 else v end)::bigint as inputs, sum(case when masked then v else -100 end)::bigint as labels from m group by 1""")  # fmt: skip
def mask_targets(spark, sf_dir):
    out = codec.mask_targets(_tokens(spark, sf_dir), 1024, 3, id_column="vec_id")
    total = lambda c: F.aggregate(F.flatten(c), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return out.select("vec_id", F.round("ratio", 9).alias("ratio"), "condition_dropped", total("inputs").alias("inputs"), total("labels").alias("labels"))


@query("with g as (select vec_id, (row_number() over (order by sha256('42:' || vec_id), vec_id) - 1) // 100 as shard from embeddings where label <> 3) select vec_id as id, shard::bigint as shard, null as reason from g union all select vec_id, null, 'label 3' from embeddings where label = 3")
def write_token_shards(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") == 3, "error").otherwise("success").alias("status"), F.when(F.col("label") == 3, "label 3").alias("error_msg"))
    shards, bad = codec.write_token_shards(rows, 100)
    return shards.select("id", "shard", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("id", F.lit(None).cast("long").alias("shard"), "reason"))


@query("select l_returnflag, round(sum(l_discount), 4)::double as synthesis_seconds, round(sum(case when l_returnflag = 'N' then 0 else l_tax end), 4)::double as audio_seconds, round(case when sum(case when l_returnflag = 'N' then 0 else l_tax end) > 0 then sum(l_discount) / sum(case when l_returnflag = 'N' then 0 else l_tax end) end, 6)::double as rtf from lineitem group by 1")
def rtf_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_discount").cast("double").alias("synthesis_seconds"), F.when(F.col("l_returnflag") != "N", F.col("l_tax").cast("double")).otherwise(0.0).alias("audio_seconds"))
    return codec.rtf_summary(rows, ["l_returnflag"]).withColumns({"synthesis_seconds": F.round("synthesis_seconds", 4), "audio_seconds": F.round("audio_seconds", 4), "rtf": F.round("rtf", 6)})


@query(f"""with {CLIPS}, e as (select audio_sha256, count(*) as uses, min(item_id) as first_id from clips group by 1) select c.item_id, e.first_id as target_code, p.first_id as prompt_code,
 case when e.first_id like '%-7' then 'audio_bytes_differ_from_digest' when c.lang = 'fr' then 'prompt_not_encoded' when c.audio_sha256 = pr then 'target_and_reference_same_audio' end as encode_error
 from (select item_id, audio_sha256, speaker_id as lang, case when speaker_id = 'fr' then 'none' else sha256('prompt ' || speaker_id) end as pr from clips) c join e on e.audio_sha256 = c.audio_sha256 left join (select * from (select sha256('prompt ' || x) as s, x as first_id from (values ('en'), ('de'), ('es')) v(x))) p on p.s = c.pr""")  # fmt: skip
def with_encoded(spark, sf_dir):
    c = clips(spark, sf_dir)
    once = c.groupBy("audio_sha256").agg(F.min("item_id").alias("code"))
    prompts = spark.createDataFrame([("en",), ("de",), ("es",)], "code string").select(F.sha2(F.concat(F.lit("prompt "), "code"), 256).alias("audio_sha256"), "code")
    encoded = once.unionByName(prompts).withColumn("actual_sha256", F.when(F.col("code").like("%-7"), "other").otherwise(F.col("audio_sha256")))
    pairs = c.select("item_id", "audio_sha256", F.when(F.col("speaker_id") == "fr", "none").otherwise(F.sha2(F.concat(F.lit("prompt "), "speaker_id"), 256)).alias("prompt_audio_sha256"))
    return pairing.with_encoded(pairs, encoded, columns=("code",)).select("item_id", "target_code", "prompt_code", "encode_error")


# --- audio --------------------------------------------------------------------------------------


@query("""with f as (select vec_id as path, unnest(embedding)::double * 100 - 40 as db, generate_subscripts(embedding, 1) - 1 as frame from embeddings),
t as (select path, least(greatest(quantile_cont(db, 0.2) + 6.0, -60.0), -20.0) as th, (max(frame) + 1) * 10 as lim from f group by 1),
l as (select f.path, frame, case when frame - lag(frame) over (partition by f.path order by frame) - 1 <= 3 then 0 else 1 end as fr from f join t on t.path = f.path where db >= th),
r as (select *, sum(fr) over (partition by path order by frame) as run from l), s as (select path, min(frame) * 10 as s, (max(frame) + 1) * 10 as e from r group by path, run having (max(frame) + 1) * 10 - min(frame) * 10 >= 50),
p as (select s.path, greatest(0, s - 20) as s, least(lim, e + 20) as e from s join t on t.path = s.path),
m as (select *, case when s - max(e) over (partition by path order by s, e rows between unbounded preceding and 1 preceding) <= 30 then 0 else 1 end as f from p), g as (select *, sum(f) over (partition by path order by s, e) as k from m)
select path, min(s)::bigint as start_ms, max(e)::bigint as end_ms, count(*) as parts from g group by path, k""")  # fmt: skip
def speech_runs(spark, sf_dir):
    frames = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("path"), F.posexplode("embedding").alias("frame", "x")).select("path", F.col("frame").cast("long").alias("frame"), (F.col("x").cast("double") * 100 - 40).alias("rms_dbfs"))
    return audio.speech_runs(frames, "path", min_silence_ms=30, min_speech_ms=50, pad_ms=20, merge_gap_ms=30)


#: Vectors of a label are the frames of one recording: 64 of 10 ms each.
_FRAMES = """v as (select label as path, embedding, row_number() over (partition by label order by vec_id) - 1 as n, vec_id from embeddings),
f as (select path, n * 64 + unnest(range(64)) as frame, unnest(embedding)::double * 100 - 40 as db from v),
pw as (select path, list(pow(10.0, db / 10) order by frame) as pw from f group by 1)"""


def _level(first: str, last: str) -> str:
    """Mean power of the frames around ``f``, within bounds."""
    return f"10 * log10(greatest(list_avg(pw[greatest(f - 9, {first}) + 1:least(f + 9, {last}) + 1]), 1e-12))"


def _quietest(lower: str, upper: str, target: str, scale: str, first: str, last: str) -> str:
    found = f"list_transform(range({lower} // 10 + case when {lower} % 10 > 0 then 1 else 0 end, least({upper} // 10, len(pw) - 1) + 1), lambda f: {{'a': round({_level(first, last)} + 1.5 * abs(f * 10 - {target}) / {scale}, 9), 'b': abs(f * 10 - {target}), 'c': f * 10}})"
    return f"list_sort({found})[1].c"


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")
    placed = scans.ranked(e, ["label"], scans.time_levels("vec_id", (4_096, 64)), ["vec_id"], "n")
    return placed.select(F.col("label").alias("path"), "n", "vec_id", F.posexplode("embedding").alias("i", "x")).select("path", "n", "vec_id", (F.col("n") * 64 + F.col("i")).alias("frame"), (F.col("x").cast("double") * 100 - 40).alias("rms_dbfs"))


_CUT = f"list_transform([{{'c': acc[-1], 't': acc[-1] + 1200, 'lo': greatest(acc[-1] + 200, acc[-1] + 900), 'up': least(acc[-1] + 3000, e - 200, acc[-1] + 1500)}}], lambda w: coalesce({_quietest('w.lo', 'w.up', 'w.t', '300', '0', 'len(pw)')}, least(w.t, e - 200)))[1]"


@query(f"""with {_FRAMES}, t as (select path, least(greatest(quantile_cont(db, 0.2) + 6.0, -60.0), -20.0) as th, (max(frame) + 1) * 10 as lim from f group by 1),
l as (select f.path, frame, case when frame - lag(frame) over (partition by f.path order by frame) - 1 <= 30 then 0 else 1 end as fr from f join t on t.path = f.path where db >= th),
r as (select *, sum(fr) over (partition by path order by frame) as run from l), s as (select path, min(frame) * 10 as s, (max(frame) + 1) * 10 as e from r group by path, run having (max(frame) + 1) * 10 - min(frame) * 10 >= 50),
p as (select s.path, greatest(0, s - 20) as s, least(lim, e + 20) as e from s join t on t.path = s.path),
m as (select *, case when s - max(e) over (partition by path order by s, e rows between unbounded preceding and 1 preceding) <= 30 then 0 else 1 end as f from p), g as (select *, sum(f) over (partition by path order by s, e) as k from m),
i as (select path, min(s)::bigint as s, max(e)::bigint as e from g group by path, k),
c as (select i.path, s, e, list_reduce(list_prepend([s], list_transform(range((e - s) // 200 + 1), lambda x: [x])), lambda acc, x: case when e - acc[-1] <= 3000 then acc else list_append(acc, {_CUT}) end) as cuts from i join pw on pw.path = i.path),
u as (select path, unnest(cuts) as start_ms, unnest(list_append(cuts[2:], e)) as end_ms, generate_subscripts(cuts, 1) - 1 as part from c)
select u.path, start_ms, end_ms, part, round(avg(db), 3) as mean_dbfs, round(max(db), 3) as peak_dbfs, start_ms = max(start_ms) over (partition by u.path) as is_last
from u join f on f.path = u.path and (frame + 1) * 10 > start_ms and frame * 10 < end_ms group by u.path, start_ms, end_ms, part""")  # fmt: skip
def energy_vad(spark, sf_dir):
    frames = _frames(spark, sf_dir).select("path", "frame", "rms_dbfs")
    return audio.energy_vad(frames, "path", min_silence_ms=300, min_speech_ms=50, pad_ms=20, merge_gap_ms=30, pauses=quiet.Pauses(1_200, 3_000, 300, 200))


_BOUND = "list_transform([{'n': n, 'i': len(acc), 'lo': greatest(acc[-1] + 200, e - (n - len(acc)) * 1500), 'up': least(acc[-1] + 1500, e - (n - len(acc)) * 200), 't': s + round_even((e - s) * len(acc) / n, 0)::bigint}], lambda w: {'lo': w.lo, 'up': w.up, 't': least(w.up, greatest(w.lo, w.t))})"
_SEARCH = f"list_transform({_BOUND}, lambda w: {{'lo': w.lo, 'up': w.up, 't': w.t, 'a': greatest(w.lo, w.t - 300), 'b': least(w.up, w.t + 300)}})"
_FIRST, _LAST = "(w.a // 10 + case when w.a % 10 > 0 then 1 else 0 end)", "(w.b // 10)"
_CAP = f"list_transform({_SEARCH}, lambda w: least(w.up, greatest(w.lo, coalesce(case when w.b > w.a then {_quietest('w.a', 'w.b', 'w.t', 'greatest(1, w.b - w.a)', _FIRST, _LAST)} end, w.t))))[1]"


@query(f"""with {_FRAMES}, k as (select vec_id as id, path, n * 640 as s, n * 640 + 640 * (1 + vec_id % 9) - vec_id % 7 as e from v where n % 5 = 0), d as (select *, ceil((e - s) / 1500)::bigint as n from k),
c as (select id, d.path, s, e, n, list_reduce(list_prepend([s], list_transform(range(1, n), lambda x: [x])), lambda acc, x: list_append(acc, {_CAP})) as cuts from d join pw on pw.path = d.path)
select id, unnest(cuts) as start_ms, unnest(list_append(cuts[2:], e)) as end_ms, (generate_subscripts(cuts, 1) - 1)::int as part, case when n > 1 then '' else 'said ' || id end as text, case when n > 1 then 'said ' || id end as unaligned_source_text from c""")  # fmt: skip
def cap_at_pauses(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    start, end = F.col("n") * 640, F.col("n") * 640 + 640 * (1 + F.col("vec_id") % 9) - F.col("vec_id") % 7
    clips = frames.filter("frame % 64 = 0 and n % 5 = 0").select(F.col("vec_id").alias("id"), F.col("path").alias("video_id"), start.alias("start_ms"), end.alias("end_ms"), F.concat(F.lit("said "), F.col("vec_id").cast("string")).alias("text"))
    levels = frames.select(F.col("path").alias("video_id"), (F.col("frame") * 10).alias("at_ms"), F.col("rms_dbfs").alias("db"))
    return intervals.cap_at_pauses(clips, levels, 1_500, 300, 200).select("id", "start_ms", "end_ms", "part", "text", "unaligned_source_text")


@query("""with f as (select vec_id, unnest(embedding)::double * 100 - 60 as db, generate_subscripts(embedding, 1) - 1 as frame from embeddings),
w as (select * from f where frame between 10 + vec_id % 5 and 40), a as (select vec_id, frame, 10 * log10(greatest(avg(pow(10.0, db / 10)) over (partition by vec_id order by frame range between 9 preceding and 9 following), 1e-12)) as m, abs(frame - 30) as far from w),
s as (select *, round(m + 1.5 * far / (30 - vec_id % 5), 9) as score from a) select vec_id, arg_min(frame, struct_pack(a := score, b := far, c := frame)) as frame from s group by 1""")  # fmt: skip
def quiet_boundary_within(spark, sf_dir):
    frames = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("frame", "x"))
    frames = frames.select("vec_id", F.col("frame").cast("long").alias("frame"), (F.col("x").cast("double") * 100 - 60).alias("db"))
    return items.quiet_boundary(frames, "vec_id", F.lit(30), lower=10 + F.col("vec_id") % 5, upper=F.lit(40))


# --- text ---------------------------------------------------------------------------------------


@query(r"with " + UTT + r""", t as (select item_id, '你 好 ' || text || ' 世 界 9 号' as t from utt) select item_id, regexp_replace(regexp_replace(regexp_replace(t, '([\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}])\s+([\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}])', '\1\2', 'g'),
 '([\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}])\s+([a-zA-Z0-9])', '\1\2', 'g'), '([a-zA-Z0-9])\s+([\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}])', '\1\2', 'g') as clean from t""")
def clean_tn_spaces(spark, sf_dir):
    return utterances(spark, sf_dir).select("item_id", text.clean_tn_spaces(F.concat(F.lit("你 好 "), "text", F.lit(" 世 界 9 号"))).alias("clean"))


def _spoken_sql() -> str:
    t = "text"
    for mark, read in text.SPOKEN_MARKS.items():
        t = f"replace({t}, '{mark}', '{read}')"
    t = rf"regexp_replace(regexp_replace({t}, '[·•‧│|¦/\\]', ' ', 'g'), '[…~&*%$#^:;/\\|]+', ',', 'g')"
    t = rf"regexp_replace({t}, '[^\x{{4E00}}-\x{{9FFF}}\x{{3400}}-\x{{4DBF}}\x{{F900}}-\x{{FAFF}}0-9A-Za-z，。、？！：；…—～·.,:;!?()\[\]''\"\-_\s]', '', 'g')"
    t = rf"regexp_replace(regexp_replace({t}, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
    t = rf"regexp_replace(regexp_replace({t}, '[,，]{{2,}}', ',', 'g'), '\s+[,，]', ',', 'g')"
    return rf"select doc_id, regexp_replace({t}, '[,，]+\s*$', '') as spoken from documents"


@query(_spoken_sql())
def clean_spoken_output(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_spoken_output(F.col("text")).alias("spoken"))


@query("select doc_id, " + ", ".join(f"length(regexp_replace(text, '[^{c}]', '', 'g')) as {k}" for k, c in {k: text.char_class(r) for k, r in text.SCRIPT_RANGES.items()}.items()) + r", length(regexp_replace(regexp_replace(text, '[^\x{0000}-\x{024F}]', '', 'g'), '[^\p{L}]', '', 'g')) as latin from documents")
def script_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.script_stats(F.col("text")).alias("s")).select("doc_id", *(F.col(f"s.{k}").cast("long").alias(k) for k in (*text.SCRIPT_RANGES, "latin")))


@query("with " + UTT + r""", c as (select item_id, unnest(string_split(nfc_normalize(text || ' €ж+'), '')) as c from utt), r as (select item_id, c, case when regexp_matches(c, '^\s$') then null when regexp_matches(c, '^[\p{Cc}\p{Co}\x{FFFD}]$') then 'invalid_unicode_category'
 when regexp_matches(c, '^\p{S}$') and not regexp_matches(c, '^[%+&@#=/$\-*°]$') then 'unexpected_symbol' when regexp_matches(c, '^\p{L}$') and not regexp_matches(c, '^[\p{Latin}\x{1000}-\x{109F}\x{A9E0}-\x{A9FF}\x{AA60}-\x{AA7F}]$') then 'unexpected_letter_script' end as reason from c)
select item_id, c as character, reason, count(*) as n from r where reason is not null group by 1, 2, 3""")
def abnormal_chars(spark, sf_dir):
    found = utterances(spark, sf_dir).select("item_id", F.explode(text.abnormal_chars(text.nfc(F.concat("text", F.lit(" €ж+"))))).alias("x"))
    return found.groupBy("item_id", "x.character", "x.reason").agg(F.count(F.lit(1)).alias("n"))


_CHAT = r"'<|im_start|>system' || chr(10) || 'You are a helpful assistant.<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || 'Convert text to speech.' || chr(10) || lang || text || ' /no_think<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10)"


@query("with " + UTT + f" select item_id, {_CHAT} || case when length(text) % 3 > 0 then '<|sosp|>' || repeat('<|video_pad|>', length(text) % 3) else '<|im_end|>' || chr(10) end as chat from utt")
def compose_chat(spark, sf_dir):
    return utterances(spark, sf_dir).select("item_id", text.compose_tts_request(F.col("lang"), F.col("text"), F.length("text") % 3).alias("chat"))


@query("with " + UTT + r""", m as (select item_id, regexp_extract_all(text || ' Dr. X! "and" (so)', '[^;:!?。，；：！？]*[;:!?。，；：！？]["''）\]》>」】;:!?。，；：！？]*|[^;:!?。，；：！？]+$') as p from utt),
f as (select item_id, list_reduce(list_transform(p, lambda x: struct_pack(d := []::varchar[], n := x)), lambda a, b: case when length(a.n) + length(b.n) <= 40 then struct_pack(d := a.d, n := a.n || b.n) else struct_pack(d := list_append(a.d, a.n), n := b.n) end) as r from m)
select item_id, array_to_string(list_transform(list_append(r.d, r.n), lambda x: trim(x)), '|') as chunks from f""")
def chunk_text(spark, sf_dir):
    return utterances(spark, sf_dir).select("item_id", F.array_join(text.chunk_text(F.concat("text", F.lit(' Dr. X! "and" (so)')), 40), "|").alias("chunks"))


@query("select doc_id, case lang when 'en' then 'en-US' when 'de' then 'de-DE' when 'fr' then 'fr-FR' end as locale, case lang when 'en' then 'English' when 'de' then 'German' when 'fr' then 'French' end as name from documents")
def map_language(spark, sf_dir):
    names = text.map_language(F.col("lang"), {"en": "English", "de": "German", "fr": "French"})
    rows = table(spark, sf_dir, "documents").select("doc_id", text.locale_of_language(names).alias("locale"))
    return rows.select("doc_id", "locale", text.language_of_locale(F.col("locale")).alias("name"))
