"""Checks, fingerprints, drift, gate, monitors."""
from __future__ import annotations

from pyspark.sql import functions as F


from ..operators import monitors, quality as q
from ..sources import history as h
from .views import AS_OF, DV, LV, REG, doc_listings, listings, registry

VCOLS = ["rule", "severity", "source", "count", "sample"]


def _v(fn):
    return lambda spark, sf: fn(spark, sf).select(*VCOLS)


def _per_source_sql(rule, cond, sample, src="lv", with_=LV):
    return (f"WITH {with_} SELECT '{rule}' AS rule, 'error' AS severity, source_name AS source, count(*) AS count, "
            f"arg_min({sample}, arrival_ix) AS sample FROM {src} WHERE {cond} GROUP BY source_name")


ISO = ("strftime({0}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN date_part('microsecond', {0})::BIGINT % 1000000 = 0 THEN '' "
       "ELSE '.' || lpad(CAST(date_part('microsecond', {0})::BIGINT % 1000000 AS VARCHAR), 6, '0') END")
NAV_RE2 = (r"^(?:(?:home|menu|search|login|sign in|subscribe|newsletter|cookie|privacy)$"
           r"|(?:read more|learn more|click here|view all|see all|load more|next|previous)$"
           r"|(?:skip to|jump to)(?:[^\p{L}\p{N}_]|$)|[^\p{L}\p{N}_]*$)")


def raw_times(df):
    """Text times as a feed might have stored them: some rows carry an offset."""
    text = F.date_format("start_datetime", "yyyy-MM-dd'T'HH:mm:ss")
    return df.withColumn("start_datetime_raw", F.concat(text, F.when(F.col("arrival_ix") % 11 == 0, "-05:00").when(F.col("arrival_ix") % 13 == 0, "Z").otherwise(""))) \
             .withColumn("end_datetime_raw", F.concat(F.date_format("end_datetime", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("arrival_ix") % 17 == 0, "+0530").otherwise("")))


RAW_SQL = (LV + ", raw AS (SELECT *, strftime(start_datetime, '%Y-%m-%dT%H:%M:%S') || CASE WHEN arrival_ix % 11 = 0 THEN '-05:00' "
           "WHEN arrival_ix % 13 = 0 THEN 'Z' ELSE '' END AS s0, strftime(end_datetime, '%Y-%m-%dT%H:%M:%S') || "
           "CASE WHEN arrival_ix % 17 = 0 THEN '+0530' ELSE '' END AS s1 FROM lv)")

FP_COLS = ("source, events, date_span_days, max_events_one_day, max_events_one_timestamp, distinct_titles_ratio, "
           "distinct_venues, distinct_images_ratio, median_description_len, null_venue_rate, earliest_start, latest_start")


def fp_sql(key="", name="fp", src="lv"):
    k = f", {key}" if key else ""
    p = f"source_name{k}"
    return f"""
  {name}_ts AS (SELECT {p}, start_datetime, count(*) n FROM {src} GROUP BY ALL),
  {name}_day AS (SELECT {p}, CAST(start_datetime AS DATE) d, sum(n) n FROM {name}_ts GROUP BY ALL),
  {name}_len AS (SELECT {p}, length(description) l, row_number() OVER (PARTITION BY {p} ORDER BY length(description)) rn,
      count(*) OVER (PARTITION BY {p}) c FROM {src}),
  {name} AS (SELECT b.source_name AS source{k.replace(', ', ', b.')}, count(*) AS events,
      date_diff('day', min(CAST(start_datetime AS DATE)), max(CAST(start_datetime AS DATE))) + 1 AS date_span_days,
      any_value(dd.m) AS max_events_one_day, any_value(tt.m) AS max_events_one_timestamp,
      round(count(DISTINCT title) / count(*), 4) AS distinct_titles_ratio, count(DISTINCT venue_name) AS distinct_venues,
      CASE WHEN count(image_url) > 0 THEN round(count(DISTINCT image_url) / count(image_url), 4) END AS distinct_images_ratio,
      any_value(ml.l) AS median_description_len, round((count(*) - count(venue_name)) / count(*), 4) AS null_venue_rate,
      min(CAST(start_datetime AS DATE)) AS earliest_start, max(CAST(start_datetime AS DATE)) AS latest_start
    FROM {src} b
    JOIN (SELECT {p}, CAST(max(n) AS BIGINT) m FROM {name}_day GROUP BY ALL) dd USING ({p})
    JOIN (SELECT {p}, max(n) m FROM {name}_ts GROUP BY ALL) tt USING ({p})
    JOIN (SELECT {p}, l FROM {name}_len WHERE rn = c // 2 + 1) ml USING ({p})
    GROUP BY b.source_name{k.replace(', ', ', b.')})"""


def daily_history(spark, sf):
    """One fingerprint per source and calendar day before the 15th: the day plays the run."""
    df = listings(spark, sf).withColumn("run_id", F.date_format("raw_start", "yyyy-MM-dd"))
    return q.fingerprints(df, ["run_id"])


def _now_and_past(spark, sf):
    """The 15th (with one source thinned and one gone) against the days before."""
    df = listings(spark, sf).withColumn("run_id", F.date_format("raw_start", "yyyy-MM-dd"))
    past = q.fingerprints(df.filter("run_id < '2024-01-15'"), ["run_id"])
    today = df.filter("run_id = '2024-01-15' AND source_name <> 'purchase' AND (source_name <> 'click' OR k % 3 = 0)")
    return q.fingerprints(today), past


NOW_SQL = (LV + ", " + REG + ", lvd AS (SELECT *, strftime(raw_start, '%Y-%m-%d') AS run_id FROM lv), "
           "past_rows AS (SELECT * FROM lvd WHERE run_id < '2024-01-15'), "
           "now_rows AS (SELECT * FROM lvd WHERE run_id = '2024-01-15' AND source_name <> 'purchase' AND (source_name <> 'click' OR k % 3 = 0)), "
           + fp_sql("run_id", "past", "past_rows") + "," + fp_sql("", "cur", "now_rows") + """,
  hist AS (SELECT source, count(*) runs, median(events) usual, max(latest_start) best FROM past GROUP BY source),
  judged AS (SELECT cur.*, usual, best FROM cur JOIN hist USING (source) WHERE runs >= 3 AND NOT (events < 10 AND usual < 10)),
  long_now AS (SELECT source, metric, value FROM judged CROSS JOIN LATERAL (VALUES ('events', CAST(events AS DOUBLE)), ('date_span_days', CAST(date_span_days AS DOUBLE)),
     ('max_events_one_day', CAST(max_events_one_day AS DOUBLE)), ('distinct_titles_ratio', distinct_titles_ratio),
     ('distinct_images_ratio', distinct_images_ratio), ('median_description_len', CAST(median_description_len AS DOUBLE))) t(metric, value)),
  long_past AS (SELECT source, metric, median(value) base FROM past CROSS JOIN LATERAL (VALUES ('events', CAST(events AS DOUBLE)), ('date_span_days', CAST(date_span_days AS DOUBLE)),
     ('max_events_one_day', CAST(max_events_one_day AS DOUBLE)), ('distinct_titles_ratio', distinct_titles_ratio),
     ('distinct_images_ratio', distinct_images_ratio), ('median_description_len', CAST(median_description_len AS DOUBLE))) t(metric, value)
     WHERE value IS NOT NULL GROUP BY ALL),
  rules(metric, up, w, e) AS (VALUES ('events', false, 0.7, 0.5), ('events', true, 2.0, 3.0), ('date_span_days', false, 0.7, 0.5), ('max_events_one_day', true, 2.0, 2.5),
     ('distinct_titles_ratio', false, 0.7, 0.5), ('distinct_images_ratio', false, 0.6, 0.4), ('median_description_len', false, 0.5, 0.3)),
  drift AS (SELECT source, metric, CASE WHEN (up AND value/base > e) OR (NOT up AND value/base < e) THEN 'error' ELSE 'warning' END AS severity,
     round(value, 4) AS current, round(base, 4) AS baseline FROM long_now JOIN long_past USING (source, metric) JOIN rules USING (metric)
     WHERE value IS NOT NULL AND base <> 0 AND ((up AND value/base > w) OR (NOT up AND value/base < w))),
  stale AS (SELECT source, 'latest_start' AS metric, 'warning' AS severity, 0.0::DOUBLE AS current, 0.0::DOUBLE AS baseline FROM judged WHERE latest_start < best),
  lostsrc AS (SELECT source, 'events' AS metric, 'error' AS severity, 0.0::DOUBLE AS current, usual::DOUBLE AS baseline FROM hist
     WHERE source NOT IN (SELECT source FROM cur) AND runs >= 3 AND usual >= 10 AND source IN (SELECT name FROM reg WHERE status = 'active'))""")
DCOLS = ["source", "metric", "severity", "current", "baseline"]


def _split(spark, sf):
    df = listings(spark, sf)
    return df.filter("raw_start < '2024-01-20'"), df.filter("raw_start >= '2024-01-20' AND source_name IN ('click', 'view')")


def _gate(spark, sf):
    cur, past = _now_and_past(spark, sf)
    previous, now = _split(spark, sf)
    of = q.publish_state(now, AS_OF)
    out = q.gate(of, q.rule_findings(of), q.check_drift(cur, past, registry(spark).filter("status = 'active'")), previous)
    worst = F.transform("violations", lambda v: F.concat_ws("|", v["rule"], F.coalesce(v["source"], F.lit("-")), v["count"].cast("string"), v["sample"], v["detail"]))
    drifted = F.transform("drifts", lambda d: F.concat_ws("|", d["severity"], d["source"], d["metric"], d["current"].cast("string"), d["baseline"].cast("string"), d["detail"]))
    return out.select("decision", "mode", "drift_enforced", "passed", "blocking", "events", "n_violations", "n_drifts", F.array_join("reasons", " / ").alias("reasons"),
                      F.array_join(worst, chr(10)).alias("violations"), F.array_join(drifted, chr(10)).alias("drifts"))


def _report(spark, sf):
    previous, now = _split(spark, sf)
    cur, past = _now_and_past(spark, sf)
    of = q.publish_state(now, AS_OF)
    return q.report(q.gate(of, q.rule_findings(of), q.check_drift(cur, past), previous, enforce_drift=True))


def _board(spark, sf):
    df = listings(spark, sf)
    cur, past = _now_and_past(spark, sf)
    runs = df.groupBy().agg(F.date_format(F.max("raw_start"), "yyyy-MM-dd").alias("run_id")).select(
        "run_id", F.concat("run_id", F.lit(" 00:00:00")).alias("started_at"), F.expr("named_struct('decision', 'BLOCKED')").alias("gate"),
        F.expr("array(named_struct('source', 'error', 'status', 'failed'))").alias("scrapers"))
    of = q.publish_state(df, AS_OF)
    return q.findings_board(q.rule_findings(of), q.check_drift(cur, past), q.silent_sources(q.source_counts(of), registry(spark)), runs, "2024-02-05 00:00:00")


def _crooked(df):
    """Listings with every defect a rule looks for."""
    k, ix = F.col("k"), F.col("arrival_ix")
    return (df.withColumn("start_datetime", F.when(k % 17 == 0, F.col("raw_start")).when(ix % 211 == 0, F.col("start_datetime") + F.expr("INTERVAL 900 DAYS"))
                          .when(ix % 307 != 0, F.date_trunc("hour", "start_datetime").cast("timestamp_ntz")))
            .withColumn("title", F.when(ix % 101 != 0, F.col("title"))).withColumn("source_url", F.when(ix % 103 != 0, F.col("source_url")).otherwise(""))
            .withColumn("id", F.when(ix % 13 == 0, F.concat("source_name", F.lit(":"), F.col("user_id"))).otherwise(F.col("id")))
            .withColumn("source_name", F.when(ix % 401 == 0, F.lit(None)).when(ix % 997 < 9, F.concat(F.lit("few "), (ix % 997).cast("string"))).otherwise(F.col("source_name"))))


def _state_shapes(spark, sf):
    return q.state.shapes(q.publish_state(listings(spark, sf), AS_OF))


CROOKED_SQL = """crooked AS (SELECT * REPLACE (CASE WHEN k % 17 = 0 THEN raw_start WHEN arrival_ix % 211 = 0 THEN start_datetime + INTERVAL 900 DAY WHEN arrival_ix % 307 <> 0 THEN date_trunc('hour', start_datetime) END AS start_datetime,
  CASE WHEN arrival_ix % 101 <> 0 THEN title END AS title, CASE WHEN arrival_ix % 103 <> 0 THEN source_url ELSE '' END AS source_url, CASE WHEN arrival_ix % 13 = 0 THEN source_name || ':' || user_id ELSE id END AS id,
  CASE WHEN arrival_ix % 401 = 0 THEN NULL WHEN arrival_ix % 997 < 9 THEN 'few ' || (arrival_ix % 997) ELSE source_name END AS source_name) FROM lv)"""


# every rule over the rows ``src``, in SQL; numbers and words are written out, so that a changed constant shows
def rules_sql(src, name="viol"):
    iso = ISO.format("start_datetime")
    one = lambda rule, cond, sample, text: (f"SELECT '{rule}' AS rule, source_name AS source, count(*) AS count, first({sample} ORDER BY arrival_ix) AS sample, count(*) || '{text}' AS detail "  # noqa: E731
                                            f"FROM {src} WHERE {cond} GROUP BY source_name")
    parts = [one("clock_stamped", "start_datetime <> date_trunc('minute', start_datetime)", iso, " start times carry seconds or microseconds"),
             one("date_out_of_range", "start_datetime < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 730 DAY OR start_datetime > TIMESTAMP '2024-01-15 00:00:00' + INTERVAL 730 DAY", iso, " events dated outside [-730d, +730d]"),
             one("nav_title", f"regexp_matches(trim(lower(coalesce(title, ''))), '{NAV_RE2}')", "substring(coalesce(title, ''), 1, 60)", " titles look like page chrome"),
             f"SELECT 'timestamp_pileup', source_name, n, {iso}, n || ' events share one exact start (limit 20)' FROM {name}_ts WHERE n > 20",
             f"SELECT 'uniform_timestamp', source_name, n, {iso}, n || ' of ' || t || ' events share one exact start' FROM {name}_ts JOIN (SELECT source_name, CAST(sum(n) AS BIGINT) t FROM {name}_ts GROUP BY ALL) USING (source_name) WHERE t >= 8 AND n <= 20 AND n / t > 0.7",
             f"SELECT 'duplicate_id', NULL, count(*), first(id || ' x' || n ORDER BY n DESC, ix), count(*) || ' ids used by more than one event' FROM (SELECT id, count(*) n, min(arrival_ix) ix FROM {src} WHERE coalesce(id, '') <> '' GROUP BY id HAVING count(*) > 1) HAVING count(*) > 0"]
    parts += [f"SELECT 'missing_required', first(source_name ORDER BY arrival_ix), count(*), first(substring(coalesce(title, ''), 1, 60) ORDER BY arrival_ix), count(*) || ' events missing {f}' FROM {src} WHERE coalesce(CAST({f} AS VARCHAR), '') = '' HAVING count(*) > 0"
              for f in ("title", "description", "start_datetime", "source_url", "source_name")]
    return f"{name}_ts AS (SELECT source_name, start_datetime, count(*) n FROM {src} GROUP BY ALL), {name} AS ({' UNION ALL '.join(parts)})"


# drift with its words; ``known`` is the condition on sources that count as vanished
DRIFT_WORDS = """drift_d AS (SELECT source, metric, severity, current, baseline, CASE metric WHEN 'events' THEN CASE WHEN up THEN 'source returns far more than usual' ELSE 'source returns far less than usual' END
   WHEN 'date_span_days' THEN 'reaches less far ahead' WHEN 'max_events_one_day' THEN 'dates collapse onto one day' WHEN 'distinct_titles_ratio' THEN 'titles repeat'
   WHEN 'distinct_images_ratio' THEN 'images collapse to a placeholder' ELSE 'descriptions thin out' END || printf(' (%.0f%% of normal)', value / base * 100) AS detail
   FROM (SELECT source, metric, up, value, base, CASE WHEN (up AND value/base > e) OR (NOT up AND value/base < e) THEN 'error' ELSE 'warning' END AS severity, round(value, 4) AS current, round(base, 4) AS baseline
     FROM long_now JOIN long_past USING (source, metric) JOIN rules USING (metric) WHERE value IS NOT NULL AND base <> 0 AND ((up AND value/base > w) OR (NOT up AND value/base < w)))
   UNION ALL SELECT source, 'latest_start', 'warning', 0.0::DOUBLE, 0.0::DOUBLE, 'furthest-out listing moved from ' || best || ' to ' || latest_start FROM judged WHERE latest_start < best
   UNION ALL SELECT source, 'events', 'error', 0.0::DOUBLE, usual::DOUBLE, 'source disappeared from the data entirely' FROM hist WHERE source NOT IN (SELECT source FROM cur) AND runs >= 3 AND usual >= 10 AND {known})"""
SPLIT_SQL = """prev AS (SELECT * FROM lv WHERE raw_start < TIMESTAMP '2024-01-20'), nowr AS (SELECT * FROM lv WHERE raw_start >= TIMESTAMP '2024-01-20' AND source_name IN ('click', 'view')),
  tot AS (SELECT (SELECT count(*) FROM prev) was, (SELECT count(*) FROM nowr) now, (SELECT count(DISTINCT source_name) FROM prev) ws, (SELECT count(DISTINCT source_name) FROM nowr) ns,
    (SELECT string_agg(DISTINCT source_name, ', ' ORDER BY source_name) FROM prev WHERE source_name NOT IN (SELECT source_name FROM nowr)) lost),
  why AS (SELECT *, CASE WHEN now < was * 0.5 THEN 'event count collapsed: ' || now || ' vs ' || was || ' currently published' END AS r1,
    CASE WHEN ns < ws * 0.6 THEN (ws - ns) || ' of ' || ws || ' sources vanished: ' || lost END AS r2, CASE WHEN now = 0 THEN 'the run produced no events at all' END AS r0 FROM tot)"""
V_TOP = "vt AS (SELECT * FROM viol QUALIFY row_number() OVER (PARTITION BY rule, source ORDER BY -count, sample) <= 5 ORDER BY -count, rule, source NULLS FIRST, sample LIMIT 1000)"
D_TOP = "dt AS (SELECT * FROM drift_d QUALIFY row_number() OVER (PARTITION BY source ORDER BY severity, source, metric, current, baseline) <= 5 ORDER BY severity, source, metric, current, baseline LIMIT 1000)"
GATE_SQL = f"""WITH {NOW_SQL}, {DRIFT_WORDS.format(known="source IN (SELECT name FROM reg WHERE status = 'active')")}, {SPLIT_SQL}, {rules_sql('nowr')}, {V_TOP}, {D_TOP},
  n AS (SELECT (SELECT count(*) FROM viol) nv, (SELECT count(*) FROM drift_d) nd, (SELECT count(*) FROM drift_d WHERE severity = 'error') bd),
  f AS (SELECT *, r0 IS NULL AND r1 IS NULL AND r2 IS NULL AND nv = 0 AS clean FROM why, n)
  SELECT CASE WHEN clean THEN 'pass' ELSE 'BLOCKED' END AS decision, 'enforce' AS mode, false AS drift_enforced, clean AS passed, NOT clean AS blocking, now AS events, nv AS n_violations, nd AS n_drifts,
    concat_ws(' / ', r0, r1, r2, CASE WHEN nv > 0 THEN nv || ' invariant violation(s)' END, CASE WHEN bd > 0 THEN bd || ' source(s) drifted beyond tolerance (not blocking)' END) AS reasons,
    coalesce((SELECT string_agg(concat_ws('|', rule, coalesce(source, '-'), count, sample, detail), chr(10) ORDER BY -count, rule, source NULLS FIRST, sample) FROM vt), '') AS violations,
    coalesce((SELECT string_agg(concat_ws('|', severity, source, metric, current, baseline, detail), chr(10) ORDER BY severity, source, metric, current, baseline, detail) FROM dt), '') AS drifts FROM f"""
REPORT_SQL = f"""WITH {NOW_SQL}, {DRIFT_WORDS.format(known="true")}, {SPLIT_SQL}, {rules_sql('nowr')}, {V_TOP}, {D_TOP},
  n AS (SELECT (SELECT count(*) FROM viol) nv, (SELECT count(*) FROM drift_d) nd, (SELECT count(*) FROM drift_d WHERE severity = 'error') bd, (SELECT count(*) FROM vt) sv, (SELECT count(*) FROM dt) sd),
  f AS (SELECT *, CASE WHEN nv > 0 THEN nv || ' invariant violation(s)' END AS r3, CASE WHEN bd > 0 THEN bd || ' source(s) drifted beyond tolerance' END AS r4 FROM why, n),
  ln AS (SELECT severity, string_agg('  ' || source || ': ' || metric || ' ' || current || ' vs baseline ' || baseline || ' - ' || detail, chr(10) ORDER BY source, metric, current, baseline, detail) AS t FROM dt GROUP BY severity)
  SELECT concat_ws(chr(10), 'Gate: ' || CASE WHEN coalesce(r0, r1, r2, r3, r4) IS NULL THEN 'pass' ELSE 'BLOCKED' END, '  ' || r0, '  ' || r1, '  ' || r2, '  ' || r3, '  ' || r4,
    CASE WHEN coalesce(r1, r2) IS NOT NULL THEN 'Catastrophic collapse:' END, '  ' || r1, '  ' || r2,
    (SELECT 'Invariant violations:' || chr(10) || string_agg('  ' || coalesce(source || ': ', '') || detail || coalesce('  e.g. ' || sample, ''), chr(10) ORDER BY -count, rule, source NULLS FIRST, sample) FROM vt HAVING count(*) > 0),
    (SELECT 'Drift from each source''s own baseline:' || chr(10) || t FROM ln WHERE severity = 'error'), (SELECT 'Warnings (not blocking):' || chr(10) || t FROM ln WHERE severity = 'warning'),
    CASE WHEN nv + nd > sv + sd THEN (nv + nd - sv - sd) || ' further finding(s) in the detail tables' END) AS report FROM f"""
BOARD_SQL = f"""WITH {NOW_SQL}, {DRIFT_WORDS.format(known="true")}, {rules_sql('lv')}, run AS (SELECT strftime(max(raw_start), '%Y-%m-%d') AS run_id, date_diff('day', CAST(max(raw_start) AS DATE), DATE '2024-02-05') AS days FROM lv),
  quiet AS (SELECT name FROM reg WHERE scraped AND name NOT IN (SELECT source_name FROM lv))
  SELECT 'error' AS level, coalesce(source, 'data') || ': ' || detail AS message FROM viol
  UNION ALL SELECT severity, source || ': ' || metric || ' ' || detail FROM drift_d
  UNION ALL SELECT 'warning', count(*) || ' registered source(s) contribute no events: ' || string_agg(name, ', ' ORDER BY name) FROM quiet HAVING count(*) > 0
  UNION ALL SELECT 'error', 'last run ' || run_id || ' gate=BLOCKED' FROM run
  UNION ALL SELECT 'error', 'last run: 1 source(s) failed: error'
  UNION ALL SELECT 'warning', 'last run was ' || days || ' days ago' FROM run WHERE days > 2"""


def _runs(spark, sf):
    """Run records, one per day, shaped from the listing view."""
    df = listings(spark, sf).withColumn("run_id", F.date_format("raw_start", "yyyy-MM-dd"))
    per = df.groupBy("run_id", "source_name").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("source_name").alias("source"), F.when(F.col("n") < 50, "failed").otherwise("ok").alias("status")))).alias("scrapers"),
        F.map_from_arrays(F.array(F.lit("final")), F.array(F.sum("n"))).alias("counts"),
        F.lit(1.5).alias("duration_s"), F.struct(F.when(F.sum("n") % 2 == 0, "pass").otherwise("BLOCKED").alias("decision")).alias("gate"),
        F.map_from_arrays(F.array(F.lit("added"), F.lit("removed")), F.array(F.sum("n") % 7, F.sum("n") % 5)).alias("diff"))


def _run_summary(spark, sf):
    return h.run_summary(h.recent_runs(_runs(spark, sf), 20)).withColumn("failed", F.array_join("failed", ","))


BASE_VALUES = ", ".join(f"('{m}', CAST({m} AS DOUBLE))" for m in (
    "events", "date_span_days", "max_events_one_day", "distinct_titles_ratio", "distinct_images_ratio", "median_description_len"))

QUERIES = {
    "fingerprint_by_source": (lambda s, d: q.fingerprints(listings(s, d)), f"WITH {LV}, {fp_sql()} SELECT {FP_COLS} FROM fp"),
    "fingerprint_by_source_day": (daily_history, f"WITH {LV}, lvd AS (SELECT *, strftime(raw_start, '%Y-%m-%d') AS run_id FROM lv), {fp_sql('run_id', 'fp', 'lvd')} SELECT {FP_COLS}, run_id FROM fp"),
    "state_shapes": (_state_shapes, f"WITH {LV}, {fp_sql()} SELECT {FP_COLS} FROM fp"),
    "state_findings": (lambda s, d: q.rule_findings(q.publish_state(_crooked(listings(s, d)), AS_OF)), f"WITH {LV}, {CROOKED_SQL}, {rules_sql('crooked')} SELECT 'error' AS severity, * FROM viol"),
    "fingerprint_documents": (lambda s, d: q.fingerprints(doc_listings(s, d).withColumn("venue_name", F.col("category")).withColumn("image_url", F.lit(None).cast("string"))).drop("distinct_images_ratio"),
                              f"WITH {DV}, dvv AS (SELECT *, category AS venue_name, NULL::VARCHAR AS image_url FROM dv), {fp_sql('', 'fp', 'dvv')} SELECT {FP_COLS.replace(' distinct_images_ratio,', '')} FROM fp"),
    "invariant_clock_stamped": (_v(lambda s, d: q.clock_stamped(listings(s, d), "raw_start")),
                                _per_source_sql("clock_stamped", "date_part('microsecond', raw_start)::BIGINT <> 0", ISO.format("raw_start"))),
    "invariant_pileup": (_v(lambda s, d: q.timestamp_pileup(listings(s, d).withColumn("start_datetime", F.date_trunc("day", "start_datetime").cast("timestamp_ntz")))),
                         f"WITH {LV}, dd AS (SELECT source_name, date_trunc('day', start_datetime)::TIMESTAMP AS start_datetime FROM lv) SELECT 'timestamp_pileup' AS rule, 'error' AS severity, source_name AS source, count(*) AS count, {ISO.format('start_datetime')} AS sample FROM dd GROUP BY source_name, start_datetime HAVING count(*) > 20"),
    "invariant_uniform": (_v(lambda s, d: q.uniform_timestamp(listings(s, d).withColumn("source_name", F.concat("source_name", F.lit("-"), F.to_date("start_datetime").cast("string"))).withColumn("source_name", F.when(F.expr("all_day OR k % 40 = 1"), F.col("source_name")).otherwise(F.concat("source_name", F.lit("-"), F.hour("start_datetime").cast("string")))))),
                          f"""WITH {LV}, x AS (SELECT source_name || '-' || CAST(CAST(start_datetime AS DATE) AS VARCHAR) || CASE WHEN all_day OR k % 40 = 1 THEN '' ELSE '-' || CAST(hour(start_datetime) AS VARCHAR) END AS source_name, start_datetime FROM lv),
                          per AS (SELECT source_name, start_datetime, count(*) n FROM x GROUP BY ALL), tot AS (SELECT source_name, sum(n) t FROM per GROUP BY ALL)
                          SELECT 'uniform_timestamp' AS rule, 'error' AS severity, source_name AS source, n AS count, {ISO.format('start_datetime')} AS sample FROM per JOIN tot USING (source_name) WHERE t >= 8 AND n / t > 0.7 AND n <= 20"""),
    "invariant_out_of_range": (_v(lambda s, d: q.date_out_of_range(listings(s, d), "2026-01-10 12:00:00")),
                               _per_source_sql("date_out_of_range", "start_datetime < TIMESTAMP '2026-01-10 12:00:00' - INTERVAL 730 DAY OR start_datetime > TIMESTAMP '2026-01-10 12:00:00' + INTERVAL 730 DAY", ISO.format("start_datetime"))),
    "invariant_duplicate_id": (_v(lambda s, d: q.duplicate_ids(listings(s, d).withColumn("id", F.concat("source_name", F.lit(":"), F.col("user_id"))))),
                               f"""WITH {LV}, g AS (SELECT source_name || ':' || user_id AS id, count(*) n, min(arrival_ix) ix FROM lv GROUP BY ALL HAVING count(*) > 1)
                               SELECT 'duplicate_id' AS rule, 'error' AS severity, NULL::VARCHAR AS source, count(*) AS count, (SELECT id || ' x' || n FROM g ORDER BY n DESC, ix LIMIT 1) AS sample FROM g"""),
    "invariant_missing_required": (_v(lambda s, d: q.missing_required(listings(s, d).withColumn("title", F.when(F.col("k") % 12 != 0, F.col("title"))).withColumn("source_url", F.when(F.col("k") % 15 != 0, F.col("source_url")).otherwise("")))),
                                   f"""WITH {LV}, b AS (SELECT arrival_ix, source_name, CASE WHEN k % 12 <> 0 THEN title END AS title, CASE WHEN k % 15 <> 0 THEN source_url ELSE '' END AS source_url FROM lv),
                                   bad AS (SELECT 'title' AS f, * FROM b WHERE title IS NULL UNION ALL SELECT 'source_url', * FROM b WHERE source_url = '')
                                   SELECT 'missing_required' AS rule, 'error' AS severity, arg_min(source_name, arrival_ix) AS source, count(*) AS count, first(substring(coalesce(title, ''), 1, 60) ORDER BY arrival_ix) AS sample FROM bad GROUP BY f"""),
    "invariant_nav_title": (_v(lambda s, d: q.nav_titles(listings(s, d))),
                            _per_source_sql("nav_title", f"regexp_matches(trim(lower(title)), '{NAV_RE2}')", "substring(title, 1, 60)")),
    "invariant_tz_aware": (_v(lambda s, d: q.tz_aware(raw_times(listings(s, d)))),
                           f"""WITH {RAW_SQL}, f AS (SELECT arrival_ix, source_name, 0 AS i, s0 AS v FROM raw UNION ALL SELECT arrival_ix, source_name, 1, s1 FROM raw)
                           SELECT 'tz_aware' AS rule, 'error' AS severity, source_name AS source, count(*) AS count, first(v ORDER BY arrival_ix, i) AS sample FROM f WHERE regexp_matches(v, '([+-][0-9]{{2}}:?[0-9]{{2}}|Z)$') GROUP BY source_name"""),
    "baseline_median": (lambda s, d: q.baseline(daily_history(s, d)),
                        f"""WITH {LV}, lvd AS (SELECT *, strftime(raw_start, '%Y-%m-%d') AS run_id FROM lv), {fp_sql('run_id', 'fp', 'lvd')}
                        SELECT source, metric, median(value) AS base FROM fp CROSS JOIN LATERAL (VALUES {BASE_VALUES}) t(metric, value) WHERE value IS NOT NULL GROUP BY ALL"""),
    "drift_rules": (lambda s, d: q.metric_drift(*_now_and_past(s, d)).select(*DCOLS), f"WITH {NOW_SQL} SELECT * FROM drift"),
    "drift_stale": (lambda s, d: q.stale_drift(q.fingerprints(listings(s, d).filter("raw_start < '2024-01-10'")), daily_history(s, d)).select(*DCOLS),
                    f"""WITH {LV}, p AS (SELECT source_name s, strftime(raw_start, '%Y-%m-%d') r, count(*) n, max(CAST(start_datetime AS DATE)) b FROM lv GROUP BY ALL),
                    h AS (SELECT s, count(*) runs, median(n) usual, max(b) best FROM p GROUP BY s), c AS (SELECT source_name s, count(*) n, max(CAST(start_datetime AS DATE)) l FROM lv WHERE raw_start < TIMESTAMP '2024-01-10' GROUP BY ALL)
                    SELECT s AS source, 'latest_start' AS metric, 'warning' AS severity, 0.0::DOUBLE AS current, 0.0::DOUBLE AS baseline FROM c JOIN h USING (s) WHERE runs >= 3 AND NOT (n < 10 AND usual < 10) AND l < best"""),
    "disappeared_sources": (lambda s, d: q.disappeared(*_now_and_past(s, d), registry(s).filter("status = 'active'")).select(*DCOLS), f"WITH {NOW_SQL} SELECT * FROM lostsrc"),
    "drift_all": (lambda s, d: q.check_drift(*_now_and_past(s, d), registry(s).filter("status = 'active'")).select(*DCOLS),
                  f"WITH {NOW_SQL} SELECT * FROM drift UNION ALL SELECT * FROM stale UNION ALL SELECT * FROM lostsrc"),
    "history_trim": (lambda s, d: h.latest_per_source(daily_history(s, d), 10).select("source", "run_id", "events"),
                     f"WITH {LV}, g AS (SELECT source_name AS source, strftime(raw_start, '%Y-%m-%d') AS run_id, count(*) AS events FROM lv GROUP BY ALL) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY source ORDER BY run_id DESC) <= 10"),
    "history_append": (lambda s, d: h.append_fingerprints(daily_history(s, d), q.fingerprints(listings(s, d)), "2099-01-01", 5).select("source", "run_id", "events"),
                       f"""WITH {LV}, g AS (SELECT source_name AS source, strftime(raw_start, '%Y-%m-%d') AS run_id, count(*) AS events FROM lv GROUP BY ALL
                       UNION ALL SELECT source_name, '2099-01-01', count(*) FROM lv GROUP BY ALL) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY source ORDER BY run_id DESC) <= 5"""),
    "history_reset": (lambda s, d: h.reset_fingerprints(daily_history(s, d), registry(s).filter("NOT runs_in_ci").select("name"))[1],
                      f"WITH {LV} SELECT source_name AS source, count(DISTINCT strftime(raw_start, '%Y-%m-%d')) AS runs_dropped FROM lv WHERE source_name = 'error' GROUP BY ALL"),
    "run_summaries": (_run_summary,
                      f"""WITH {LV}, per AS (SELECT strftime(raw_start, '%Y-%m-%d') AS run_id, source_name, count(*) n FROM lv GROUP BY ALL),
                      r AS (SELECT run_id, sum(n) t, count(*) c, count(*) FILTER (n >= 50) ok, coalesce(string_agg(source_name, ',' ORDER BY source_name) FILTER (n < 50), '') f FROM per GROUP BY ALL ORDER BY run_id DESC LIMIT 20)
                      SELECT run_id, CASE WHEN t % 2 = 0 THEN 'pass' ELSE 'BLOCKED' END AS decision, t::BIGINT AS final, ok::INT AS ok, c::INT AS sources, f AS failed, 1.5::DOUBLE AS duration_s, (t % 7)::BIGINT AS added, (t % 5)::BIGINT AS removed, 0::BIGINT AS changed FROM r"""),
    "collapse_check": (lambda s, d: q.collapse(*reversed(_split(s, d))).select(F.array_join("reasons", " / ").alias("reasons")),
                       f"""WITH {LV}, p AS (SELECT * FROM lv WHERE raw_start < TIMESTAMP '2024-01-20'), n AS (SELECT * FROM lv WHERE raw_start >= TIMESTAMP '2024-01-20' AND source_name IN ('click', 'view')),
                       t AS (SELECT (SELECT count(*) FROM p) was, (SELECT count(*) FROM n) now, (SELECT count(DISTINCT source_name) FROM p) ws, (SELECT count(DISTINCT source_name) FROM n) ns,
                       (SELECT string_agg(DISTINCT source_name, ', ' ORDER BY source_name) FROM p WHERE source_name NOT IN (SELECT source_name FROM n)) lost)
                       SELECT concat_ws(' / ', CASE WHEN now < was * 0.5 THEN 'event count collapsed: ' || now || ' vs ' || was || ' currently published' END,
                       CASE WHEN ns < ws * 0.6 THEN (ws - ns) || ' of ' || ws || ' sources vanished: ' || lost END) AS reasons FROM t"""),
    "lost_sources": (lambda s, d: q.lost_sources(*_split(s, d)), f"WITH {LV} SELECT DISTINCT source_name FROM lv WHERE raw_start < TIMESTAMP '2024-01-20' AND source_name NOT IN ('click', 'view')"),
    "gate_decision": (_gate, GATE_SQL),
    "gate_report": (_report, REPORT_SQL),
    "findings_board": (_board, BOARD_SQL),
    "silent_sources": (lambda s, d: q.silent_sources(listings(s, d), registry(s)), f"WITH {LV}, {REG} SELECT name FROM reg WHERE scraped AND name NOT IN (SELECT source_name FROM lv)"),
    "unregistered_sources": (lambda s, d: q.unregistered_sources(listings(s, d), registry(s)), f"WITH {LV}, {REG} SELECT source_name AS name, count(*) AS event_count FROM lv WHERE source_name NOT IN (SELECT name FROM reg) GROUP BY ALL"),
    "coverage_signals": (lambda s, d: q.coverage_signals(listings(s, d).withColumn("source_name", F.concat("source_name", F.lit("-"), F.col("k"))), None, AS_OF).drop("pages_missing"),
                         f"WITH {LV} SELECT source_name || '-' || k AS source_name, count(*) AS events, count(*) IN (10,12,20,25,30,50,100) AS round_count, date_diff('day', DATE '2024-01-15', CAST(max(start_datetime) AS DATE)) < 14 AS short_horizon FROM lv GROUP BY source_name, k"),
    "freshness": (lambda s, d: monitors.source_freshness(listings(s, d), registry(s), "2024-02-05 06:00:00").select("name", "status", "events", "latest_start", "last_scraped", "days_since_scrape"),
                  f"""WITH {LV}, {REG}, g AS (SELECT source_name, count(*) n, max(start_datetime) ls, max(scraped_at) sc FROM lv GROUP BY ALL)
                  SELECT name, status, coalesce(n, 0) AS events, ls AS latest_start, sc AS last_scraped, CAST(floor(epoch(TIMESTAMP '2024-02-05 06:00:00' - sc) / 86400) AS INT) AS days_since_scrape FROM reg LEFT JOIN g ON name = source_name"""),
    "freshness_monitor": (lambda s, d: monitors.freshness_monitor(listings(s, d), registry(s), "2024-02-05 06:00:00").select("source", "state", "event_count", "days_since_scrape"),
                          f"""WITH {LV}, {REG}, g AS (SELECT source_name, count(*) n, CAST(floor(epoch(TIMESTAMP '2024-02-05 06:00:00' - max(scraped_at)) / 86400) AS INT) dd FROM lv GROUP BY ALL)
                          SELECT coalesce(name, source_name) AS source, CASE WHEN name IS NULL THEN 'unregistered' WHEN n IS NULL THEN 'missing' WHEN dd > CASE WHEN ci THEN 3 ELSE 14 END THEN 'stale' ELSE 'healthy' END AS state,
                          coalesce(n, 0) AS event_count, CASE WHEN name IS NOT NULL THEN dd END AS days_since_scrape FROM g FULL JOIN reg ON name = source_name WHERE coalesce(scraped, true)"""),
    "freshness_summary": (lambda s, d: monitors.freshness_summary(monitors.freshness_monitor(listings(s, d), registry(s), "2024-02-05 06:00:00")),
                          f"""WITH {LV}, {REG}, g AS (SELECT source_name, count(*) n, CAST(floor(epoch(TIMESTAMP '2024-02-05 06:00:00' - max(scraped_at)) / 86400) AS INT) dd FROM lv GROUP BY ALL),
                          m AS (SELECT CASE WHEN name IS NULL THEN 'unregistered' WHEN n IS NULL THEN 'missing' WHEN dd > CASE WHEN ci THEN 3 ELSE 14 END THEN 'stale' ELSE 'healthy' END AS st FROM g FULL JOIN reg ON name = source_name WHERE coalesce(scraped, true))
                          SELECT count(*) FILTER (st = 'healthy') AS healthy, count(*) FILTER (st = 'stale') AS stale, count(*) FILTER (st = 'missing') AS missing, count(*) FILTER (st = 'unregistered') AS unregistered FROM m"""),
    "volume_monitor": (lambda s, d: monitors.volume_monitor(
        listings(s, d).filter("raw_start >= '2024-01-29' AND source_name <> 'purchase' AND (source_name <> 'click' OR k % 4 = 0)"),
        monitors.volume_history(listings(s, d).filter("raw_start < '2024-01-29'").groupBy(F.date_format("raw_start", "yyyy-MM-dd").alias("run_id"), F.col("source_name").alias("source")).agg(F.count(F.lit(1)).alias("events"))), registry(s)),
        f"""WITH {LV}, {REG}, p AS (SELECT strftime(raw_start, '%Y-%m-%d') run_id, source_name source, count(*) n FROM lv WHERE raw_start < TIMESTAMP '2024-01-29' GROUP BY ALL),
        r AS (SELECT DISTINCT run_id FROM p ORDER BY 1 DESC LIMIT 5), a AS (SELECT source, sum(n) / count(*) av FROM p WHERE run_id IN (SELECT run_id FROM r) GROUP BY ALL),
        c AS (SELECT source_name source, count(*) n FROM lv WHERE raw_start >= TIMESTAMP '2024-01-29' AND source_name <> 'purchase' AND (source_name <> 'click' OR k % 4 = 0) GROUP BY ALL),
        x AS (SELECT source, CASE WHEN coalesce(n, 0) = 0 AND av > 5 THEN 'CRITICAL' WHEN n > 0 AND n < av * 0.5 THEN 'WARNING' WHEN n IS NULL THEN 'MISSING' END AS severity, coalesce(n, 0) AS current, round(av, 1) AS average
          FROM a LEFT JOIN c USING (source) WHERE source IN (SELECT name FROM reg WHERE status = 'active')) SELECT * FROM x WHERE severity IS NOT NULL"""),
}

