"""Open-tracking queries (the batch twins of the streams)."""

from pyspark.sql import functions as F

from leadloom.functions import templates
from leadloom.plans.registry import query
from leadloom.streaming import opens

DAY = 86_400


def _hits(v):
    return v.v_opens.select("id", F.col("token_key").alias("token"), "ip", F.col("opened_at").alias("ts"))


_T1 = """@t AS MATERIALIZED (SELECT @k AS k, row_number() OVER (PARTITION BY @k ORDER BY opened_at, id) AS n, id, opened_at AS ts FROM {v_opens}),
@t_f(k, n, id, start, hits) AS (
  SELECT DISTINCT k, 0::bigint, NULL::bigint, NULL::timestamp, 0 FROM @t
  UNION ALL
  SELECT q.k, q.n, q.id, CASE WHEN f.start IS NULL OR q.ts - f.start >= interval 1 day THEN q.ts ELSE f.start END,
    CASE WHEN f.start IS NULL OR q.ts - f.start >= interval 1 day THEN 1 ELSE f.hits + 1 END
  FROM @t_f f JOIN @t q ON q.k = f.k AND q.n = f.n + 1)"""


@query("fixed_window_limit", "T1", "WITH RECURSIVE " + _T1.replace("@t", "t").replace("@k", "token_key")
       + " SELECT id, k AS token, hits <= 2 AS admitted FROM t_f WHERE n > 0")
def fixed_window_limit(v):
    return opens.rate_limit(_hits(v).select("id", "token", "ts"), "token", 2, DAY, "first_hit").drop("ts")


@query("limited_requests", "T1 S10", "WITH RECURSIVE " + _T1.replace("@t", "t").replace("@k", "token_key") + ",\n" + _T1.replace("@t", "i").replace("@k", "ip")
       + " SELECT t_f.id, t_f.hits <= 2 AND i_f.hits <= 20 AS admitted FROM t_f JOIN i_f ON i_f.id = t_f.id")
def limited_requests(v):
    """The opens as the image requests that they were, read back."""
    token = templates.tracking_token(F.col("token_key"), "salt")
    requests = v.v_opens.select("id", F.lit("GET").alias("method"), F.concat(F.lit("/email/footer/"), token, F.lit(".png")).alias("path"),
                                F.concat(F.lit(" "), "ip", F.lit(", 10.0.0.1")).alias("forwarded_for"), F.lit("10.0.0.2").alias("real_ip"),
                                F.lit("reader").alias("user_agent"), F.col("opened_at").alias("ts"))
    return opens.limit_requests(opens.read_open_requests(requests), 20, 2, DAY).select("id", "admitted")


_T2 = """q AS MATERIALIZED (SELECT token_key * 10 + 1 AS k, row_number() OVER (PARTITION BY token_key ORDER BY opened_at, id) AS n, id, opened_at AS ts
  FROM {v_opens} WHERE token_key * 10 + 1 IN (SELECT id FROM {v_emails} WHERE sent_at IS NOT NULL)),
f(k, n, id, ts, ok, taken) AS (
  SELECT DISTINCT k, 0::bigint, NULL::bigint, NULL::timestamp, false, []::timestamp[] FROM q
  UNION ALL
  SELECT k, n, id, ts, len(recent) < 2, CASE WHEN len(recent) < 2 THEN list_append(recent, ts) ELSE recent END
  FROM (SELECT q.k, q.n, q.id, q.ts, list_filter(f.taken, lambda x: x > q.ts - interval 1 day) AS recent FROM f JOIN q ON q.k = f.k AND q.n = f.n + 1))"""


def _emails(v):
    """The first email of a prospect is the one its token belongs to."""
    return v.v_emails.withColumn("tracking_token", F.floor(F.col("id") / 10)).where(F.col("sequence_step") == 1)


@query("deduplicated_opens", "T8", "WITH RECURSIVE " + _T2 + " SELECT id, k AS email_id FROM f WHERE ok")
def deduplicated_opens(v):
    """Every open delivered twice counts once."""
    twice = _hits(v).unionByName(_hits(v))
    return opens.recorded_opens(opens.once(twice), _emails(v), 2, DAY).select("id", "email_id")


@query("recorded_opens", "T2", "WITH RECURSIVE " + _T2 + " SELECT id, k AS email_id FROM f WHERE ok")
def recorded_opens(v):
    return opens.recorded_opens(_hits(v), _emails(v), 2, DAY).select("id", "email_id")


@query("open_rollup", "T3", "WITH RECURSIVE " + _T2 + """, r AS (SELECT k, min(ts) AS first, max(ts) AS last, count(*) AS n FROM f WHERE ok GROUP BY 1)
SELECT e.id, CASE WHEN e.status = 'sent' AND r.n IS NOT NULL THEN 'opened' ELSE e.status END AS status, coalesce(r.n, 0) AS open_count,
 strftime(r.first, '%Y-%m-%d %H:%M:%S') AS first_opened, strftime(r.last, '%Y-%m-%d %H:%M:%S') AS last_opened
FROM {v_emails} e LEFT JOIN r ON r.k = e.id WHERE e.sequence_step = 1""")
def open_rollup(v):
    recorded = opens.recorded_opens(_hits(v), _emails(v), 2, DAY)
    shown = "yyyy-MM-dd HH:mm:ss"
    return opens.open_rollup(_emails(v), recorded).select(
        "id", "status", "open_count", F.date_format("first_opened_at", shown).alias("first_opened"), F.date_format("last_opened_at", shown).alias("last_opened"))


@query("open_requests", "S10", """
SELECT event_id AS id, repeat('t', 30) || lpad(cast(user_id AS varchar), 8, '0') AS token, CASE event_id % 3 WHEN 0 THEN '10.0.0.' || (user_id % 9) WHEN 1 THEN '9.9.9.9' ELSE 'unknown' END AS ip,
 500 AS agent_chars FROM {events} WHERE event_id % 5 <> 4 AND event_id % 7 <> 6""")
def open_requests(v):
    key = F.col("event_id")
    token = F.concat(F.repeat(F.lit("t"), F.lit(30)), F.lpad(F.col("user_id").cast("string"), 8, "0"))
    suffix = F.when(key % 5 == 0, ".png").when(key % 5 == 1, ".jpeg/").when(key % 5 == 2, "/").when(key % 5 == 3, "").otherwise("x/more")
    requests = v.events.select(
        key.alias("id"), F.when(key % 7 == 6, "HEAD").otherwise("GET").alias("method"), F.concat(F.lit("/email/footer/"), token, suffix).alias("path"),
        F.when(key % 3 == 0, F.concat(F.lit(" 10.0.0."), (F.col("user_id") % 9).cast("string"), F.lit(" , 1.1.1.1"))).alias("forwarded_for"),
        F.when(key % 3 == 1, "9.9.9.9").alias("real_ip"), F.repeat(F.lit("agent "), F.lit(100)).alias("user_agent"))
    return opens.read_open_requests(requests).select("id", "token", "ip", F.length("user_agent").alias("agent_chars"))


@query("usage_by_day", "T4", """
SELECT strftime(created_at, '%Y-%m-%d') AS day, action, model, cast(sum(input_tokens) AS bigint) AS input_tokens, cast(sum(output_tokens) AS bigint) AS output_tokens, cast(sum(credits) AS decimal(18, 2)) AS credits, count(*) AS calls
FROM {v_usage} GROUP BY 1, 2, 3""")
def usage_by_day(v):
    return opens.usage_stream(v.v_usage).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
