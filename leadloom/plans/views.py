"""The lead data model as views over the given tables.

One SQL text per view serves Spark and the oracle; ``{name}`` stands for a table or another view.
The few places where the dialects differ are ``[[spark || oracle]]`` pairs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {}

VIEWS["v_campaigns"] = """
SELECT cast(n_nationkey AS bigint) AS id, n_name AS name, 30 + 10 * (n_nationkey % 4) AS min_score,
       CASE WHEN n_nationkey % 6 = 5 THEN NULL WHEN n_nationkey % 6 = 4 THEN '  '
            ELSE concat('Qualify businesses of ', n_name) END AS prompt,
       CASE n_nationkey % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' WHEN 2 THEN 'pending' ELSE 'failed' END AS status,
       CASE n_nationkey % 3 WHEN 0 THEN 'Asia/Karachi' WHEN 1 THEN 'Europe/Berlin' ELSE 'America/New_York' END AS send_timezone
FROM {nation}"""

# three sequences on offer, each campaign uses some of them
VIEWS["v_campaign_sequences"] = " UNION ALL ".join(f"""
SELECT cast(n_nationkey AS bigint) AS campaign_id, cast({i} AS bigint) AS sequence_id
FROM {{nation}} WHERE (n_nationkey + {i}) % 4 <> 0 AND n_nationkey % 7 <> 6""" for i in (1, 2, 3))

VIEWS["v_sequences"] = """
SELECT cast(id AS bigint) AS id, name, cast(initial_template_id AS bigint) AS initial_template_id
FROM (VALUES (1, 'Warm', 1), (2, 'Short', 2), (3, 'Bare', NULL)) AS t(id, name, initial_template_id)"""

_STEPS = ", ".join(f"({q}, {step}, {days}, {'NULL' if (q, step) == (2, 3) else 10 * q + step})"
                   for q in (1, 2, 3) for step, days in ((1, 3), (2, 5), (3, 7), (4, 9)))
VIEWS["v_follow_ups"] = f"""
SELECT cast(q AS bigint) AS sequence_id, step AS sequence, days AS days_after_previous, cast(t AS bigint) AS template_id
FROM (VALUES {_STEPS}) AS f(q, step, days, t)"""

VIEWS["v_mailboxes"] = """
SELECT cast(id AS bigint) AS id, id AS priority, id <> 3 AS is_active
FROM (VALUES (1), (2), (3), (4)) AS t(id)"""

VIEWS["v_businesses"] = """
SELECT c_custkey AS id, cast(c_nationkey AS bigint) AS discovery_campaign_id, c_name AS name, c_mktsegment AS category,
       CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN ''
            ELSE concat('https://biz', cast(c_custkey AS string), '.example.org') END AS website_url,
       CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE cast(10 * (c_custkey % 120) AS int) END AS google_review_count,
       CASE WHEN c_custkey % 9 = 0 THEN NULL
            ELSE cast(3.0 + 0.1 * (c_custkey % 21) AS decimal(2, 1)) END AS google_rating,
       CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN ''
            ELSE concat('City ', cast(c_custkey % 40 AS string)) END AS city,
       CASE WHEN c_custkey % 19 = 0 THEN 'approved' WHEN c_custkey % 23 = 0 THEN 'rejected' END AS review_status
FROM {customer}"""

VIEWS["v_website_profiles"] = """
SELECT c_custkey AS business_id,
       CASE WHEN c_custkey % 10 < 7 THEN 'completed' WHEN c_custkey % 10 = 7 THEN 'failed'
            WHEN c_custkey % 20 = 8 THEN 'running' ELSE 'pending' END AS status,
       CASE WHEN c_custkey % 10 < 7 THEN cast(floor((c_acctbal + 1000) / 110) AS int) END AS qualification_score,
       CASE WHEN c_custkey % 10 < 7 AND c_custkey % 3 = 0 THEN 'completed'
            WHEN c_custkey % 10 < 7 AND c_custkey % 8 = 1 THEN 'no_contacts' END AS contact_discovery_status,
       CASE WHEN c_custkey % 40 = 8 THEN timestamp '2024-01-02 11:00:00'
            ELSE timestamp '2024-01-02 11:58:00' END AS updated_at
FROM {customer} WHERE c_custkey % 12 <> 5"""

VIEWS["v_prospects"] = """
SELECT o_orderkey AS id, o_custkey AS business_id, o_custkey * 3 + o_orderkey % 3 AS contact_id,
       concat('p', cast(o_orderkey % 97 AS string), '@biz', cast(o_custkey AS string), '.example.org') AS email,
       CASE substr(o_orderpriority, 1, 1) WHEN '3' THEN 'risky' WHEN '4' THEN 'unknown' WHEN '5' THEN 'undeliverable'
            ELSE 'deliverable' END AS email_status,
       CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 37 = 0 THEN 'excluded'
            ELSE CASE substr(o_orderpriority, 1, 1) WHEN '3' THEN 'catch_all' WHEN '4' THEN 'smtp_unreachable'
                 WHEN '5' THEN 'mailbox_not_found' ELSE 'deliverable' END END AS verdict,
       CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'needs_review' ELSE 'pending' END AS outreach_status,
       o_orderkey % 17 = 0 AS do_not_contact, o_orderkey % 29 = 0 AS approved_by_person,
       CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 3 + 1 END AS email_sequence_id,
       CASE WHEN o_orderkey % 41 = 0 THEN o_orderdate END AS sequence_stopped_at,
       CASE WHEN o_orderkey % 41 = 0 AND o_orderkey % 2 = 0 THEN 'replied' END AS sequence_stop_reason,
       CASE WHEN o_orderkey % 6 = 0 THEN 'initial_email' WHEN o_orderkey % 6 = 1 THEN 'follow_up'
            WHEN o_orderkey % 30 = 2 THEN 'replied' WHEN o_orderkey % 30 = 3 THEN 'lost' END AS pipeline_stage,
       CASE WHEN o_orderkey % 6 < 2 THEN o_orderdate END AS stage_changed_at,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE cast(o_orderkey % 101 AS int) END AS qualification_score,
       CASE WHEN o_orderkey % 7 = 3 THEN cast(o_orderkey % 101 AS int) END AS email_score,
       CASE WHEN o_orderkey % 7 = 3 THEN o_orderdate END AS email_scored_at
FROM {orders}"""

VIEWS["v_contacts"] = """
SELECT id, min(business_id) AS business_id,
       CASE WHEN id % 11 = 0 THEN NULL ELSE concat('Person ', cast(id AS string)) END AS name,
       CASE id % 4 WHEN 0 THEN 'Owner' WHEN 1 THEN 'Office Manager' WHEN 2 THEN 'Dentist' ELSE 'Receptionist' END AS job_title,
       CASE id % 5 WHEN 0 THEN 'manual' WHEN 1 THEN NULL WHEN 2 THEN 'hunter' WHEN 3 THEN 'website' ELSE 'inferred' END AS email_source,
       CASE id % 4 WHEN 0 THEN 'unverified' WHEN 1 THEN NULL WHEN 2 THEN 'unknown' ELSE 'deliverable' END AS email_status,
       id % 3 = 0 AS is_primary
FROM (SELECT o_custkey * 3 + o_orderkey % 3 AS id, o_custkey AS business_id FROM {orders}) AS c
GROUP BY id"""

VIEWS["v_line_copies"] = """
SELECT l_orderkey, l_linenumber,
       min([[struct || row]](l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus)) AS copy
FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""

VIEWS["v_emails"] = """
SELECT l_orderkey * 10 + step AS id, l_orderkey AS prospect_id, cast(step AS int) AS sequence_step,
       CASE WHEN flag = 'R' THEN 'replied' WHEN flag = 'A' AND line = 'F' THEN 'opened' WHEN flag = 'A' THEN 'sent'
            WHEN line = 'F' THEN 'in_review' ELSE 'approved' END AS status,
       CASE WHEN flag IN ('R', 'A') THEN shipdate END AS sent_at, shipdate AS scheduled_at,
       suppkey % 4 + 1 AS mailbox_id,
       concat(CASE WHEN partkey % 50 = 0 THEN 'PLACEHOLDER ' ELSE '' END, 'Offer ', cast(partkey AS string)) AS subject
FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS step,
             [[copy.l_shipdate || struct_extract_at(copy, 1)]] AS shipdate,
             [[copy.l_partkey || struct_extract_at(copy, 2)]] AS partkey,
             [[copy.l_suppkey || struct_extract_at(copy, 3)]] AS suppkey,
             [[copy.l_returnflag || struct_extract_at(copy, 6)]] AS flag,
             [[copy.l_linestatus || struct_extract_at(copy, 7)]] AS line
      FROM {v_line_copies}) AS e"""

VIEWS["v_emails_of"] = """
SELECT e.*, p.business_id, p.contact_id, p.email AS recipient
FROM {v_emails} AS e JOIN {v_prospects} AS p ON p.id = e.prospect_id"""

VIEWS["v_opens"] = """
SELECT event_id AS id, user_id AS token_key, ts AS opened_at,
       [[get_json_object(props, '$.k') || json_extract_string(props, '$.k')]] AS ip
FROM {events} WHERE event_type IN ('view', 'click')"""

VIEWS["v_usage"] = """
SELECT event_id AS id, ts AS created_at,
       CASE event_type WHEN 'view' THEN 'research' WHEN 'click' THEN 'email_scoring' WHEN 'signup' THEN 'decision_makers'
            WHEN 'purchase' THEN 'verification' ELSE 'other' END AS action,
       CASE WHEN event_type IN ('signup', 'purchase') THEN 'hunter' WHEN user_id % 2 = 0 THEN 'openai' ELSE 'groq' END AS provider,
       concat('model-', cast(user_id % 3 AS string)) AS model,
       cast(round(value * 100) AS bigint) AS input_tokens, cast(round(value * 10) AS bigint) AS output_tokens,
       cast(user_id % 50 AS bigint) AS reasoning_tokens,
       cast(CASE event_type WHEN 'purchase' THEN 0.5 WHEN 'signup' THEN 1 ELSE 0 END AS decimal(8, 2)) AS credits,
       user_id AS business_id
FROM {events}"""

VIEWS["v_listings"] = """
SELECT c_custkey * 4 AS arrival, c_custkey AS origin, cast(c_nationkey AS bigint) AS campaign_id, c_name AS name,
       CASE WHEN c_custkey % 6 = 1 THEN NULL ELSE concat('ChIJplace', lpad(cast(c_custkey AS string), 8, '0')) END AS place_id,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('https://maps.example.com/?cid=', cast(c_custkey AS string)) END AS maps_url,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat(cast(c_custkey % 50 AS string), ' Main St') END AS address,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('biz', cast(c_custkey AS string), '.example.org') END AS domain
FROM {customer}
UNION ALL
SELECT c_custkey * 4 + 1, c_custkey, cast(c_nationkey AS bigint), upper(c_name), NULL, NULL,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat(cast(c_custkey % 50 AS string), ' MAIN ST') END,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('www.biz', cast(c_custkey AS string), '.example.org') END
FROM {customer} WHERE c_custkey % 4 = 0
UNION ALL
SELECT c_custkey * 4 + 2, c_custkey, cast(c_nationkey AS bigint), c_name,
       concat('ChIJother', lpad(cast(c_custkey AS string), 8, '0')), NULL,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat(cast(c_custkey % 50 AS string), ' Main St') END, NULL
FROM {customer} WHERE c_custkey % 9 = 0
UNION ALL
SELECT s_suppkey * 4 + 3, -s_suppkey, cast(s_nationkey AS bigint), concat('Customer#', lpad(cast(s_suppkey * 3 AS string), 9, '0')),
       NULL, CASE WHEN s_suppkey % 2 = 0 THEN concat('https://maps.example.com/?cid=', cast(s_suppkey AS string)) END,
       concat(cast(s_suppkey * 3 % 50 AS string), ' Main St'), NULL
FROM {supplier}"""

EXCLUDED_PATTERNS = ("p1*@*", "*@biz7.*", "p9?@*")

_DIALECT = re.compile(r"\[\[(.*?) \|\| (.*?)\]\]", re.S)
_NAME = re.compile(r"\{(\w+)\}")


def _dialect(sql: str, oracle: bool) -> str:
    return _DIALECT.sub(lambda m: m.group(2 if oracle else 1), sql)


class Views:
    """The tables and views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir.rstrip("/"), {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in VIEWS:
                self._made[name] = self.sql(VIEWS[name])
            else:
                raise AttributeError(name)
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        text = _dialect(text, oracle=False)
        used = {name: getattr(self, name) for name in set(_NAME.findall(text))}
        return self.spark.sql(text, **used)


def oracle_text(body: str) -> str:
    """An oracle query with the views it names (directly or not) as leading CTEs."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _NAME.findall(text):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                if name not in order:
                    order.append(name)

    visit(body)
    # DuckDB: a view read several times is computed once
    ctes = [f"{name} AS MATERIALIZED ({_plain(VIEWS[name])})" for name in order]
    body = _plain(body).strip()
    if not ctes:
        return body
    recursive = re.match(r"WITH\s+RECURSIVE\s+", body, re.I)
    if recursive:
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[recursive.end():]
    leading = re.match(r"WITH\s+", body, re.I)
    if leading:
        return "WITH " + ",\n".join(ctes) + ",\n" + body[leading.end():]
    return "WITH " + ",\n".join(ctes) + "\n" + body


def _plain(sql: str) -> str:
    sql = _NAME.sub(lambda m: m.group(1) if m.group(1) in VIEWS or m.group(1) in TABLES else m.group(0),
                    _dialect(sql, oracle=True))
    return re.sub(r"\bAS string\)", "AS varchar)", sql)
