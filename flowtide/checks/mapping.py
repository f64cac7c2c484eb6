"""The driver's tables read as packets, detections, flow rows and lifecycle events.

Each mapping is one SELECT that Spark SQL and DuckDB both run. ``us(col)`` stands for
the engine's spelling of "microseconds since 1970".
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from flowtide.config import HOUR, FlowConfig

# Timeouts that fit the spacing of the events table (about 4.3 minutes at sf0.01).
FLOW = FlowConfig(idle_us=6 * HOUR, active_us=24 * HOUR, activity_us=2 * HOUR)

_K = "cast(regexp_extract(props, '[0-9]+', 0) as int)"

PACKETS = f"""
SELECT CASE WHEN event_id % 3 <> 0 THEN ip_a ELSE ip_b END AS src_ip,
       CASE WHEN event_id % 3 <> 0 THEN ip_b ELSE ip_a END AS dst_ip,
       CASE WHEN event_id % 3 <> 0 THEN port_a ELSE port_b END AS src_port,
       CASE WHEN event_id % 3 <> 0 THEN port_b ELSE port_a END AS dst_port,
       protocol, pkt_len, ts, tcp_flags, header_len, win_size,
       greatest(pkt_len - 100, 0) AS payload_len, event_id AS seq
FROM (
  SELECT event_id, ts,
         concat('10.0.', cast(cast(floor(g / 250) as int) as varchar(9)), '.', cast(g % 250 + 1 as varchar(9))) AS ip_a,
         cast(40000 + g % 1000 as int) AS port_a,
         concat('172.16.0.', cast(g % 250 + 1 as varchar(9))) AS ip_b,
         cast(CASE g % 4 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 22 ELSE 53 END as int) AS port_b,
         CASE WHEN g % 5 < 3 THEN 'tcp' ELSE 'udp' END AS protocol,
         cast(40 + floor(value) as int) AS pkt_len,
         cast(CASE WHEN event_type = 'error' AND value > 50 THEN 1 ELSE 0 END
            + CASE WHEN event_type = 'signup' THEN 2 ELSE 0 END
            + CASE WHEN event_type = 'purchase' THEN 8 ELSE 0 END
            + CASE WHEN event_type = 'click' THEN 16 ELSE 0 END
            + CASE WHEN event_type = 'view' AND k % 10 = 0 THEN 32 ELSE 0 END as int) AS tcp_flags,
         cast(20 + 4 * (k % 6) as int) AS header_len,
         cast(1024 * (k % 10) as int) AS win_size
  FROM (SELECT event_id, ts, event_type, value, {_K} AS k, cast(floor(user_id / 8) as int) AS g FROM {{events}}) e
) p
"""

DETECTIONS = f"""
SELECT event_id AS id, source_ip, destination_ip, source_port, destination_port, protocol,
       prediction, confidence,
       CASE WHEN prediction = 'BENIGN' THEN 'LOW'
            WHEN confidence < 0.55 AND prediction IN ('DoS', 'DDoS') THEN 'MEDIUM'
            WHEN confidence < 0.55 THEN 'LOW'
            WHEN prediction = 'DDoS' THEN 'CRITICAL' WHEN prediction = 'DoS' THEN 'HIGH'
            ELSE 'MEDIUM' END AS severity,
       (prediction IS NULL OR prediction <> 'BENIGN') AS is_intrusion,
       concat('v', cast(user_id % 5 as varchar(9))) AS model_version, ts AS timestamp, 'NEW' AS status,
       total_pkts, duration_s, syn_count
FROM (
  SELECT event_id, ts, user_id,
         CASE WHEN user_id % 41 = 3 THEN NULL
              ELSE concat('10.1.', cast(user_id % 4 as varchar(9)), '.', cast(user_id % 250 as varchar(9))) END AS source_ip,
         concat('172.16.', cast(k % 3 as varchar(9)), '.', cast(k % 6 + 1 as varchar(9))) AS destination_ip,
         cast(40000 + user_id % 1000 as int) AS source_port,
         cast(CASE WHEN k % 13 = 0 THEN 53 ELSE 8000 + k END as int) AS destination_port,
         CASE k % 4 WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP' WHEN 2 THEN '6' ELSE '17' END AS protocol,
         CASE WHEN k = 7 THEN NULL WHEN event_type IN ('click', 'view') THEN 'BENIGN'
              WHEN event_type = 'error' THEN 'PortScan' WHEN event_type = 'signup' THEN 'DoS' ELSE 'DDoS' END AS prediction,
         round(least(cast(1.0 as double), 0.5 + (value % 50) / 100), 4) AS confidence,
         cast(1 + k % 40 as bigint) AS total_pkts, value / 100 AS duration_s, cast(k % 30 as bigint) AS syn_count
  FROM (SELECT event_id, ts, event_type, user_id, value, {_K} AS k FROM {{events}}) e
) d
"""

FLOW_ROWS = """
SELECT row_id, CASE WHEN l_orderkey % 17 = 0 THEN NULL WHEN l_orderkey % 29 = 0 THEN 'inf'
                    WHEN l_orderkey % 31 = 0 THEN 'abc' ELSE cast(l_extendedprice as varchar(40)) END AS " Flow Duration",
       cast(l_quantity as varchar(40)) AS "totlen fwd packets",
       CASE WHEN l_orderkey % 23 = 0 THEN '-Infinity' ELSE cast(l_discount as varchar(40)) END AS "FLOW BYTES/S",
       cast(l_tax as varchar(40)) AS "Idle Mean",
       concat('f', cast(l_orderkey as varchar(20))) AS "Flow ID",
       cast(l_partkey as varchar(20)) AS "Fwd Header Length.1",
       CASE l_linenumber WHEN 1 THEN 'BENIGN' WHEN 2 THEN ' DoS Hulk ' WHEN 3 THEN 'PortScan'
            WHEN 4 THEN 'DDoS attacks-LOIC-HTTP' WHEN 5 THEN 'Botnet' WHEN 6 THEN 'Mystery' ELSE NULL END AS " Label"
FROM (SELECT *, l_orderkey * 8 + l_linenumber AS row_id FROM {lineitem}) l
"""

LIFECYCLE = """
SELECT concat('a', cast(o_custkey as varchar(20))) AS alert_id, o_orderdate AS ts, o_orderkey AS event_id,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'NOTE' WHEN o_orderstatus = 'F' THEN 'RESOLVE'
            WHEN o_orderstatus = 'P' THEN 'ACK' ELSE 'CREATE' END AS kind,
       concat('analyst', cast(o_orderkey % 7 as varchar(9))) AS actor,
       concat('order ', cast(o_orderkey as varchar(20))) AS text
FROM {orders}
"""

ALERTS = """
SELECT concat('a', cast(o_orderkey as varchar(20))) AS id, o_orderkey * 3 AS detection_id, o_orderdate AS timestamp,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'DDoS' WHEN '2' THEN 'DoS' WHEN '3' THEN 'PortScan'
            WHEN '4' THEN 'Bot' ELSE 'Web Attack' END AS attack_type,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CRITICAL' WHEN '2' THEN 'HIGH' WHEN '3' THEN 'MEDIUM'
            WHEN '4' THEN 'HIGH' ELSE NULL END AS severity,
       CASE o_orderstatus WHEN 'O' THEN 'ACTIVE' WHEN 'P' THEN 'ACKNOWLEDGED' ELSE 'RESOLVED' END AS status
FROM {orders}
"""

REGISTRY = """
SELECT concat('m', cast(s_suppkey as varchar(20))) AS model_id, concat('v', cast(s_suppkey as varchar(20))) AS version,
       CASE s_nationkey % 4 WHEN 0 THEN 'random_forest' WHEN 1 THEN 'decision_tree'
            WHEN 2 THEN 'logistic_regression' ELSE 'svm' END AS model_type,
       CASE WHEN s_acctbal < 0 THEN 'FAILED' ELSE 'TRAINED' END AS status,
       s_suppkey * 3 % 101 AS created_at, CASE WHEN s_acctbal > 5000 THEN s_suppkey * 7 % 97 END AS activated_at,
       round(s_acctbal / 10000, 4) AS accuracy
FROM {supplier}
"""

AUDIT = """
SELECT c_custkey AS id, c_custkey * 37 % 1009 AS timestamp,
       CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'LOGIN' WHEN 'MACHINERY' THEN 'ALERT_RESOLVED'
            WHEN 'FURNITURE' THEN 'MODEL_ACTIVATED' ELSE 'ALERT_ACKNOWLEDGED' END AS event,
       c_name AS username
FROM {customer}
"""

PREDICTIONS = """
SELECT doc_id, CASE WHEN quality = 1 THEN 'BENIGN' ELSE 'DoS' END AS label,
       CASE WHEN toxic = 1 THEN 'Bot' WHEN doc_id % 5 = 0 THEN 'DoS' ELSE 'BENIGN' END AS prediction,
       round(cast(doc_id * 7919 % 1000 as double) / 1000 + 0.2 * quality, 4) AS score
FROM {labels}
"""

MAPPINGS = {
    "packets": PACKETS, "detections": DETECTIONS, "flow_rows": FLOW_ROWS, "lifecycle": LIFECYCLE,
    "alerts": ALERTS, "registry": REGISTRY, "audit": AUDIT, "predictions": PREDICTIONS,
}


def duck(name: str) -> str:
    """The mapping as DuckDB text."""
    return re.sub(r"\{(\w+)\}", r"\1", MAPPINGS[name])


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The mapping as a DataFrame over the parquet tables of ``sf_dir``."""
    text = MAPPINGS[name].replace("varchar(40)", "string").replace("varchar(20)", "string").replace("varchar(9)", "string")
    text = re.sub(r'AS "([^"]+)"', r"AS `\1`", text)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in re.findall(r"\{(\w+)\}", text)}
    return spark.sql(text, **tables)


def with_ctes(sql: str) -> str:
    """Prefixes the mappings a query names as ``$name`` as CTEs."""
    used = [n for n in MAPPINGS if re.search(rf"\${n}\b", sql)]
    body = re.sub(r"\$(\w+)", lambda m: f"map_{m[1]}" if m[1] in MAPPINGS else m[0], sql).strip()
    ctes = ", ".join(f"map_{n} AS ({duck(n)})" for n in used)
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[len('WITH '):]}"
    return f"WITH {ctes} {body}"
