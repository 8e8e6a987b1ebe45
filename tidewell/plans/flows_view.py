"""Flows over the `events` table: one SQL text that Spark and DuckDB both read, for queries to be compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FLOWS_SQL = """
select ts as received_at, event_id as seq, user_id % 16 + 1 as exporter_id,
  concat('203.0.113.', cast(user_id % 16 + 1 as varchar(3))) as exporter_addr,
  case user_id % 5 when 0 then 'ipfix' when 1 then 'netflow9' when 2 then 'netflow9' else 'netflow5' end as flow_type,
  ts - interval '1' second * (event_id % 29 + 3) as first_switched, ts - interval '3' second as last_switched,
  concat('100.64.', cast(user_id % 32 as varchar(3)), '.', cast(event_id % 200 + 1 as varchar(3))) as src_addr,
  concat('10.84.3.', cast(user_id % 40 + 11 as varchar(3))) as dst_addr,
  cast(1024 + event_id * 31 % 60000 as integer) as src_port, case when event_id % 4 = 3 then 53 else 8883 end as dst_port,
  case when event_id % 4 = 3 then 17 else 6 end as protocol, case when event_id % 4 = 3 then 0 else 27 end as tcp_flags,
  event_id % 61 + 2 as packets, (event_id % 1400 + 1) * 53 as bytes,
  cast(case when user_id % 6 = 0 then 256 else 1 end as bigint) as sampling_rate,
  cast(user_id % 12 as bigint) as input_iface, cast(event_id % 7 as bigint) as output_iface,
  cast(65100 + user_id % 9 as bigint) as src_as, cast(65190 + event_id % 3 as bigint) as dst_as,
  case when event_id % 5 = 2 then null else concat('203.0.113.', cast(240 + user_id % 4 as varchar(3))) end as next_hop,
  case when event_type = 'error' then null else concat('k', cast(event_id as varchar(20))) end as dedup_key
from events"""


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view's rows. The table is named by its path, so that no session-wide view is replaced."""
    return spark.sql(FLOWS_SQL.replace("from events", "from {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))
