"""python -m tidewell.cli: runs the collector, or answers about it. Exit codes: 0 done, 1 failed, 2 wrong usage, 3 wrong settings."""

from __future__ import annotations

import argparse
import datetime as dt
import logging
import signal
import sys
import threading
import urllib.request

from . import config
from .api import openapi

VERSION = "0.2.0"
log = logging.getLogger(__name__)


def _split(address: str) -> tuple[str, int]:
    host, _, port = address.rpartition(":")
    return host.strip("[]") or "0.0.0.0", int(port)


def _stores(settings: config.Config, spark) -> dict:
    from .sinks.messages import KafkaSink, MessageFolder
    from .sinks.sql import SqlSink
    from .sinks.table import FlowTable

    made = {"sql": lambda: SqlSink(settings.sql_url), "table": lambda: FlowTable(spark, settings.table_path), "folder": lambda: MessageFolder(settings.folder_path), "bus": lambda: KafkaSink(list(settings.bus_brokers), settings.bus_topic)}
    stores = {name: made[name]() for name in settings.sinks}
    for s in stores.values():
        if hasattr(s, "migrate"):
            s.migrate()
    return stores


def _template_log(settings: config.Config, spark):
    """The shared templates as they stand and as they are added (both read when called), and the sink that adds to them; Nones without the setting."""
    from .sources import bus
    from .sinks.messages import EnvelopeFolder, EnvelopeTopic

    if settings.template_topic:
        brokers = list(settings.bus_brokers)
        return lambda: bus.kafka_table(spark, brokers, settings.template_topic), lambda: bus.kafka_stream(spark, brokers, settings.template_topic), EnvelopeTopic(brokers, settings.template_topic)
    if settings.template_path:
        folder = EnvelopeFolder(settings.template_path)
        folder.create(spark)
        return lambda: folder.read(spark), lambda: bus.folder_stream(spark, f"{settings.template_path}/{folder.UNIT}"), folder
    return None, None, None


def run(settings: config.Config, spark=None, stop: threading.Event | None = None, metrics=None) -> int:
    """Lands datagrams, ingests what arrives, keeps the table in order, and serves reads until told to stop."""
    from pyspark.sql import SparkSession

    from .api.server import Service, serve
    from .obs import Metrics, StreamWatch, log_to_stderr
    from .session import ship
    from .sources import bus
    from .sources.landing import Landing
    from .streaming import ingest, templated
    from .streaming.datagrams import records_of

    log_to_stderr(settings.log_level)
    spark = spark or SparkSession.builder.appName("tidewell").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    metrics, stop, seconds, own = metrics or Metrics(), stop or threading.Event(), settings.batch_seconds, settings.checkpoint_path
    stores = _stores(settings, spark)
    sinks = {n: ingest.stored(s, metrics) if n == "table" else s.write_batch for n, s in stores.items()}
    queries, landing, server, watch = [], None, None, StreamWatch(metrics)
    spark.streams.addListener(watch)
    if "udp" in settings.sources:
        shared, news, publish = _template_log(settings, spark)
        landing = Landing(settings.landing_path, metrics, settings.buffer, settings.batch_size, seconds)
        landing.start(*_split(settings.udp_addr))
        # what others learned comes before what is heard, unless it takes too long
        known = shared and templated.replayed(shared, f"{own}/known-templates", settings.template_seconds)
        queries.append(records_of(spark, bus.landed_stream(spark, settings.landing_path), sinks, f"{own}/udp", metrics, seconds, known=known, news=news and news(), delivery=settings.delivery))
        if publish:
            queries.append(templated.share(spark, settings.landing_path, publish.write_batch, f"{own}/templates", metrics, seconds))
    arriving = {f"{own}/bus": lambda: bus.kafka_stream(spark, list(settings.bus_brokers), settings.bus_topic)} if "bus" in settings.sources else {}
    if "folder" in settings.sources:
        arriving |= {f"{own}/inbox-{i}": lambda p=p: bus.folder_stream(spark, p) for i, p in enumerate(settings.inbox_paths)}
    for at, messages in arriving.items():
        queries.append(ingest.messages_of(messages(), sinks, at, metrics, f"{own}/quarantine", seconds, delivery=settings.delivery))
    if settings.http_addr:
        server = serve(Service(stores, settings.api_keys, metrics), *_split(settings.http_addr))
        threading.Thread(target=server.serve_forever, daemon=True).start()
    keeper = threading.Thread(target=_maintain, args=(stores, settings, stop), daemon=True)
    keeper.start()
    if threading.current_thread() is threading.main_thread():
        for s in (signal.SIGINT, signal.SIGTERM):
            signal.signal(s, lambda *_: stop.set())
    while not stop.wait(0.2) and all(q.isActive for q in queries):
        if landing:
            metrics.set("buffer_length", len(landing.buffer))
    failed = any(q.exception() for q in queries)
    stop.set()
    if server:
        server.shutdown()
    if landing:
        landing.stop()
    for q in queries:
        ingest.drain(q)
    keeper.join(30)
    spark.streams.removeListener(watch)
    return int(failed)


def _maintain(stores: dict, settings: config.Config, stop: threading.Event) -> None:
    """Retention and merging, at the start and from time to time; a failure is logged and tried again next time."""
    while not stop.is_set():
        for name, s in stores.items():
            if hasattr(s, "maintain"):
                try:
                    s.maintain(dt.datetime.now(dt.UTC), settings.retention_days)
                except Exception:
                    log.exception("maintenance failed", extra={"fields": {"store": name}})
        stop.wait(settings.maintenance_seconds)


def main(args: list[str] | None = None, env: dict[str, str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidewell")
    one = parser.add_mutually_exclusive_group()
    for flag, what in (("--version", "print the version"), ("--validate-config", "check the settings"), ("--dump-openapi", "print the API's document"), ("--healthcheck", "ask a running collector whether it is up")):
        one.add_argument(flag, action="store_true", help=what)
    try:
        o = parser.parse_args(args)
    except SystemExit as e:
        return int(e.code or 0)
    if o.version:
        print(VERSION)
        return 0
    if o.dump_openapi:
        print(openapi.dump(), end="")
        return 0
    try:
        settings = config.load(env)
    except config.ConfigError as e:
        print(e, file=sys.stderr)
        return 3
    if o.validate_config:
        print("settings are valid")
        return 0
    if o.healthcheck:
        host, port = _split(settings.http_addr or "127.0.0.1:0")
        try:
            with urllib.request.urlopen(f"http://{'127.0.0.1' if host == '0.0.0.0' else host}:{port}/healthz", timeout=2) as r:
                return int(r.status != 200)
        except OSError as e:
            print(e, file=sys.stderr)
            return 1
    return run(settings)


if __name__ == "__main__":
    sys.exit(main())
