"""HTTP, settings, logs, metrics and the command line."""

import datetime as dt
import http.client
import json
import logging
import threading

import pytest

from tidewell import cli, config
from tidewell.api import openapi
from tidewell.api.params import PARAMS, Invalid, bind
from tidewell.api.server import Service, serve
from tidewell.functions.network import show_ip
from tidewell.obs import JsonFormatter, Metrics
from tidewell.plans import query as Q
from tidewell.schema import DECODED
from tidewell.sinks.table import FlowTable

from .records import batch, record

KEY = "k" * 20
RANGE = "start=2026-03-04T00:00:00Z&end=2026-03-05T00:00:00Z"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    t = FlowTable(spark, str(tmp_path_factory.mktemp("served")))
    t.migrate()
    t.write_batch(batch(spark, 25), 1)
    return t


def ask(service, path, key=KEY, method="GET"):
    server = serve(service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        c = http.client.HTTPConnection(*server.server_address)
        c.request(method, path, headers={"Authorization": f"Bearer {key}"} if key else {})
        r = c.getresponse()
        text = r.read().decode()
        assert r.headers["X-Request-Id"].startswith("req_") and len(r.headers["X-Request-Id"]) == 16
        return r.status, json.loads(text) if "json" in r.headers["Content-Type"] else text
    finally:
        server.shutdown()
        server.server_close()


def test_flows_page_by_page(store):
    service, seen, cursor = Service({"table": store}, (KEY, "other")), [], ""
    for n, more in ((10, True), (10, True), (5, False)):
        status, body = ask(service, f"/v1/flows?{RANGE}&limit=10{cursor}")
        assert status == 200 and len(body["data"]) == n and body["meta"]["has_more"] is more and ("next_cursor" in body["meta"]) is more
        seen += body["data"]
        cursor = f"&cursor={body['meta'].get('next_cursor')}"
    assert len({r["src_as"] for r in seen}) == 25 and list(seen[0]) == list(openapi.FLOW)
    rows = [dict(zip(DECODED, record(i), strict=True)) for i in range(25)]
    hops = [None if r["next_hop"] is None else show_ip(r["next_hop"]) for r in rows]
    assert seen[0]["received_at"] == "2026-03-04T10:30:00.000024Z" and [r["next_hop"] for r in seen] == hops[::-1] and None in hops
    last = rows[-1]
    status, body = ask(service, f"/v1/flows?{RANGE}&protocol={last['protocol']}&dst_addr={show_ip(last['dst_addr'])}&exporter_id={seen[0]['exporter_id']}")
    assert status == 200 and len(body["data"]) == sum((r["protocol"], r["dst_addr"]) == (last["protocol"], last["dst_addr"]) for r in rows)


def test_exporters_and_ops(store):
    service = Service({"table": store}, (KEY,))
    status, body = ask(service, "/v1/exporters")
    assert status == 200 and body["data"][0]["ip_address"] == "172.20.0.9" and list(body["data"][0]) == list(openapi.EXPORTER)
    assert ask(service, "/healthz", None)[0] == ask(service, "/readyz", None)[0] == 200
    assert "tidewell_records_dropped_total" in ask(service, "/metrics", None)[1]

    class Broken:
        def query(self, q):
            raise RuntimeError("secret detail")

    broken = Service({"a": Broken(), "table": store}, (KEY,))
    assert ask(broken, "/readyz", None) == (503, {"status": "unavailable", "sinks": {"a": "unavailable", "table": "ok"}})
    status, body = ask(broken, f"/v1/flows?{RANGE}")
    assert status == 503 and body["error"]["code"] == "backend_unavailable" and "secret" not in str(body)
    assert ask(Service({}, (KEY,)), f"/v1/flows?{RANGE}")[0] == ask(Service({}, (KEY,)), "/v1/exporters")[0] == 503


@pytest.mark.parametrize("path, key, method, status, code", [
    (f"/v1/flows?{RANGE}", None, "GET", 401, "unauthorized"), (f"/v1/flows?{RANGE}", "wrong", "GET", 401, "unauthorized"), ("/v1/nothing", None, "GET", 401, "unauthorized"), ("/v1/nothing", KEY, "GET", 404, "not_found"),
    ("/v1/flows", KEY, "POST", 405, "method_not_allowed"), ("/elsewhere", None, "GET", 404, "not_found"), (f"/v1/flows?{RANGE}&cursor=zzz", KEY, "GET", 400, "bad_request"), (f"/v1/flows?{RANGE}&src_addr=%zz", KEY, "GET", 400, "bad_request"), (f"/v1/exporters?a;b", KEY, "GET", 400, "bad_request"), ("/v1/flows", KEY, "GET", 422, "validation_error"), ("/v1/exporters?x=1", KEY, "GET", 422, "validation_error"),
])
def test_refusals(store, path, key, method, status, code):
    got, body = ask(Service({"table": store}, (KEY,)), path, key, method)
    assert got == status and body["error"]["code"] == code and body["error"]["request_id"].startswith("req_")


@pytest.mark.parametrize("query, fields", [
    ("", ["start", "end"]), ("start=2026-03-04T00:00:00Z", ["end"]), ("start=2026-03-05T00:00:00Z&end=2026-03-05T00:00:00Z", ["end"]), (RANGE + "&zz=1&aa=2", ["aa", "zz"]), (RANGE + "&exporter_id=0", ["exporter_id"]),
    (RANGE + "&exporter_id=x", ["exporter_id"]), (RANGE + "&protocol=256", ["protocol"]), (RANGE + "&src_addr=1.2.3", ["src_addr"]), ("start=yesterday&end=2026-03-05T00:00:00Z&limit=1.5", ["start", "limit"]),
])
def test_validation(query, fields):
    with pytest.raises(Invalid) as e:
        bind(query, PARAMS)
    assert [d["field"] for d in e.value.details] == fields


def test_binding():
    got = bind("start=2026-03-04T02:00:00.1234567%2B02:00&end=2026-03-05T00:00:00Z&limit=-5&protocol=0", PARAMS)
    assert got["start"] == int(dt.datetime(2026, 3, 4, tzinfo=dt.UTC).timestamp()) * 10**6 + 123456 and got["protocol"] == 0 and Q.clamp(got["limit"]) == 100


def test_openapi_is_stable():
    assert openapi.dump() == openapi.dump()
    doc = json.loads(openapi.dump())
    assert [p["name"] for p in doc["paths"]["/v1/flows"]["get"]["parameters"]] == [p.name for p in PARAMS]
    assert set(doc["components"]["schemas"]["Error"]["properties"]["error"]["properties"]["code"]["enum"]) == set(openapi.CODES)


GOOD = {"TIDEWELL_SOURCES": "udp", "TIDEWELL_SINKS": "table, folder", "TIDEWELL_UDP_ADDR": ":2055", "TIDEWELL_LANDING_PATH": "/l", "TIDEWELL_TABLE_PATH": "/t", "TIDEWELL_FOLDER_PATH": "/f", "TIDEWELL_HTTP_ADDR": "[::1]:80", "TIDEWELL_API_KEYS": "a,b"}


def test_settings(tmp_path):
    c = config.load(GOOD, tmp_path)
    assert c.sinks == ("table", "folder") and c.retention_days == 30 and c.api_keys == ("a", "b") and "api_keys" not in repr(c)
    (tmp_path / ".env").write_text("# comment\nexport TIDEWELL_RETENTION_DAYS='7'\nTIDEWELL_BUFFER=9 # small\n")
    (tmp_path / "a/b").mkdir(parents=True)
    c = config.load(GOOD | {"TIDEWELL_BUFFER": "10"}, tmp_path / "a/b")
    assert (c.retention_days, c.buffer) == (7, 10)


@pytest.mark.parametrize("change, name", [
    ({"SINKS": "disk"}, "SINKS"), ({"UDP_ADDR": ""}, "UDP_ADDR"), ({"TABLE_PATH": ""}, "TABLE_PATH"), ({"RETENTION_DAYS": "0"}, "RETENTION_DAYS"), ({"RETENTION_DAYS": "x"}, "RETENTION_DAYS"), ({"API_KEYS": ""}, "API_KEYS"), ({"LOG_LEVEL": "loud"}, "LOG_LEVEL"),
    ({"SOURCES": "bus", "SINKS": "bus", "BUS_BROKERS": "h:1", "BUS_TOPIC": "t"}, "SINKS"), ({"SOURCES": "bus", "BUS_BROKERS": "h", "BUS_TOPIC": "t"}, "BUS_BROKERS"), ({"SOURCES": "bus", "BUS_BROKERS": "h:1", "BUS_TOPIC": "t", "TEMPLATE_TOPIC": "t"}, "TEMPLATE_TOPIC"),
])
def test_wrong_settings(tmp_path, change, name):
    with pytest.raises(config.ConfigError, match=f"TIDEWELL_{name}:"):
        config.load(GOOD | {f"TIDEWELL_{k}": v for k, v in change.items()}, tmp_path)


def test_command_line(capsys, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    assert cli.main(["--version"]) == 0 and cli.main(["--dump-openapi"]) == 0 and cli.main(["--validate-config"], GOOD) == 0
    assert cli.main(["--validate-config"], {"TIDEWELL_SINKS": "x"}) == 3 and cli.main(["--wat"]) == 2 and cli.main(["--healthcheck"], {**GOOD, "TIDEWELL_HTTP_ADDR": "127.0.0.1:1"}) == 1


def test_logs_hide_secrets():
    record = logging.makeLogRecord({"name": "x", "levelno": 20, "levelname": "INFO", "msg": "to db://user:hunter2@host/x"})
    record.fields = {"api_key": "abc", "nested": {"Password": "p", "fine": 1}}
    entry = json.loads(JsonFormatter().format(record))
    assert "hunter2" not in str(entry) and entry["api_key"] == "[redacted]" and entry["nested"] == {"Password": "[redacted]", "fine": 1}


def test_metrics_text():
    m = Metrics()
    assert 'tidewell_records_dropped_total{reason="buffer_full"} 0' in m.text()
    m.observe("batch_write_seconds", 0.02, sink="table")
    m.count("decode_errors", 3, source="udp")
    text = m.text()
    assert 'tidewell_batch_write_seconds_bucket{sink="table",le="0.025"} 1' in text and 'le="0.01"} 0' in text and 'tidewell_decode_errors_total{source="udp"} 3' in text
