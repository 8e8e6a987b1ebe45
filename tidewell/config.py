"""Settings from TIDEWELL_* variables and an optional .env file found here or in up to ten folders above."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, fields
from pathlib import Path

PREFIX = "TIDEWELL_"
WALK = 10
SOURCES, SINKS, LEVELS, DELIVERIES = ("udp", "bus", "folder"), ("table", "folder", "bus", "sql"), ("debug", "info", "warn", "error"), ("at_least_once", "at_most_once")


class ConfigError(ValueError):
    """Names each variable that is wrong."""


@dataclass(frozen=True)
class Config:
    log_level: str = "info"
    http_addr: str = ""
    udp_addr: str = ""
    landing_path: str = ""
    sources: tuple[str, ...] = ()
    sinks: tuple[str, ...] = ()
    table_path: str = ""
    folder_path: str = ""
    checkpoint_path: str = ""
    retention_days: int = 30
    bus_brokers: tuple[str, ...] = ()
    bus_topic: str = ""
    inbox_paths: tuple[str, ...] = ()
    template_topic: str = ""
    template_path: str = ""
    template_seconds: float = 15.0
    delivery: str = "at_least_once"
    sql_url: str = field(default="", repr=False)
    maintenance_seconds: float = 3600.0
    buffer: int = 65_536
    batch_size: int = 2000
    batch_seconds: float = 1.0
    api_keys: tuple[str, ...] = field(default=(), repr=False)

    def problems(self) -> list[str]:
        out = []
        bad = lambda name, what: out.append(f"{PREFIX}{name.upper()}: {what}")
        if self.log_level not in LEVELS:
            bad("log_level", f"must be one of {', '.join(LEVELS)}")
        if self.delivery not in DELIVERIES:
            bad("delivery", f"must be one of {', '.join(DELIVERIES)}")
        for name, known in (("sources", SOURCES), ("sinks", SINKS)):
            for x in getattr(self, name):
                if x not in known:
                    bad(name, f"unknown {x!r}; known are {', '.join(known)}")
        for name in ("http_addr", "udp_addr"):
            if getattr(self, name) and not _address(getattr(self, name)):
                bad(name, "must be host:port")
        for b in self.bus_brokers:
            if not _address(b):
                bad("bus_brokers", f"{b!r} must be host:port")
        for name in ("retention_days", "buffer", "batch_size"):
            if getattr(self, name) < 1:
                bad(name, "must be at least 1")
        for name in ("batch_seconds", "maintenance_seconds", "template_seconds"):
            if getattr(self, name) <= 0:
                bad(name, "must be over 0")
        needs = {"table_path": "table" in self.sinks, "folder_path": "folder" in self.sinks, "sql_url": "sql" in self.sinks, "bus_brokers": "bus" in self.sources + self.sinks, "bus_topic": "bus" in self.sources + self.sinks, "udp_addr": "udp" in self.sources, "landing_path": "udp" in self.sources, "inbox_paths": "folder" in self.sources}
        for name, needed in needs.items():
            if needed and not getattr(self, name):
                bad(name, "is required")
        if "bus" in self.sources and "bus" in self.sinks:
            bad("sinks", "bus can't be both source and sink")
        if self.template_topic and self.template_topic == self.bus_topic:
            bad("template_topic", "must not be the topic of records")
        if self.template_topic and self.template_path:
            bad("template_path", "can't be given with template_topic")
        if self.template_topic and not self.bus_brokers:
            bad("bus_brokers", "is required")
        if self.http_addr and not self.api_keys:
            bad("api_keys", "is required to serve HTTP")
        return out


def _address(text: str) -> bool:
    m = re.fullmatch(r"(\[[0-9a-fA-F:.]+\]|[^\s:]*):(\d{1,5})", text)
    return bool(m) and int(m[2]) < 1 << 16


def read_env_file(text: str) -> dict[str, str]:
    """KEY=value lines; comments, export and quotes as shells have them."""
    out = {}
    for line in text.splitlines():
        line = line.strip().removeprefix("export ").strip()
        if not line or line.startswith("#") or "=" not in line:
            continue
        key, value = (x.strip() for x in line.split("=", 1))
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        elif " #" in value:
            value = value.split(" #", 1)[0].rstrip()
        out[key] = value
    return out


def find_env_file(folder: Path) -> Path | None:
    for f in [folder, *folder.parents][: WALK + 1]:
        if (f / ".env").is_file():
            return f / ".env"
    return None


def load(env: dict[str, str] | None = None, folder: Path | None = None) -> Config:
    """The environment wins over the file. ConfigError lists everything that is wrong."""
    env = dict(os.environ) if env is None else env
    found = find_env_file((folder or Path.cwd()).resolve())
    env = (read_env_file(found.read_text()) if found else {}) | env
    values, wrong = {}, []
    for f in fields(Config):
        raw = env.get(PREFIX + f.name.upper(), "").strip()
        if not raw:
            continue
        try:
            if f.type.startswith("tuple"):
                values[f.name] = tuple(x.strip() for x in raw.split(",") if x.strip())
            else:
                values[f.name] = {"int": int, "float": float}.get(f.type, str)(raw)
        except ValueError:
            wrong.append(f"{PREFIX}{f.name.upper()}: must be a number")
    config = Config(**values)
    if wrong := wrong + config.problems():
        raise ConfigError("; ".join(wrong))
    return config
