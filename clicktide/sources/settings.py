"""Connection settings taken from the environment; no host or password has a default."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass
from urllib.parse import quote_plus

# Defaults of the event stream and of the back-fill.
DEFAULT_TOPIC = "ad-clicks"
DEFAULT_STARTING_OFFSETS = "latest"
DEFAULT_BACKFILL_WINDOWS = 12
DEFAULT_DATABASE_NAME = "adsdb"
DEFAULT_DATABASE_PORT = 5432


def required(env: Mapping[str, str], name: str) -> str:
    """Value of a variable that must be set and not blank."""
    value = env.get(name, "").strip()
    if not value:
        raise KeyError(f"environment variable {name} is not set")
    return value


@dataclass(frozen=True)
class KafkaSettings:
    """Options of the event topic.

    ``max_offsets_per_trigger`` bounds one micro-batch. With ``min_offsets_per_trigger`` a batch waits
    for so many messages, but no longer than ``max_trigger_delay``.
    """

    bootstrap_servers: str
    topic: str = DEFAULT_TOPIC
    starting_offsets: str = DEFAULT_STARTING_OFFSETS
    max_offsets_per_trigger: int | None = None
    min_offsets_per_trigger: int | None = None
    max_trigger_delay: str | None = None

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> KafkaSettings:
        limit = env.get("KAFKA_MAX_OFFSETS_PER_TRIGGER", "").strip()
        least = env.get("KAFKA_MIN_OFFSETS_PER_TRIGGER", "").strip()
        return cls(
            bootstrap_servers=required(env, "KAFKA_BOOTSTRAP_SERVERS"),
            topic=env.get("KAFKA_TOPIC", DEFAULT_TOPIC),
            starting_offsets=env.get("KAFKA_STARTING_OFFSETS", DEFAULT_STARTING_OFFSETS),
            max_offsets_per_trigger=int(limit) if limit else None,
            min_offsets_per_trigger=int(least) if least else None,
            max_trigger_delay=env.get("KAFKA_MAX_TRIGGER_DELAY", "").strip() or None,
        )

    def source_options(self) -> dict[str, str]:
        options = {
            "kafka.bootstrap.servers": self.bootstrap_servers,
            "subscribe": self.topic,
            "startingOffsets": self.starting_offsets,
        }
        if self.max_offsets_per_trigger:
            options["maxOffsetsPerTrigger"] = str(self.max_offsets_per_trigger)
        if self.min_offsets_per_trigger:
            options["minOffsetsPerTrigger"] = str(self.min_offsets_per_trigger)
        if self.max_trigger_delay:
            options["maxTriggerDelay"] = self.max_trigger_delay
        return options

    def sink_options(self) -> dict[str, str]:
        return {"kafka.bootstrap.servers": self.bootstrap_servers, "topic": self.topic}


@dataclass(frozen=True)
class DatabaseSettings:
    """Where ``campaign_agg`` lives when it is kept in a relational database."""

    host: str
    database: str
    user: str
    password: str = ""
    port: int = DEFAULT_DATABASE_PORT
    ssl_mode: str = "require"

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> DatabaseSettings:
        return cls(
            host=required(env, "DB_HOST"),
            database=env.get("DB_NAME", DEFAULT_DATABASE_NAME),
            user=required(env, "DB_USER"),
            password=env.get("DB_PASS", ""),
            port=int(env.get("DB_PORT", DEFAULT_DATABASE_PORT)),
            ssl_mode=env.get("DB_SSLMODE", "require"),
        )

    @property
    def jdbc_url(self) -> str:
        return f"jdbc:postgresql://{self.host}:{self.port}/{self.database}?sslmode={self.ssl_mode}"

    @property
    def url(self) -> str:
        """One-string form, with user and password safe for a URL."""
        login = f"{quote_plus(self.user)}:{quote_plus(self.password)}"
        place = f"{self.host}:{self.port}/{self.database}"
        return f"postgresql://{login}@{place}?sslmode={self.ssl_mode}"


def database_url(env: Mapping[str, str] = os.environ) -> str:
    """``DATABASE_URL`` when given, else a URL put together from the ``DB_*`` variables."""
    return env.get("DATABASE_URL", "").strip() or DatabaseSettings.from_env(env).url


def jdbc_options(env: Mapping[str, str] = os.environ) -> dict[str, str]:
    """Options for Spark's JDBC source: ``JDBC_URL`` when given, else built from ``DB_*``."""
    url = env.get("JDBC_URL", "").strip() or DatabaseSettings.from_env(env).jdbc_url
    return {"url": url, "user": required(env, "DB_USER"), "password": env.get("DB_PASS", "")}


def backfill_windows(env: Mapping[str, str] = os.environ) -> int:
    """How many windows a back-fill covers (``NUM_WINDOWS``)."""
    count = int(env.get("NUM_WINDOWS", "").strip() or DEFAULT_BACKFILL_WINDOWS)
    if count < 1:
        raise ValueError("NUM_WINDOWS must be at least 1")
    return count
