"""Settings from the environment and an env file: who asks, how often, where things are; secrets are not shown."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

# Names of the settings, without regard to case.
NAMES = ("sec_user_agent", "sec_requests_per_second", "sec_timeout_seconds", "bank_registry_path", "raw_data_dir", "openai_api_key", "openai_model")


@dataclass(frozen=True)
class Settings:
    sec_user_agent: str
    sec_requests_per_second: float = 4.0
    sec_timeout_seconds: float = 30.0
    bank_registry_path: str = "config/banks.yaml"
    raw_data_dir: str = "data/raw/sec"
    openai_api_key: str | None = field(default=None, repr=False)
    openai_model: str = "gpt-4o"

    def __post_init__(self) -> None:
        if "@" not in self.sec_user_agent:
            raise ValueError("sec_user_agent needs an e-mail address to write to")
        if not 0 < self.sec_requests_per_second <= 10:
            raise ValueError("sec_requests_per_second must be above 0 and at most 10")
        if not self.sec_timeout_seconds > 0:
            raise ValueError("sec_timeout_seconds must be above 0")


def env_file(path: str) -> dict[str, str]:
    """NAME=value lines; blank ones and comments are skipped, quotes around a value are dropped."""
    if not os.path.exists(path):
        return {}
    found = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            name, sign, value = line.strip().removeprefix("export ").partition("=")
            if sign and not name.startswith("#"):
                value = value.strip()
                found[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return found


def load_settings(env: Mapping[str, str] | None = None, path: str = ".env") -> Settings:
    """The environment wins over the file; empty values count as absent, unknown names are ignored."""
    given = {k.lower(): v for source in (env_file(path), os.environ if env is None else env) for k, v in source.items() if v.strip()}
    if "sec_user_agent" not in given:
        raise ValueError("sec_user_agent is required")
    values: dict = {n: given[n].strip() for n in NAMES if n in given}
    for n in ("sec_requests_per_second", "sec_timeout_seconds"):
        if n in values:
            values[n] = float(values[n])
    return Settings(**values)


def web_fetcher(settings: Settings):
    """url -> bytes, with the settings' user agent and time limit; the rate is that of ingest.fetched()."""
    agent, limit = settings.sec_user_agent, settings.sec_timeout_seconds

    def fetch(url: str) -> bytes:
        from urllib.request import Request, urlopen

        with urlopen(Request(url, headers={"User-Agent": agent, "Accept": "*/*"}), timeout=limit) as answer:
            return answer.read()

    return fetch
