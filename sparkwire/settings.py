"""Settings from an env file and the environment. Anything that can't be read for certain is an error, safety flags above all."""

from __future__ import annotations

import logging
import re
from collections.abc import Iterable, Mapping
from pathlib import Path
from types import SimpleNamespace

from sparkwire import vocab


class SettingsError(ValueError):
    pass


def _flag(raw: str) -> bool:
    word = raw.lower()
    if word in ("true", "1", "yes", "on"):
        return True
    if word in ("false", "0", "no", "off"):
        return False
    raise ValueError("true or false")


def _between(kind, low, high):
    def read(raw: str):
        value = kind(raw)
        if not low <= value <= high:
            raise ValueError(f"{low:g} to {high:g}")
        return value

    return read


def _one_of(*names: str, change=str.lower):
    def read(raw: str) -> str:
        if change(raw) not in names:
            raise ValueError(" or ".join(names))
        return change(raw)

    return read


def _matching(pattern: str, what: str):
    def read(raw: str) -> str:
        if not re.fullmatch(pattern, raw):
            raise ValueError(what)
        return raw

    return read


#: name -> (default, reader); an empty value stands for the default
FIELDS = {
    "AI_PROVIDER": ("gemini", _one_of("gemini", "openai")),
    "AI_TEMPERATURE": (None, _between(float, 0, 2)),
    "AI_REQUEST_TIMEOUT": (60.0, _between(float, 5, 600)),
    "GEMINI_API_KEY": ("", str),
    "OPENAI_API_KEY": ("", str),
    "FB_PAGE_ID": ("", _matching(r"\d+", "digits only")),
    "FB_PAGE_ACCESS_TOKEN": ("", str),
    "FB_GRAPH_API_VERSION": ("v26.0", _matching(r"v\d{1,3}\.\d{1,2}", "like v26.0")),
    "DRY_RUN": (True, _flag),
    "PUBLISH_ENABLED": (False, _flag),
    "PUBLISH_REQUIRE_IDS": (True, _flag),
    "LOG_LEVEL": ("INFO", _one_of("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL", change=str.upper)),
    "OUTPUT_DIR": ("output", str),
    "DATABASE_PATH": ("data", str),
    "FEEDS_FILE": ("config/feeds.yaml", str),
    "MAX_ARTICLES_PER_RUN": (10, _between(int, 1, 200)),
    "MAX_ARTICLE_AGE_HOURS": (float(vocab.MAX_AGE_HOURS), _between(float, 1, 1440)),
    "MAX_RETRIES_PER_ARTICLE": (3, _between(int, 1, 20)),
    "RSS_REQUEST_TIMEOUT": (20.0, _between(float, 1, 300)),
    "CARD_TAGLINE": ("BITESIZE NEWS", lambda s: s.upper()[:28]),
}
SECRETS = ("GEMINI_API_KEY", "OPENAI_API_KEY", "FB_PAGE_ACCESS_TOKEN")


def parse_env(text: str) -> dict[str, str]:
    found = re.findall(r"(?m)^[ \t]*(?:export[ \t]+)?([A-Za-z_]\w*)[ \t]*=[ \t]*(\"[^\"\n]*\"|'[^'\n]*'|[^#\n]*)", text)
    return {k: v.strip().strip("\"'") for k, v in found}


def load(values: Mapping[str, str]) -> SimpleNamespace:
    out = {}
    for name, (default, read) in FIELDS.items():
        raw = (values.get(name) or "").strip()
        try:
            out[name.lower()] = read(raw) if raw else default
        except ValueError as e:
            raise SettingsError(f"{name} must be {e} (got {raw!r})") from None
    return SimpleNamespace(**out)


def from_files(env_file: str | None, environ: Mapping[str, str]) -> SimpleNamespace:
    """The process environment wins over the file; a file that was named has to exist."""
    values: dict[str, str] = {}
    path = Path(env_file or ".env")
    if path.is_file():
        values = parse_env(path.read_text("utf-8"))
    elif env_file:
        raise SettingsError(f"{env_file} does not exist")
    return load(values | dict(environ))


def redact(text: str, secrets: Iterable[str] = ()) -> str:
    for s in sorted((s for s in secrets if len(s) >= 6), key=len, reverse=True):
        text = text.replace(s, "[REDACTED]")
    for pattern, by in vocab.SECRET_PATTERNS:
        text = re.sub(pattern, by, text)
    return text


class RedactingFormatter(logging.Formatter):
    """Redacts whole records, tracebacks included."""

    def __init__(self, secrets: Iterable[str] = ()):
        super().__init__("%(asctime)s %(levelname)s %(name)s: %(message)s")
        self.secrets = tuple(secrets)

    def format(self, record: logging.LogRecord) -> str:
        return redact(super().format(record), self.secrets)
