"""Options: defaults, overridden in part by a JSON file, and these by the environment."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields, is_dataclass

from . import constants as C


@dataclass
class Server:
    port: int = 8888
    host: str = "0.0.0.0"


@dataclass
class Llm:
    use_external: bool = False
    external_url: str = ""
    external_model: str = ""
    local_url: str = ""
    local_model: str = ""
    api_key: str = ""
    timeout_sec: int = 30
    max_retries: int = 3
    retry_backoff_ms: int = 1000


@dataclass
class Search:
    top_k: int = C.TOP_K
    bm25_k1: float = C.K1
    bm25_b: float = C.B
    context_window: int = C.CONTEXT_WINDOW
    max_context_chars: int = C.CONTEXT_CHARS
    score_threshold: float = C.SCORE_THRESHOLD


@dataclass
class Corpus:
    manifest: str = "corpus/manifest.jsonl"
    storage: str = "corpus/index"
    chapter_guide: str = "corpus/chapter_guide.json"


@dataclass
class Reranker:
    enabled: bool = False
    url: str = ""
    timeout_ms: int = 500
    candidate_count: int = 50


@dataclass
class Auth:
    enabled: bool = False
    api_key: str = ""


@dataclass
class RateLimit:
    enabled: bool = False
    requests_per_minute: int = 60


@dataclass
class Scanner:
    enabled: bool = False
    model: str = ""
    url: str = ""
    max_candidates: int = C.SCANNER_CANDIDATES
    max_keep: int = C.SCANNER_KEEP
    max_tokens: int = 5
    temperature: float = 0.0
    timeout_sec: int = 10
    batch_size: int = C.SCANNER_BATCH


@dataclass
class Judge:
    enabled: bool = True
    model: str = ""
    url: str = ""
    max_tokens: int = 50
    temperature: float = 0.1
    timeout_sec: int = 10


@dataclass
class Segments:
    mode: str = "auto"
    early_stop_score: float = 0.0


@dataclass
class Config:
    server: Server = field(default_factory=Server)
    llm: Llm = field(default_factory=Llm)
    search: Search = field(default_factory=Search)
    corpus: Corpus = field(default_factory=Corpus)
    reranker: Reranker = field(default_factory=Reranker)
    auth: Auth = field(default_factory=Auth)
    rate_limit: RateLimit = field(default_factory=RateLimit)
    scanner: Scanner = field(default_factory=Scanner)
    judge: Judge = field(default_factory=Judge)
    segments: Segments = field(default_factory=Segments)


ENVIRONMENT = {"LEXMILL_API_KEY": ("llm", "api_key"), "LEXMILL_API_URL": ("llm", "external_url"), "LEXMILL_MODEL": ("llm", "external_model"), "LEXMILL_SERVER_API_KEY": ("auth", "api_key")}


def load(path: str | None) -> Config:
    """Defaults where there is no file, it isn't JSON, or an option has another type; options that don't exist are ignored."""
    config = Config()
    try:
        with open(path or "", encoding="utf-8") as f:
            given = json.load(f)
        assert isinstance(given, dict)
    except (OSError, ValueError, AssertionError):
        given = {}
    for group in fields(config):
        part, values = getattr(config, group.name), given.get(group.name)
        if is_dataclass(part) and isinstance(values, dict):
            for option in fields(part):
                if option.name in values and option.name != "api_key" or (group.name, option.name) == ("auth", "api_key") and "api_key" in values:
                    value, now = values[option.name], getattr(part, option.name)
                    if isinstance(value, bool) == isinstance(now, bool) and isinstance(value, (type(now), int) if isinstance(now, float) else type(now)):
                        setattr(part, option.name, type(now)(value))
    for name, (group, option) in ENVIRONMENT.items():
        if os.environ.get(name):
            setattr(getattr(config, group), option, os.environ[name])
    return config
