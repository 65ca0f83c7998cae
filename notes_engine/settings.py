"""Settings of the engine: defaults, over them the environment, over it the Spark session."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path

PREFIX = "spark.notes."


@dataclass(frozen=True)
class Settings:
    """The names in capitals are those of the environment; ``spark.notes.<name>`` in the session goes before them.

    Values are taken in the type of their default; a value that does not fit is an error.
    """

    # Defaults.
    openai_api_key: str = ""
    nvidia_api_key: str = ""
    transcript_max_tokens_per_part: int = 50_000
    transcript_cleaning_model_provider: str = "openai"
    transcript_cleaning_model_name: str = "gpt-4o-mini"
    transcript_cleaning_model_temperature: float = 0.0
    transcript_cleaning_chunk_tokens: int = 6000
    transcript_cleaning_chunk_overlap_chars: int = 500
    article_cleaning_model_provider: str = "openai"
    article_cleaning_model_name: str = "gpt-5-mini"
    article_cleaning_model_temperature: float = 0.0
    article_cleaning_chunk_tokens: int = 12000
    article_cleaning_chunk_overlap_chars: int = 500
    hierarchy_model_provider: str = "openai"
    hierarchy_model_name: str = "gpt-5-mini"
    hierarchy_model_temperature: float = 0.0
    hierarchy_input_tokens: int = 18000
    content_model_provider: str = "openai"
    content_model_name: str = "gpt-5-mini"
    content_model_temperature: float = 0.0
    content_input_tokens: int = 8000
    content_input_tokens_fallback: int = 6000
    summary_model_provider: str = "openai"
    summary_model_name: str = "gpt-4o-mini"
    summary_model_temperature: float = 0.0
    summary_input_tokens: int = 5000
    summary_input_tokens_fallback: int = 4000
    max_retries: int = 1
    article_request_timeout: float = 10.0
    article_max_redirects: int = 5
    article_follow_redirects: bool = True
    article_verify_ssl: bool = True
    article_user_agent: str = "notes-engine"
    output_base_dir: str = "output"
    artefacts_dir: str = "artefacts"
    prompts_dir: str = "prompts"
    logs_dir: str = "logs"
    checkpoints_db: str = "artefacts/checkpoints.db"  # stages are tables here; kept so that a settings file still loads
    use_sqlite_checkpointer: bool = True
    enable_structured_logging: bool = True
    log_level: str = "INFO"
    enable_llm_monitoring: bool = True

    @classmethod
    def load(cls, environ: Mapping[str, str] | None = None, env_file: str | None = None, spark=None, required: tuple[str, ...] = ()) -> Settings:
        """Settings from a file of NAME=value lines, the environment, and the session; names ``required`` must be set.

        Models are pluggable here, so no key is required unless a caller's provider needs one.
        """
        found = {}
        if env_file and Path(env_file).is_file():
            for line in Path(env_file).read_text(encoding="utf-8").splitlines():
                name, eq, value = line.strip().partition("=")
                if eq and not name.startswith("#"):
                    found[name.strip().removeprefix("export ").lower()] = value.strip().strip("'\"")
        found |= {k.lower(): v for k, v in (os.environ if environ is None else environ).items()}
        if spark is not None:
            found |= {f.name: v for f in fields(cls) if (v := spark.conf.get(PREFIX + f.name, None)) is not None}
        if lacking := [n for n in required if not str(found.get(n, "")).strip()]:
            raise ValueError(f"not set: {', '.join(lacking)}")
        out = {}
        for f in fields(cls):
            if f.name in found:
                out[f.name] = _typed(found[f.name], type(f.default), f.name)
        if out.get("article_max_redirects", 0) < 0:
            raise ValueError("article_max_redirects must not be negative")
        return cls(**out)


def _typed(value: str, kind: type, name: str):
    if kind is not bool:
        return kind(value)
    low = value.strip().lower()
    if low not in ("1", "0", "true", "false", "yes", "no", "on", "off", "t", "f", "y", "n"):
        raise ValueError(f"{name} must be true or false")
    return low in ("1", "true", "yes", "on", "t", "y")


class Prompts:
    """Prompt templates ``<name>.txt`` of a folder, each read once; {name} stands for a value, {{ and }} for braces."""

    def __init__(self, folder: str | Path):
        self.folder, self._known = Path(folder), {}

    def load(self, name: str) -> str:
        if name not in self._known:
            path = self.folder / f"{name}.txt"
            if not path.is_file():
                raise FileNotFoundError(f"Prompt file not found: {path}")
            self._known[name] = path.read_text(encoding="utf-8")
        return self._known[name]

    def filled(self, name: str, **values: str) -> str:
        return self.load(name).format(**values)
