"""Model functions: pluggable, with deterministic defaults that need no network."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Model = Callable[[str], str]
_MODELS: dict[str, Callable[[str], Model]] = {}


def provider(name: str):
    """Register a factory (model name) -> (prompt) -> text under a provider, in any case."""

    def add(f):
        _MODELS[name.lower()] = f
        return f

    return add


def factory(name: str) -> Callable[[str], Model]:
    if name.lower() not in _MODELS:
        raise ValueError(f"unknown provider {name!r}")
    return _MODELS[name.lower()]


def model(name: str, which: str = "") -> Model:
    return factory(name)(which)


@provider("extractive")
def _extractive(_which: str) -> Model:
    """The first sentence of a text."""
    return lambda prompt: prompt.strip().split(". ")[0].strip() if prompt else ""


@provider("bullets")
def _bullets(_which: str) -> Model:
    """Sentences of a text as bullets."""
    return lambda prompt: "\n".join(f"- {s.strip()}" for s in prompt.split(". ") if s.strip()) if prompt else ""


def _batch(field: str, text: Callable[[dict], str]) -> Callable[[str], Model]:
    """A model of batches: JSON payloads in, JSON items out."""
    return lambda _which: lambda prompt: json.dumps({"items": [{"id": x["id"], field: text(x)} for x in json.loads(prompt)]})


#: Points as a list, and the first line of structured content without its mark.
provider("outline")(_batch("markdown", lambda x: "\n".join(f"- {p.strip()}" for p in x.get("content_points_list", []))))
provider("digest")(_batch("summary", lambda x: x.get("structured_content", "").split("\n")[0].removeprefix("- ").strip()))


GROUP, LEAF = 8, 4  # points of a topic and of its content nodes


@provider("groups")
def _groups(_which: str) -> Model:
    """A hierarchy of numbered points by their number alone: topics of eight, content nodes of four."""

    def node(first: int, last: int, **more) -> dict:
        return {"name": f"Points {first}-{last}", "start_point": first, "end_point": last, **more}

    def spans(first: int, last: int, size: int) -> list[tuple[int, int]]:
        return [(a, min(a + size - 1, last)) for a in range(first, last + 1, size)]

    def answer(prompt: str) -> str:
        n = sum(1 for line in prompt.split("\n") if line.strip())
        return json.dumps({"hierarchy": [node(a, b, children=[node(c, d) for c, d in spans(a, b, LEAF)]) for a, b in spans(1, n, GROUP)]})

    return answer


def record(calls: DataFrame, node: str, operation: str, provider_name: str, which: str = "") -> DataFrame:
    """Calls (..., input_tokens, output_tokens, duration_ms, success, exception_type) as the log that ``usage`` reads."""
    named = {"node_name": node, "operation_name": operation, "provider": provider_name, "model": which or provider_name}
    out = calls.withColumns({k: F.lit(v) for k, v in named.items()})
    return out.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


def text_of(answer: object) -> str:
    """The text of a model's answer: its ``content``, a list of parts joined, or the answer itself."""
    content = getattr(answer, "content", answer)
    if isinstance(content, list):
        return "".join(p if isinstance(p, str) else str(p.get("text", "")) if isinstance(p, dict) else str(p) for p in content)
    return content if isinstance(content, str) else "" if content is None else str(content)


def call(df: DataFrame, prompt: str, out: str, provider_name: str, which: str = "", attempts: int = 1, retry: Callable[[Exception], bool] | None = None) -> DataFrame:
    """``df`` with the answer to each prompt and a record of the call; write the result before using it twice."""
    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

    schema = StructType(list(df.schema.fields)).add(out, StringType()).add("duration_ms", DoubleType()).add("success", BooleanType()).add("exception_type", StringType())
    may = retry or (lambda e: getattr(e, "is_transient", False))

    def one(f: Model, text: str) -> tuple:
        began = time.monotonic_ns()
        for k in range(max(1, attempts)):
            try:
                return text_of(f(text)), round((time.monotonic_ns() - began) / 1e6, 2), True, None
            except Exception as e:  # the record keeps what went wrong
                if k + 1 == attempts or not may(e):
                    return None, round((time.monotonic_ns() - began) / 1e6, 2), False, type(e).__name__

    make = factory(provider_name)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = make(which)
        for b in batches:
            rows = [one(f, t) for t in b[prompt]]
            yield b.assign(**{c: [r[k] for r in rows] for k, c in enumerate((out, "duration_ms", "success", "exception_type"))})

    return df.mapInPandas(run, schema)
