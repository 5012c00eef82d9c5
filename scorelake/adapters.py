"""Generators over model providers. The client is injected, so nothing here needs a network or a provider's library."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

#: Header names that tell the provider's limit of requests a minute (fixed values), in order of trust.
LIMIT_HEADERS = ("x-ratelimit-limit-requests", "ratelimit-limit-requests", "x-ratelimit-limit")


def requests_per_minute(headers: Mapping[str, Any] | None) -> int | None:
    """The limit that response headers name; None if they name none."""
    lower = {str(k).lower(): v for k, v in (headers or {}).items()}
    found = (str(lower[h]) for h in LIMIT_HEADERS if h in lower)
    return next((int(v) for v in found if v.isdigit()), None)


def token_usage(usage: Any) -> dict[str, int] | None:
    """prompt_tokens and completion_tokens of a usage record (object or mapping) under either of the two usual namings."""
    get = (lambda k: usage.get(k)) if isinstance(usage, Mapping) else (lambda k: getattr(usage, k, None))
    if usage is None:
        return None
    read, written = (next((get(k) for k in names if get(k) is not None), None) for names in (("input_tokens", "prompt_tokens"), ("output_tokens", "completion_tokens")))
    return None if read is None and written is None else {"prompt_tokens": int(read or 0), "completion_tokens": int(written or 0)}


def prompt_text(case: Mapping[str, Any], instructions: str | None = None, prefix: str | None = None, suffix: str | None = None) -> str:
    """A case's input as a prompt: texts as they are, other values as JSON with sorted keys; parts are joined by blank lines."""
    value = case["input"]
    shown = value if isinstance(value, str) else json.dumps(value, sort_keys=True, ensure_ascii=False)
    return "\n\n".join(p for p in (instructions, prefix, shown, suffix) if p)


@dataclass
class Generation:
    """What a generator may return instead of a bare output: tokens used, the conversation, and the steps on the way."""

    output: Any
    token_usage: dict[str, int] | None = None
    conversation: list[dict[str, Any]] | None = None
    trace: list[dict[str, Any]] | None = None
    requests_per_minute: int | None = None


@dataclass
class ChatGenerator:
    """generator(case, seed) for chat services: ``send(messages, seed=…, **options)`` returns (text, usage, headers)."""

    send: Callable[..., tuple[str, Any, Mapping[str, Any] | None]]
    instructions: str | None = None
    options: dict[str, Any] = field(default_factory=dict)
    provider_key: str = "chat"

    def generation(self, case: Mapping[str, Any], seed: int) -> Generation:
        asked = {"role": "user", "content": prompt_text(case, self.instructions)}
        text, usage, headers = self.send([asked], seed=seed, **self.options)
        return Generation(text, token_usage(usage), [asked, {"role": "assistant", "content": text}], None, requests_per_minute(headers))

    def __call__(self, case: Mapping[str, Any], seed: int) -> str:
        made = self.generation(case, seed)
        self.last_usage, self.last_limit = made.token_usage, made.requests_per_minute
        return made.output


@dataclass
class GraphGenerator:
    """generator(case, seed) for agent graphs: ``stream(input, seed)`` yields events with name, kind and output; the last
    output is the result and the events are kept as a trace."""

    stream: Callable[[Any, int], Iterable[Mapping[str, Any]]]
    provider_key: str = "graph"

    def generation(self, case: Mapping[str, Any], seed: int) -> Generation:
        trace = [{"step_name": str(e.get("name", "")), "step_type": str(e.get("kind", "step")), "output": e.get("output")} for e in self.stream(case["input"], seed)]
        outputs = [s["output"] for s in trace if s["output"] is not None]
        if not outputs:
            raise ValueError("the graph gave no output")
        return Generation(outputs[-1], trace=trace)

    def __call__(self, case: Mapping[str, Any], seed: int) -> Any:
        made = self.generation(case, seed)
        self.trace = made.trace
        return made.output
