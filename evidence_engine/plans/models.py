"""Models behind an interface: the protocol, tries that are worth repeating, output that must fit a schema, prompts, settings."""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields, replace
from typing import Protocol, TypeVar

from ..functions import jsonx
from ..functions.net import RETRYABLE

T = TypeVar("T")
# Families that take no temperature.
NO_TEMPERATURE = ("gpt-5", "o1", "o3", "o4")


class ModelError(RuntimeError):
    """A call that can't be completed."""


class SchemaError(ModelError):
    """Output that never fitted its schema."""


class ModelClient(Protocol):
    """What the engine asks of a model. Nothing calls it within a transformation; its results enter as tables."""

    def complete(self, system: str, user: str) -> str: ...

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


def retryable(error: BaseException) -> bool:
    return re.search(RETRYABLE, f"{type(error).__name__} {error}".lower()) is not None


def with_retries(call: Callable[[], T], tries: int = 3, wait: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = lambda: 0.0) -> T:
    """call(), again after 1, 2, 4 ... seconds while its fault is one that passes; then ModelError."""
    for attempt in range(tries):
        try:
            return call()
        except Exception as e:
            if attempt + 1 == tries or not retryable(e):
                raise ModelError(str(e)) from e
            wait(2.0**attempt + jitter())
    raise ModelError("no tries")


def structured(client: ModelClient, system: str, user: str, validate: Callable[[dict], T], repairs: int = 2) -> T:
    """validate() of the object in the model's answer. Where that raises ValueError the model gets its answer and the complaint
    back, up to `repairs` times."""
    raw = client.complete(system, user)
    for attempt in range(repairs + 1):
        found = jsonx.extract_object(raw)
        try:
            if found is None:
                raise ValueError("no JSON object in the answer")
            return validate(found)
        except ValueError as e:
            if attempt == repairs:
                raise SchemaError(str(e)) from e
            raw = client.complete(system, f"Your answer doesn't fit the schema.\n\nAnswer:\n{raw[:2000]}\n\nComplaint:\n{str(e)[:800]}\n\nGive only the corrected JSON.")
    raise AssertionError


def supports_temperature(model: str) -> bool:
    return not model.startswith(NO_TEMPERATURE)


# ---- prompts -----------------------------------------------------------------------------------------


def rerank_prompt(question: str, passages: Sequence[str], most: int = 1200) -> str:
    return f"Question: {question}\n\n" + "\n\n".join(f"### Passage {i}\n{p[:most]}" for i, p in enumerate(passages))


def entailment_prompt(pairs: Sequence[tuple[int, str, str]], most: int = 2500) -> str:
    return "\n\n".join(f'### Claim {i}\n{claim}\n\nCited passage:\n"""\n{source[:most]}\n"""' for i, claim, source in pairs)


def triage_prompt(question: str, corpus: str, terms: Sequence[str], probe: Sequence[str], suggested: str, reason: str) -> str:
    return f"Question:\n{question}\n\nCorpus: {corpus}\nFrequent terms: {', '.join(terms)}\n\nWhat a probe found:\n" + "\n".join(f"- {p}" for p in probe) + f"\n\nMeasured route: {suggested}. {reason}\nConfirm or correct it."


def research_prompt(question: str, evidence: str) -> str:
    return f"Question:\n{question}\n\nEvidence:\n{evidence}\n\nState claims that the evidence supports, each with the ids it rests on, and what stays unanswered."


def verifier_prompt(question: str, supported: Sequence[str], rejected: Sequence[str], route: str, round_: int, rounds: int, web: bool) -> str:
    lines = [f"Question:\n{question}", "Claims that hold:", *(f"- {c}" for c in supported[:8]), "Claims that don't:", *(f"- {c}" for c in rejected[:6])]
    return "\n".join([*lines, f"Route {route}, round {round_} of {rounds}, web {'available' if web else 'not available'}. Is this enough, and if not, what next?"])


def synthesis_prompt(question: str, supported: Sequence[str], evidence: str, gaps: Sequence[str], conflicts: str = "") -> str:
    return "\n\n".join(x for x in (f"Question:\n{question}", "Verified claims:\n" + "\n".join(f"- {c}" for c in supported), f"Evidence:\n{evidence}", conflicts, "Open gaps:\n" + "\n".join(f"- {g}" for g in gaps[:6]) if gaps else "") if x)


def resynthesis_prompt(prompt: str, faults: Sequence[str]) -> str:
    return f"{prompt}\n\nYour last answer failed verification:\n" + "\n".join(f"- {f}" for f in faults[:6]) + "\nWrite it again with nothing that the cited passages don't carry."


# ---- settings ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Settings:
    """Driver-side settings. from_env() reads EVIDENCE_<NAME>, a file of such lines giving what the environment doesn't."""

    model: str = ""
    embed_model: str = ""
    base_url: str = ""
    search_endpoints: tuple[str, ...] = ()
    chunk_tokens: int = 320
    overlap_tokens: int = 64
    top_k: int = 6
    max_rounds: int = 3
    max_hops: int = 4
    min_support: float = 0.6
    abstain_below: float = 0.0
    evidence_tokens: int = 6000
    fetch_max_chars: int = 40_000
    max_seconds: float = 180.0
    max_cost: float = 1.0
    max_calls: int = 40

    @classmethod
    def from_env(cls, env_file: str | None = None, environ: dict[str, str] | None = None, **overrides) -> Settings:
        """Blank overrides are left out, so an empty form field changes nothing."""
        found = {}
        if env_file and os.path.exists(env_file):
            with open(env_file, encoding="utf-8") as f:
                found = dict(line.strip().split("=", 1) for line in f if "=" in line and not line.lstrip().startswith("#"))
        found |= os.environ if environ is None else environ
        values = {}
        for f in fields(cls):
            raw = found.get(f"EVIDENCE_{f.name.upper()}", "").strip().strip("\"'")
            if raw:
                kind = type(f.default)
                values[f.name] = tuple(x.strip() for x in raw.split(",") if x.strip()) if kind is tuple else kind(raw)
        return replace(cls(**values), **{k: v for k, v in overrides.items() if v not in (None, "", ())})
