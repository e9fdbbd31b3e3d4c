"""Spans and events for an exporter that may not be there: without it nothing happens."""

from __future__ import annotations

import contextlib
import os
from collections.abc import Iterator
from typing import Any

_tracer: Any = None


def configure(service: str = "evidence_engine", endpoint: str | None = None) -> bool:
    """Start tracing where the library is installed; whether it has."""
    global _tracer
    try:
        from opentelemetry import trace
        from opentelemetry.sdk.resources import Resource
        from opentelemetry.sdk.trace import TracerProvider
        from opentelemetry.sdk.trace.export import BatchSpanProcessor, ConsoleSpanExporter
    except ImportError:
        return False
    endpoint = endpoint or os.environ.get("OTEL_EXPORTER_OTLP_ENDPOINT")
    exporter: Any = ConsoleSpanExporter()
    if endpoint:
        from opentelemetry.exporter.otlp.proto.http.trace_exporter import OTLPSpanExporter

        exporter = OTLPSpanExporter(endpoint=endpoint)
    provider = TracerProvider(resource=Resource.create({"service.name": service}))
    provider.add_span_processor(BatchSpanProcessor(exporter))
    _tracer = provider.get_tracer(service)
    return True


def plain_value(value: Any) -> Any:
    """What an attribute may hold: scalars, lists of texts, else text."""
    if isinstance(value, str | bool | int | float):
        return value
    return [str(v) for v in value] if isinstance(value, list | tuple) else str(value)


@contextlib.contextmanager
def span(name: str, **attributes: Any) -> Iterator[Any]:
    """A span, or None where there is no tracing; faults are noted on it and go on."""
    if _tracer is None:
        yield None
        return
    with _tracer.start_as_current_span(name, record_exception=True) as current:
        for k, v in attributes.items():
            if v is not None:
                current.set_attribute(k, plain_value(v))
        yield current


def forwarded(callback=None):
    """An event callback that puts each event on the current span, then calls `callback`."""

    def emit(event: dict) -> None:
        if _tracer is not None:
            from opentelemetry import trace

            trace.get_current_span().add_event(str(event.get("kind", "event")), {k: plain_value(v) for k, v in event.items() if v is not None})
        if callback is not None:
            callback(event)

    return emit
