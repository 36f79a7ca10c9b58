"""Errors with stable codes, for callers that answer with them."""

from __future__ import annotations

CODES = (
    "daemon.unavailable", "garbage_collection.failed", "garbage_collection.worker_failed", "scheduler.unavailable", "source.recovery_unsafe", "transport.grpc",
    "workspace.index_failed", "workspace.index_worker_failed", "workspace.not_registered", "workspace.observation_count_overflow", "workspace.registry_failed",
)


class ArchgraphError(RuntimeError):
    """An error with one of ``CODES``, which it shows with the product's name before it."""

    def __init__(self, code: str, message: str) -> None:
        if code not in CODES:
            raise ValueError(f"unknown code {code}")
        super().__init__(f"archgraph.{code}: {message}")
        self.code = f"archgraph.{code}"
