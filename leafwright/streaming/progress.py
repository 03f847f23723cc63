"""Progress of streams as callbacks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Calls `told(name, batch, rows)` after each batch of any stream of the session, and `done(name, error)` when one ends. A callback that fails stops nothing."""

    def __init__(self, told: Callable[[str, int, int], None], done: Callable[[str, str | None], None] = lambda _n, _e: None) -> None:
        self.told, self.done = told, done
        self.names: dict[str, str] = {}

    def _safely(self, call: Callable, *args) -> None:
        try:
            call(*args)
        except Exception:  # noqa: BLE001
            pass

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._safely(self.told, p.name or str(p.id), p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._safely(self.done, self.names.pop(str(event.id), str(event.id)), event.exception)
