"""Uploads in the background: one at a time, with status, steps and a way to stop.

An upload runs in a thread of its own under a job tag.  Questions go on being answered
from the version before until it is done; if it fails or is stopped, that version stays.
"""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass, field

from pyspark.util import InheritableThread

from .engine import Engine
from .versions import STEPS

MESSAGE_CHARS = 200


class Busy(RuntimeError):
    """Another upload is under way."""


@dataclass
class Status:
    processing: bool = False
    path: str | None = None
    step: int = 0
    total_steps: int = len(STEPS)
    #: idle, a step of ``STEPS``, done, failed or stopped
    state: str = "idle"
    message: str = ""
    steps: list[str] = field(default_factory=list)


class Uploads:
    """Uploads to an engine's index."""

    def __init__(self, engine: Engine):
        self.engine, self.status = engine, Status()
        self._lock, self._thread, self._tag = threading.Lock(), None, ""

    def start(self, elements_path: str) -> None:
        """Begin an upload; refused while another one runs."""
        with self._lock:
            if self.status.processing:
                raise Busy(f"{self.status.path} is being taken in")
            self.status, self._tag = Status(processing=True, path=elements_path, state="started"), f"upload-{uuid.uuid4().hex}"
        self._thread = InheritableThread(target=self._run, args=(elements_path, self._tag), daemon=True)
        self._thread.start()

    def stop(self) -> None:
        """Cancel the jobs of the upload that runs; nothing happens if none does."""
        if self.status.processing:
            self.status.message = "stopped"
            self.engine.spark.sparkContext.cancelJobsWithTag(self._tag)

    def wait(self, seconds: float | None = None) -> Status:
        if self._thread is not None:
            self._thread.join(seconds)
        return self.status

    def _run(self, elements_path: str, tag: str) -> None:
        context, status = self.engine.spark.sparkContext, self.status
        context.addJobTag(tag)

        def begin(step: str) -> None:
            if status.message == "stopped":  # between two jobs
                raise RuntimeError("stopped")
            status.step, status.state = STEPS.index(step) + 1, step
            status.steps.append(step)

        try:
            self.engine.upload(elements_path, begin)
            status.state = "done"
        except Exception as e:  # noqa: BLE001  told in the status; the version before stays
            status.state = "stopped" if status.message == "stopped" else "failed"
            status.message = str(e)[:MESSAGE_CHARS]
        finally:
            context.removeJobTag(tag)
            status.processing = False
