"""Stopping a question that is under way, from another thread."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from facetloom.errors import DashboardError


class Cancelled(DashboardError):
    pass


class Cancellation:
    """``cancel`` stops the jobs that run under it and refuses any more."""

    def __init__(self):
        self.tag, self.asked, self.session = f"question-{uuid.uuid4().hex}", False, None

    def cancel(self) -> None:
        self.asked = True
        if self.session is not None:
            self.session.sparkContext.cancelJobsWithTag(self.tag)

    def check(self) -> None:
        if self.asked:
            raise Cancelled("the question was cancelled")

    @contextmanager
    def on(self, session):
        self.check()
        self.session = session
        session.sparkContext.addJobTag(self.tag)
        try:
            yield
        except Exception:
            self.check()
            raise
        finally:
            session.sparkContext.removeJobTag(self.tag)
