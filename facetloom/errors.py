"""Errors of the library."""


class DashboardError(ValueError):
    """A question or selection that the dashboard can't answer; ``path`` names the part that is wrong."""

    def __init__(self, message: str, path: str | None = None):
        super().__init__(message)
        self.path = path
