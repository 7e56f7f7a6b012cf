"""Refusals: a document that can't be read or written is a row, not a failed job."""


class Refused(Exception):
    def __init__(self, code: str, message: str, field: str | None = None):
        super().__init__(message)
        self.code, self.message, self.field = code, message, field
