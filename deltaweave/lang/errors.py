"""Errors of programs; ``kind`` is the class that callers and tests match."""


class ProgramError(Exception):
    def __init__(self, kind: str, message: str = "") -> None:
        super().__init__(f"{kind}: {message}" if message else kind)
        self.kind = kind
