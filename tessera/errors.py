"""Errors of the engine."""


class EngineError(Exception):
    """Any refusal of a statement."""


class ParseError(EngineError):
    """Text that is no statement, with the place and, for a misspelt keyword, a suggestion."""

    def __init__(self, message: str, sql: str, at: int, suggestion: str | None = None):
        self.line = sql.count("\n", 0, at) + 1
        self.column = at - (sql.rfind("\n", 0, at) + 1) + 1
        self.suggestion = suggestion
        text = sql.splitlines()[self.line - 1] if sql.strip() else ""
        hint = f"; did you mean {suggestion}?" if suggestion else ""
        super().__init__(f"{message} at line {self.line}, column {self.column}{hint}\n{text}\n{' ' * (self.column - 1)}^")


class TypeMismatch(EngineError):
    pass


class ConstraintError(EngineError):
    pass


class TransactionError(EngineError):
    pass
