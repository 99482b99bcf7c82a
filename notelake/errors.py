"""Errors, each with a stable code."""

from __future__ import annotations


class NotelakeError(Exception):
    code = "notelake::error"


class QuerySyntaxError(NotelakeError):
    """A text that isn't of its dialect: where, and what was expected there."""

    code = "query::syntax"

    def __init__(self, dialect: str, text: str, start: int, length: int, expected: str):
        super().__init__(f"{dialect} expression {text!r}: expected {expected} at {start}")
        self.dialect, self.text, self.start, self.length, self.expected = dialect, text, start, length, expected


class FieldPathError(NotelakeError):
    code = "query::field_path"

    def __init__(self, path: str, suggestion: str | None = None):
        super().__init__(f"{path!r} isn't a field path" + (f"; did you mean {suggestion!r}?" if suggestion else ""))
        self.path, self.suggestion = path, suggestion


class TableColumnCountError(NotelakeError):
    code = "query::table_columns"


class TaskRowsError(NotelakeError):
    code = "query::task_rows"


class LimitError(NotelakeError):
    code = "query::limit"


class SchemaError(NotelakeError):
    code = "schema::error"


class FunctionError(NotelakeError):
    code = "function::argument"


class TemplateError(NotelakeError):
    code = "template::error"


class ConfigError(NotelakeError):
    code = "config::error"


class UntrustedError(ConfigError):
    code = "config::untrusted"


class OutputExistsError(TemplateError):
    code = "template::output_exists"


class OutsideError(TemplateError):
    """A path that leaves the root."""

    code = "path::outside"


class CancelledError(NotelakeError):
    """A person gave up; not a failure."""

    code = "cancelled"


class UsageError(NotelakeError):
    code = "usage"
