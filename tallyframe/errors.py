"""Error classes; each maps to one class of caller mistake."""


class EngineError(Exception):
    """Anything that goes wrong at run time."""


class SpecError(EngineError, ValueError):
    """The query does not fit the grammar or the schema."""


class SchemaError(EngineError, ValueError):
    """The schema file or the frame's column types cannot be used."""
