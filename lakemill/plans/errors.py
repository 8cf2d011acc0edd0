"""Errors of statements, by kind; each carries the names involved in its message."""


class EngineError(Exception):
    pass


class ConstraintViolation(EngineError):
    pass


class NotNullViolation(ConstraintViolation):
    pass


class UniqueViolation(ConstraintViolation):
    pass


class CheckViolation(ConstraintViolation):
    pass


class ForeignKeyViolation(ConstraintViolation):
    pass


class NameError_(EngineError):
    """An unknown, repeated or ambiguous table, column, index or constraint."""


class ShapeError(EngineError):
    """A wrong number of values, or a value of a wrong type."""


class TransactionAborted(EngineError):
    pass


class ArithmeticFault(EngineError):
    """Overflow, or a whole number divided by zero."""


def mapped(e: Exception) -> EngineError | None:
    """The kind of an error that Spark raised while it settled names and types or ran a guard; None for what isn't ours."""
    from pyspark.errors import PySparkException

    if not isinstance(e, PySparkException):
        return None
    condition, text = e.getCondition() or "", str(e).splitlines()[0]
    if condition.startswith(("UNRESOLVED_COLUMN", "AMBIGUOUS_REFERENCE", "AMBIGUOUS_COLUMN", "TABLE_OR_VIEW", "COLUMN_ALREADY")):
        return NameError_(text)
    if condition.startswith(("DIVIDE_BY_ZERO", "ARITHMETIC_OVERFLOW", "CAST_OVERFLOW", "BINARY_ARITHMETIC")):
        return ArithmeticFault(text)
    if condition.startswith(("DATATYPE_MISMATCH", "CAST_INVALID", "MISSING_AGGREGATION", "MISSING_GROUP_BY", "NUM_COLUMNS", "INCOMPATIBLE", "MALFORMED", "INVALID_VARIANT")):
        return ShapeError(text)
    return None
