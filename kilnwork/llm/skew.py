"""The salted join of ``operators.skew``, under the name that this subpackage uses."""

from ..operators.skew import HOT_KEYS, KEY_ROWS, salted_lookup

__all__ = ["HOT_KEYS", "KEY_ROWS", "salted_lookup"]
