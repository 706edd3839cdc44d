"""Table -> table operators."""
