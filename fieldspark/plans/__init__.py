"""The plans subpackage."""
