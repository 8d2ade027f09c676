"""The operators subpackage."""
