"""Named groups of operators and the test views."""
