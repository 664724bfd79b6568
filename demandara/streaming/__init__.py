"""Daily demand kept fresh from an unbounded input."""
