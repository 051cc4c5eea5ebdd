"""DataFrame-in, DataFrame-out steps."""
