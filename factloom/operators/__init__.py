"""DataFrame-in, DataFrame-out operators over fact tables."""
