"""DataFrame in, DataFrame out: the operators of the engine."""
