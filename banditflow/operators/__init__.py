"""Table operators: log shaping, state, graph, folds, sharing, evaluation."""
