"""From requests to plans: the predicate language and its compiler."""
