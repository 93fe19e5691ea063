"""Ready-made plans: the generators of training examples, and the registered queries with their SQL."""
