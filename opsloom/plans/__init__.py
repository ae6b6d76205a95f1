"""Plan-level building blocks shared by the operators: sizing, ranking, quantiles, durability."""
