"""scoreframe: evidence aggregation, Bayesian rates and scorecards as Spark DataFrame operators."""
