"""Analytics operators: DataFrame in, DataFrame out, nothing collected."""
