"""Set-oriented screening operators: DataFrame in, DataFrame out."""
