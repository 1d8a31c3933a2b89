"""Build, score and compare probabilistic forecasts of binary events on Spark DataFrames."""
