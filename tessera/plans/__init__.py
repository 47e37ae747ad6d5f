"""From text to DataFrames: grammar, expressions and the SELECT plan."""
