"""From syntax trees to lazily built DataFrames."""
