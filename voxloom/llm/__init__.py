"""Training-corpus operators: each module holds one operator with a general interface over DataFrames."""
