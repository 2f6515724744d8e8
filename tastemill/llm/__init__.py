"""Training-data operators: each module holds one operator as DataFrame -> DataFrame."""
