"""Training-data operators: each module is one operator, `registry` lists their queries."""
