"""Training-data operators: one module an operator; queries.py holds the registered queries."""
