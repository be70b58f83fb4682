"""Training-data operators on Spark: one module per operator.

Nothing outside this subpackage imports it; ``queries`` lists the driver's queries.
"""
