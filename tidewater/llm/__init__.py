"""Operators for preparing training text at scale.

Each module holds one operator with its own general interface;
`queries` applies them to the driver's tables and `oracles` holds their SQL
twins where SQL can express the result.
"""
