"""Test inputs from the supplied tables, the registered queries and their oracles."""
