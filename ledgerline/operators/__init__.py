"""DataFrame -> DataFrame operators, one module per reporting area."""
