"""SQL counterparts of the registered queries."""
