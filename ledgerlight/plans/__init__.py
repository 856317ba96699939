"""Named queries: business roles bound to tables, each with its SQL counterpart."""
