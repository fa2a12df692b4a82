from threadlens.sources.roles import Forum, forum_from_events, forum_from_orders, read_table  # noqa: F401
