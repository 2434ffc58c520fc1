"""Where works come from: tables, provider interfaces, collections and control tables."""
