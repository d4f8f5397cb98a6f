"""DataFrame -> DataFrame operators keyed on posting_id."""
