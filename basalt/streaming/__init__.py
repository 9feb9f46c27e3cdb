"""Writing in streams: staged, exactly-once commits, and event-time operators."""
