"""Table-to-table operators: cleaning, calendars, features, validation, upserts, health."""
