"""Pure Column builders; everything stays inside Catalyst expressions."""
