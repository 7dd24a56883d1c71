"""Jobs: tables in, tables out."""
