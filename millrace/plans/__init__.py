"""Named queries over the tables, each with the DuckDB SQL that has to agree."""
