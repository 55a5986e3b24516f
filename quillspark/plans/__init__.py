"""Named queries on the engine's tables, each with the DuckDB SQL that checks it."""
