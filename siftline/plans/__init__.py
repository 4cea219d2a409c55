"""The registered queries over the test tables, with DuckDB SQL for each."""
