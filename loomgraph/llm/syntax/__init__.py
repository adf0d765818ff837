"""Table-driven parsers from bundled grammars."""
