"""Layout of source text: documents of groups and lines, and Go files."""
