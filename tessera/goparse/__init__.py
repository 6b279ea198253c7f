"""A Go front end in Python: scanner, comments and directives. Used per file, inside grouped or mapped functions."""
