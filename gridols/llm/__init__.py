"""Training-data operations; nothing else in the library imports this subpackage."""
